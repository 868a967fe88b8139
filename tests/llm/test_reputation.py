"""Host reputation: who is blocked, who borrows, and the bound."""

import math
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "/root/repo/tests")
from compare import compare, connect

from sentrylake.llm import queries, url_reputation


def beta_quantile(p, a, b, steps=20_000):
    xs = [(i + 0.5) / steps for i in range(steps)]
    ys = [math.exp((a - 1) * math.log(x) + (b - 1) * math.log(1 - x)) for x in xs]
    total, run = sum(ys), 0.0
    for x, y in zip(xs, ys):
        run += y
        if run >= p * total:
            return x


def test_bound_is_near_the_beta_quantile(spark):
    ab = [(1.2, 3.0), (2.0, 2.0), (1.5, 40.0), (30.0, 10.0), (300.0, 20.0), (5.0, 1.5), (60.0, 60.0)]
    df = spark.createDataFrame(ab, "a double, b double")
    for r in df.select("a", "b", url_reputation.lower_bound(F.col("a"), F.col("b")).alias("x")).collect():
        assert r["x"] == pytest.approx(beta_quantile(0.05, r["a"], r["b"]), abs=0.015), r


def test_a_bad_host_is_blocked_and_a_sparse_one_borrows(spark):
    """A host with many bad pages; two hosts with one bad page each, one in a bad domain and one in a good one."""
    urls = [("http://bad.farm.co.uk/", 60, 57), ("http://more.farm.co.uk/", 50, 48), ("http://other.farm.co.uk/", 40, 39), ("http://sparse.farm.co.uk/", 1, 1), ("http://unseen.farm.co.uk/", 0, 0)]
    urls += [(f"http://h{i}.good{i % 7}.co.uk/", 30, 1 + i % 3) for i in range(40)] + [("http://sparse.good1.co.uk/", 1, 1), ("http://x.fine.org/", 50, 2)]
    pages, labels, n = [], [], 0
    for url, total, bad in urls:
        for i in range(max(1, total)):
            pages.append((n, f"{url}p/{n}"))
            if total:
                labels.append((n, int(i < bad)))
            n += 1
    p = spark.createDataFrame(pages, "page_id long, url string")
    found = url_reputation.judge(p, spark.createDataFrame(labels, "doc_id long, bad int"), F.col("page_id"), F.col("bad"), suffixes=("co.uk",)).collect()
    verdict = {r["host"]: (r["verdict"], r["bad_rate"]) for r in found}
    assert len(found) == len(pages)
    assert {h for h, (v, _) in verdict.items() if v == "block"} == {f"{x}.farm.co.uk" for x in ("bad", "more", "other", "sparse", "unseen")}
    assert verdict["sparse.good1.co.uk"][1] < 0.5 < verdict["sparse.farm.co.uk"][1]
    # without the suffix list all of co.uk is one domain, and the sparse host does not borrow from the farm alone
    found = url_reputation.judge(p, spark.createDataFrame(labels, "doc_id long, bad int"), F.col("page_id"), F.col("bad")).collect()
    assert {r["verdict"] for r in found if r["host"] == "unseen.farm.co.uk"} == {"allow"}


def test_why_nothing_is_blocked_here(spark):
    """The labels of the tables do not depend on the hosts: their rates differ by chance only, and no bound is near the limit."""
    folder = "/root/testdata/sf0.1"
    compare(queries.op2_url_reputation(spark, folder), connect(folder), queries.ORACLE_SQL["op2_url_reputation"])
    pages, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "labels"))
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"/([0-9]{1,18})[^/0-9]*$", 1).try_cast("long")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    rows = url_reputation.judge(pages, labels, number, bad, suffixes=queries.URL_SUFFIXES).select("host", "bad_rate", "bad_rate_bound").distinct().collect()
    assert 0.1 < max(r["bad_rate_bound"] for r in rows) < url_reputation.MAX_BAD_RATE
