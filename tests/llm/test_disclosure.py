"""Terms that disclose entities, span for span against counting all pairs."""

import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import pii, queries

SCHEMA = "doc_id long, text string"


def corpus():
    """Two thousand texts; one address goes with a nickname always, another with a name nearly always."""
    rng = random.Random(11)
    word = lambda: f"word{rng.randrange(300)}"
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(30) for _ in range(1900)]
    texts += [f"{prose(8)} NightOwl_77 {prose(5)} ann.lee@home.example.org {prose(5)}" for _ in range(30)]
    texts += [f"{prose(8)} Zorbovskij {word()} +49 (30) 5550-1234 {prose(5)}" for _ in range(8)]
    # the terms stand alone as well, where the entity is absent
    texts += [f"{prose(20)} nightowl word1 word1 word1 {prose(400)}", f"zorbovskij\n{prose(9)}", f"Zorbovskij, {prose(9)} x@zorbovskij.de"]
    texts += [f"{prose(3)} footer@corp.example.com corporation {prose(3)}" for _ in range(200)]
    texts += [texts[1900]] * 3 + [None, "", " \n", "x1.2.3.4abcd 1.2.3.4abcd", "ünïcödé Zorbovskij\U0001f600Zorbovskij"]
    return texts


def spans_of(rows):
    return {(r["doc_id"], r["text"]): [tuple(s) for s in r["pii"]] for r in rows}


@pytest.fixture(scope="module")
def judged(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return texts, pii.find(df).collect(), plain.disclosed(texts)


def test_planted_terms_span_for_span(judged):
    texts, rows, want = judged
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(s) for s in r["pii"]] == want[r["text"]], (r["doc_id"], r["text"])
    kinds = {(s[0], s[3], r["text"][s[1] : s[2]].lower()) for r in rows for s in r["pii"] if s[0] == "term"}
    assert ("term", True, "nightowl") in kinds and ("term", False, "zorbovskij") in kinds
    # a word that goes with a footer's address tells nothing, nor do common words
    assert not any(w == "corporation" or w.startswith("word") for *_, w in kinds)
    alone = [r for r in rows if r["text"] and "word1 word1 word1" in r["text"] and "nightowl" in r["text"]]
    assert alone and all([s[0] for s in r["pii"]] == ["term"] for r in alone)


def test_terms_are_generalised_and_removed_from_the_text(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), SCHEMA)
    out = [r[0] for r in pii.find(df).select(pii.redact(F.col("text"), F.col("pii"))).collect() if r[0]]
    assert not any("nightowl" in t.lower() or "zorbovskij" in t.lower() or "ann.lee" in t for t in out)
    assert any(re.search(r" <TERM> word\d+ <PHONE> ", t) for t in out) and any(" _77 " in t for t in out)


def test_the_shuffled_joins_give_the_same(spark, judged, monkeypatch):
    texts, rows, _ = judged
    monkeypatch.setattr(pii, "MAX_BROADCAST", 0)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert spans_of(pii.find(df).collect()) == spans_of(rows)


def test_whole_table_span_for_span(spark):
    folder = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = plain.disclosed(list(docs.values()))
    rows = queries.op9_pii(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["spans"] == ",".join(":".join(map(str, s[:3])) for s in want[docs[r["doc_id"]]])
    assert any("term:" in r["spans"] for r in rows)


def test_running_totals_of_many(spark):
    from sentrylake.llm.common import running

    df = spark.createDataFrame([(0,), (1,), (64,), (65,), (1000,)], "n int").select("n", F.slice(F.sequence(F.lit(1), F.lit(1000)), F.lit(1), F.col("n")).alias("x"))
    for r in df.select("x", running(F.col("x"), F.lit(0), lambda a, b: a + b).alias("t")).collect():
        assert r["t"] == [sum(r["x"][: i + 1]) for i in range(len(r["x"]))]


def test_a_text_of_many_pairs_is_dealt(spark, monkeypatch):
    """The pairs are the same however many parts a text's words are dealt to."""
    rows = [(i, f"write to user{i % 7}@host{i % 5}.example now " + " ".join(f"word{(i * j) % 90}x" for j in range(40))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def pairs():
        found = pii.protected_texts(docs)
        return sorted(map(str, pii.disclosures(docs, found, min_bits=0.1, disclosure=0.2).collect()))

    whole = pairs()
    monkeypatch.setattr(pii, "PART_PAIRS", 5)
    monkeypatch.setattr(pii, "MAX_BROADCAST_BYTES", 10)
    assert pairs() == whole and len(whole) > 3
