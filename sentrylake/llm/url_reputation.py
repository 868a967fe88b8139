"""Host reputation by empirical Bayes, and rules on hosts and paths.

Each labelled page is a trial of its host: bad (1) or not (0).  Hosts lie in
registered domains, those in suffixes, those in the whole corpus.  At each level
the bad rates of the children are taken as draws from a beta distribution whose
mean is the parent's posterior mean and whose concentration is estimated from
the children's spread by the method of moments; a child's posterior is that prior
plus its own counts.  So a host with few labelled pages borrows from its domain,
and where the children of a node do not differ beyond chance, they all get its rate.

The operating point: a host is blocked when its bad rate is above
``max_bad_rate`` with a posterior probability of 95 %.  At 0.5 a blocked host loses
more bad pages than good ones, so that of what is blocked most is bad (the
target is a precision of one half at least on pages that were not labelled).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpointed
from .common import LOWER, UPPER

#: The standard normal's quantile that stands for the bound's probability (95 %).
Z = 1.645
#: A table of more hosts is joined by shuffle, not broadcast.
MAX_BROADCAST = 1_000_000
#: A host whose bad rate is above this with the bound's confidence is blocked.
MAX_BAD_RATE = 0.5
#: Limits of a prior's concentration, in labelled pages.
CONCENTRATION = (2.0, 1000.0)
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_behind(url), "/", 1)).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def _behind(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.char_length(url))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    rest = F.substring_index(F.substring_index(_behind(url), "?", 1), "#", 1)
    path = F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.char_length(rest))).otherwise(F.lit(""))
    return F.coalesce(F.when(F.instr(url, "://") > 0, path), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest of ``suffixes`` (such as ``co.uk``) that ends the host behind a dot, else its last label."""
    out = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=lambda s: s.count(".")):
        out = F.when(host.endswith(f".{s}"), F.lit(s)).otherwise(out)
    return out


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more; the host itself where it has no more."""
    front = F.substring(host, F.lit(1), F.char_length(host) - F.char_length(suffix) - 1)
    return F.when(F.char_length(host) <= F.char_length(suffix), host).otherwise(F.concat_ws(".", F.substring_index(front, ".", -1), suffix))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (verdict, host, path) that fits, else nulls; ties by the rule's text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_counts(pages: DataFrame, bad: str = "bad", host: str = "host") -> DataFrame:
    """(host, n, k): labelled pages and bad ones of every host; hosts without a label have 0."""
    return pages.groupBy(F.col(host).alias("host")).agg(F.count(bad).alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("k"))


def posteriors(counts: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, domain, suffix, n, k, a, b): each host's beta posterior.

    counts: one row for each host.  Level by level the table only shrinks, so
    all sums are pre-aggregated; a suffix with most hosts costs a row per task.
    """
    suffix = suffix_of(F.col("host"), suffixes)
    tree = counts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), suffix))
    # each level is read twice, for its fit and for its posteriors, and so kept
    tree = checkpointed(tree.select("host", "domain", "suffix", F.col("n").cast("double"), F.col("k").cast("double")))
    domains = checkpointed(tree.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    tops = checkpointed(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    # a uniform prior on the corpus' own rate
    root = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(
        F.lit("").alias("root"), ((F.coalesce("k", F.lit(0.0)) + 1) / (F.coalesce("n", F.lit(0.0)) + 2)).alias("mean")
    )
    tops = _shrink(tops.withColumn("root", F.lit("")), root, "root")
    domains = _shrink(domains, tops.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), "suffix")
    hosts = _shrink(tree, domains.select("domain", "suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), "domain", "suffix")
    return hosts.select("host", "domain", "suffix", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "a", "b")


def _shrink(children: DataFrame, parents: DataFrame, *key: str) -> DataFrame:
    """``children`` and a, b of their posteriors; parents: the key and its posterior mean.

    The concentration s of the key's prior comes from the weighted spread v of
    its children's rates around the mean m: with children of n pages,
    E v = m (1 - m) (1 + (n - 1) / (s + 1)) / n.
    """
    joined = checkpointed(children.join(parents, list(key)))
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mean"), 2)))
    fit = joined.groupBy(*key).agg(spread.alias("v"), F.sum("n").alias("pages"), F.count(F.when(F.col("n") > 0, 1)).alias("groups"), F.first("mean").alias("m"))
    # spread / (m (1 - m)) = groups + (pages - groups) / (s + 1)
    excess = (F.col("v") / (F.col("m") * (1 - F.col("m"))) - F.col("groups")) / (F.col("pages") - F.col("groups"))
    low, high = CONCENTRATION
    s = F.when((F.col("groups") < 2) | (F.col("pages") <= F.col("groups")), F.lit(low)).when(excess <= 0, F.lit(high)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), 1 / excess - 1)))
    fit = fit.select(*key, s.alias("s"))
    mean = F.col("mean")
    a, b = F.col("s") * mean + F.col("k"), F.col("s") * (1 - mean) + F.col("n") - F.col("k")
    return checkpointed(joined.join(fit, list(key)).withColumn("a", a).withColumn("b", b).drop("s", "mean"))


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """The quantile of Beta(a, b) below which z standard deviations of a normal lie, by a closed form.

    Spark has no quantile of the beta distribution; this is the approximation by
    Abramowitz and Stegun (26.5.22), within 0.015 for a and b above 1.  For a of 1
    or less the bound is 0; for b of 1 or less the mean less z deviations.
    """
    u, v = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h, level = 2 / (u + v), (z * z - 3) / 6
    w = z * F.sqrt(h + level) / h - (v - u) * (level + 5 / 6 - 2 / (3 * h))
    mean = a / (a + b)
    plain = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
    return F.when(a <= 1, F.lit(0.0)).when((b <= 1) | (h + level <= 0), plain).otherwise(a / (a + b * F.exp(2 * w)))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    key: Column,
    bad: Column,
    label_key: str = "doc_id",
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = (),
    suffixes: Sequence[str] = (),
    max_bad_rate: float = MAX_BAD_RATE,
    z: float = Z,
) -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate, bad_rate_bound) of every page.

    key: of a page, the label it belongs to (null: none); bad: of a label, 1
    or 0 (null: no label).  A key with several labels is bad if one is.  The
    longest rule that fits decides; else a host whose bound is above
    ``max_bad_rate`` is blocked.  A null url has an empty host, which is
    judged like any other.  Repeated rows are repeated trials and stay.  Urls
    may be of any length, an empty table gives an empty one, and other columns
    of ``pages`` are not kept, so none clashes.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), key.alias("_key"))
    outcomes = labels.select(F.col(label_key).alias("_key"), bad.cast("long").alias("bad")).where("bad is not null").groupBy("_key").agg(F.max("bad").alias("bad"))
    labelled = parsed.join(outcomes, "_key").select("host", "bad")
    counts = host_counts(parsed.select("host", F.lit(None).cast("long").alias("bad")).unionByName(labelled))
    rate = F.col("a") / (F.col("a") + F.col("b"))
    bound = posteriors(counts, suffixes).select("host", rate.alias("bad_rate"), lower_bound(F.col("a"), F.col("b"), z).alias("bad_rate_bound"))
    # a host may have a third of all pages; beyond what may be broadcast the adaptive join splits it
    bound = F.broadcast(bound) if bound.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else bound
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_rate_bound") > max_bad_rate, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(bound, "host").select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "bad_rate", "bad_rate_bound")
