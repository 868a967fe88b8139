"""Threat intelligence: merging indicators, matching them, scoring and reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import normalize_ioc

#: Event fields and the indicator type each is looked up as.
FIELD_TYPES = (("dst_ip", "ip"), ("src_ip", "ip"), ("file_path", "file_path"), ("process", "process"), ("user", "user"))
TEXT_FIELDS = ("command_line", "message")
URL_HOST, HASH = r"(?i)https?://([^/\s]+)", r"\b([a-fA-F0-9]{32,64})\b"
HASH_TYPES = {32: "hash_md5", 40: "hash_sha1", 64: "hash_sha256"}


def merge_iocs(iocs: DataFrame) -> DataFrame:
    """A10: one row for each (type, value): greatest confidence and threat, all tags, the source of the most confident, the first description.

    iocs: type, value, source, confidence, threat_score, tags, description, seq (order of arrival).
    """
    rows = iocs.withColumn("value", normalize_ioc(F.col("type"), F.col("value")))
    return rows.groupBy("type", "value").agg(
        F.max("confidence").alias("confidence"),
        F.max("threat_score").alias("threat_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.max_by("source", F.struct("confidence", (-F.col("seq")).alias("s"))).alias("source"),
        F.coalesce(F.min_by("description", F.when(F.col("description") != "", F.col("seq"))), F.lit("")).alias("description"),
    )


def observed_values(events: DataFrame) -> DataFrame:
    """(event_id, field, type, value): what of each event is looked up."""
    have = set(events.columns)
    parts = [F.array(F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), F.col(f).cast("string").alias("value"))) for f, t in FIELD_TYPES if f in have]
    for f in TEXT_FIELDS:
        if f not in have:
            continue
        text = F.coalesce(f, F.lit(""))
        hosts = F.transform(F.regexp_extract_all(text, F.lit(URL_HOST), F.lit(1)), lambda h: F.regexp_replace(h, "^/+|/+$", ""))
        hashes = F.filter(F.regexp_extract_all(text, F.lit(HASH), F.lit(1)), lambda h: F.char_length(h).isin(*HASH_TYPES))
        for kind in ("domain", "ip"):
            parts.append(_typed(hosts, f, kind))
        parts.append(F.transform(hashes, _hash_struct(f)))
    if "raw" in have:
        raw = F.get_json_object("raw", "$.hash")
        kind = F.when(F.char_length(raw) == 32, "hash_md5").when(F.char_length(raw) == 40, "hash_sha1").when(F.char_length(raw) == 64, "hash_sha256")
        parts.append(F.array(F.struct(F.lit("raw.hash").alias("field"), kind.alias("type"), raw.alias("value"))))
    rows = events.select("event_id", F.explode(F.concat(*parts)).alias("o")).select("event_id", "o.*").where("value <> '' and type is not null")
    # an address loses its port; what does not care for case is looked up in lower case
    value = F.when(F.col("type") == "ip", F.substring_index("value", ":", 1)).when(F.col("type").startswith("hash_") | (F.col("type") == "domain"), F.lower("value")).otherwise(F.col("value"))
    return rows.withColumn("value", value)


def _typed(values: Column, field: str, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("type"), v.alias("value")))


def _hash_struct(field: str):
    def of(h: Column) -> Column:
        kind = F.when(F.char_length(h) == 32, "hash_md5").when(F.char_length(h) == 40, "hash_sha1").otherwise("hash_sha256")
        return F.struct(F.lit(field).alias("field"), kind.alias("type"), h.alias("value"))

    return of


def match_iocs(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """(event_id, field, type, value, source, confidence, threat_score): every match.

    Spark broadcasts the indicators if their size is below its threshold, else joins by shuffle.
    """
    return observed_values(events).join(iocs.select("type", "value", "source", "confidence", "threat_score"), ["type", "value"])


def score_ioc_matches(matches: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(event_id, score, matches): the best threat times confidence, and a quarter of the others', each 0.6 of the one before."""
    w = F.collect_list(F.col("threat_score") * F.col("confidence"))
    ranked = matches.groupBy("event_id").agg(F.sort_array(w, asc=False).alias("w"))
    boosts = F.transform("w", lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x * F.pow(F.lit(0.6), i)))
    total = F.get("w", F.lit(0)) + 0.25 * F.aggregate(boosts, F.lit(0.0), lambda a, x: a + x)
    return ranked.select("event_id", F.least(F.lit(1.0), total).alias("score"), F.size("w").alias("matches")).where(F.col("score") >= min_score)


def enrich_events(events: DataFrame, iocs: DataFrame, reputation: DataFrame | None = None, ttl: float | None = None) -> DataFrame:
    """Events with arrays of indicator hits and, if given, fresh reputation entries; no event is lost."""
    hits = match_iocs(events, iocs).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "source"))).alias("ioc_hits"))
    out = events.join(hits, "event_id", "left")
    if reputation is not None:
        known = reputation_join(events, reputation, ttl).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "score"))).alias("reputation"))
        out = out.join(known, "event_id", "left")
    return out


def reputation_join(events: DataFrame, reputation: DataFrame, ttl: float | None) -> DataFrame:
    """(event_id, field, value, score) of addresses with an entry that is fresh at the event's time."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.substring_index(f, ":", 1).alias("value")) for f in ("dst_ip", "src_ip") if f in events.columns))
    rows = events.select("event_id", "ts", F.explode(fields).alias("o")).select("event_id", "ts", "o.*")
    joined = rows.join(reputation.where("kind = 'ip'").select("value", "score", "cached_at"), "value")
    fresh = F.lit(True) if ttl is None else (F.col("ts") >= F.col("cached_at")) & (F.col("ts") - F.col("cached_at") <= ttl)
    return joined.where(fresh).select("event_id", "field", "value", "score")
