"""Readers and writers of the formats that events, traces, indicators and reports come in."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import infer_ioc_type, normalize_ioc, parse_lines

FEED_COLUMNS = ("type", "value", "source", "confidence", "threat_score", "tags", "description")


# --- events and traces -----------------------------------------------------------------------------


def read_event_jsonl(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Events of newline-delimited JSON, gzip by suffix; lines that are no JSON object are left out."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parse_lines(lines, fmt="json", year=year).select("event.*")


def read_log_lines(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """P08 over files: (line, format, event)."""
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "line"), year=year)


_CDM_KINDS = ("FileObject", "Event", "Subject", "NetFlowObject")


def read_cdm_events(spark: SparkSession, path: str, cdm: str = "20") -> DataFrame:
    """Provenance events: eleven fields, '' where one is missing; user id and name once for each file.

    Lines are picked by what they contain before any JSON is parsed.
    """
    # a line's place in its file: the start of its part, then its number there
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), place.alias("place"))
    wanted = F.lit(False)
    for kind in _CDM_KINDS:
        wanted = wanted | F.col("line").contains(f"{cdm}.{kind}")
    skipped = F.col("line").contains("FILE_OBJECT_UNIX_SOCKET") | F.col("line").contains("FILE_OBJECT_DIR")
    users = lines.select("file", "place", F.nullif(F.regexp_extract("line", '"userId":"([^"]+)"', 1), F.lit("")).alias("u"), F.nullif(F.regexp_extract("line", r'"username":\{"string":"([^"]+)"\}', 1), F.lit("")).alias("n"))
    users = users.groupBy("file").agg(F.min_by("u", F.when(F.col("u").isNotNull(), F.col("place"))).alias("userid"), F.min_by("n", F.when(F.col("n").isNotNull(), F.col("place"))).alias("username"))
    doc = lines.where(wanted & ~skipped).withColumn("v", F.try_parse_json("line")).where("v is not null")
    event = f"$.datum['com.bbn.tc.schema.avro.cdm{cdm}.Event']"
    uuid = f"['com.bbn.tc.schema.avro.cdm{cdm}.UUID']"
    get = lambda p: F.coalesce(F.try_variant_get("v", p, "string"), F.lit(""))
    path_ = F.try_variant_get("v", f"{event}.predicateObjectPath.string", "string")
    # a row for each file, of which the driver has the names anyway
    return doc.join(F.broadcast(users), "file").select(
        get(f"{event}.subject{uuid}").alias("actorID"), get(f"{event}.predicateObject{uuid}").alias("objectID"), get(f"{event}.type").alias("action"), get(f"{event}.timestampNanos").alias("timestampNanos"),
        get("$['@timestamp']").alias("timestamp"), get(f"{event}.properties.map.exec").alias("exec"), F.when(path_.isNotNull(), F.create_map(F.lit("objectpath"), path_)).alias("properties"),
        get(f"{event}.properties.map.cmdLine").alias("cmdline"), get("$.hostId").alias("hostid"), "username", "userid",
    )


def read_labelled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Edges of six columns; incomplete rows are left out."""
    names = ("actorID", "actor_type", "objectID", "object", "action", "timestamp")
    return spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names)).dropna()


def read_trace_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A trace whose timestamp is cast from text."""
    return spark.read.parquet(path).withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def read_concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects that follow each other without a line break."""
    # cut between the braces, which are put back, so that a file is read by many tasks
    cut = spark.read.option("lineSep", "}{").text(path).select(F.trim("value").alias("v"))
    parts = cut.select(F.explode(F.split(F.when(F.col("v").startswith("{"), F.col("v")).otherwise(F.concat(F.lit("{"), "v")), r"(?<=\})\s+(?=\{)")).alias("j"))
    whole = F.when(F.try_parse_json("j").isNull(), F.concat("j", F.lit("}"))).otherwise(F.col("j"))
    return parts.select(whole.alias("j")).where(F.try_parse_json("j").isNotNull()).select(F.from_json("j", schema).alias("o")).select("o.*")


def read_etw_json(spark: SparkSession, root: str, schema: str = "Event string, PID long, PPID long, PName string, args map<string,string>, TimeStamp long") -> DataFrame:
    """Every .json file below the root."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)


def read_workstation_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace events as JSON lines."""
    return spark.read.schema("action string, actorID string, objectID string, object string, pid long, ppid long, properties map<string,string>, timestamp string").json(path)


# --- indicator feeds (one schema for all) ------------------------------------------------------------


def _feed(rows: DataFrame, kind: Column, value: Column, source: str, confidence: Column, threat: Column, tags: Column, description: Column) -> DataFrame:
    known = F.coalesce(kind, infer_ioc_type(value))
    out = rows.select(
        known.alias("type"), value.alias("value"), F.lit(source).alias("source"), F.coalesce(confidence.try_cast("double"), F.lit(0.8)).alias("confidence"), F.coalesce(threat.try_cast("double"), F.lit(0.7)).alias("threat_score"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), F.coalesce(description, F.lit("")).alias("description"),
    )
    return out.where("type is not null and value is not null").withColumn("value", normalize_ioc(F.col("type"), F.col("value")))


#: Other names of a CSV feed's columns, and types of STIX objects.
CSV_NAMES = {
    "value": ("value", "indicator", "ioc", "address", "hash"), "type": ("type", "ioc_type", "indicator_type"), "confidence": ("confidence",),
    "threat_score": ("threat_score", "score"), "tags": ("tags", "labels"), "description": ("description", "comment", "notes"),
}
STIX_TYPES = {"ipv4-addr": "ip", "ipv6-addr": "ip", "domain-name": "domain", "url": "url", "file": "hash_sha256", "email-addr": "email", "windows-registry-key": "registry"}
IOC_TYPES = ("ip", "domain", "url", "hash_md5", "hash_sha1", "hash_sha256", "file_path", "process", "user", "email", "registry")


def load_feed_csv(spark: SparkSession, path: str, source: str = "csv") -> DataFrame:
    """Columns by their usual names; tags are split at semicolons."""
    rows = spark.read.csv(path, header=True)

    def first(name: str) -> Column:
        have = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in CSV_NAMES[name] if c in rows.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    named = F.lower(first("type"))
    kind = F.when(named.isin(*IOC_TYPES), named).when(named.isNotNull(), infer_ioc_type(first("type")))
    tags = F.filter(F.transform(F.split(first("tags"), ";"), lambda t: F.trim(t)), lambda t: t != "")
    return _feed(rows, kind, first("value"), source, first("confidence"), first("threat_score"), tags, first("description"))


def _from_variant(rows: DataFrame, source: str) -> DataFrame:
    get = lambda n: F.try_variant_get("v", f"$.{n}", "string")
    kind = F.when(F.lower(get("type")).isin(*IOC_TYPES), F.lower(get("type")))
    return _feed(rows.where(F.try_variant_get("v", "$.value", "string").isNotNull()), kind, get("value"), source, get("confidence"), get("threat_score"), F.try_variant_get("v", "$.tags", "array<string>"), get("description"))


def load_feed_json(spark: SparkSession, path: str, source: str = "json") -> DataFrame:
    """A list of indicators, or an object with the list under ``iocs``; what is none is left out."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d"))
    items = F.coalesce(F.try_variant_get("d", "$.iocs", "array<variant>"), F.try_variant_get("d", "$", "array<variant>"))
    return _from_variant(doc.select(F.explode(items).alias("v")), source)


def load_feed_jsonl(spark: SparkSession, path: str, source: str = "jsonl") -> DataFrame:
    """One indicator a line; blank lines, comments and bad lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    return _from_variant(lines.select(F.try_parse_json("line").alias("v")).where("v is not null"), source)


def load_feed_stix(spark: SparkSession, path: str, source: str = "stix-lite") -> DataFrame:
    """Every ``[type:attribute = 'value']`` of the patterns under ``indicators``; confidence is out of 100."""
    pattern = r"\[([a-z0-9-]+):([a-z_]+)\s*=\s*'([^']+)'\]"
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d"))
    rows = doc.select(F.explode(F.try_variant_get("d", "$.indicators", "array<variant>")).alias("v"))
    text = F.coalesce(F.try_variant_get("v", "$.pattern", "string"), F.lit(""))
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "o"), (2, "a"), (3, "x"))))
    rows = rows.select("v", F.explode(parts).alias("m"))
    kind = F.lit(None).cast("string")
    for name, t in STIX_TYPES.items():
        kind = F.when(F.col("m.o") == name, F.lit(t)).otherwise(kind)
    kind = F.when((kind == "hash_sha256") & F.lower("m.a").contains("md5"), "hash_md5").otherwise(kind)
    tags = F.coalesce(F.try_variant_get("v", "$.labels", "array<string>"), F.try_variant_get("v", "$.tags", "array<string>"))
    name = F.coalesce(F.try_variant_get("v", "$.name", "string"), F.try_variant_get("v", "$.description", "string"))
    confidence = F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.lit(70.0)) / 100
    return _feed(rows, kind, F.col("m.x"), source, confidence, F.try_variant_get("v", "$.threat_score", "double"), tags, name)


def load_feed_hosts(spark: SparkSession, path: str, source: str = "hosts") -> DataFrame:
    """The last word of each line, comments off."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    none = F.lit(None).cast("string")
    return _feed(lines, none, F.element_at(F.split("line", r"\s+"), -1), source, none, none, F.lit(None).cast("array<string>"), none)


FEEDS = {"csv": load_feed_csv, "json": load_feed_json, "jsonl": load_feed_jsonl, "stix-lite": load_feed_stix, "hosts": load_feed_hosts}
SUFFIXES = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".stix": "stix-lite", ".txt": "hosts", ".list": "hosts"}


def load_feed(spark: SparkSession, path: str, format: str | None = None, source: str | None = None) -> DataFrame:  # noqa: A002
    """A feed by its format, else by its suffix, else as a hosts file."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""
    return FEEDS[format if format in FEEDS else SUFFIXES.get(suffix, "hosts")](spark, path, source or name)


# --- configuration -----------------------------------------------------------------------------------


def load_rules(records: list[dict[str, Any]] | str):
    """Rules from JSON text or records; a matcher is a scalar, a list, {"regex"} or {"op", "value"}."""
    from ..functions import predicates as P
    from ..operators.rules import Rule

    def matcher(m: Any):
        if isinstance(m, dict) and "regex" in m:
            return P.regex(m["regex"])
        if isinstance(m, dict) and m.get("op") == "not in":
            return P.not_in(*m["value"])
        if isinstance(m, dict):
            return P.compare(m["op"], m["value"])
        return P.one_of(*m) if isinstance(m, list) else P.equals(str(m))

    records = json.loads(records) if isinstance(records, str) else records
    return tuple(Rule(r["id"], r.get("name", r["id"]), float(r.get("score", 0.7)), r.get("severity", "medium"), {k: matcher(m) for k, m in r.get("where", {}).items()}, tuple(r.get("tags", ()))) for r in records)


def load_technique_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(technique_id, name, tactics) of the attack patterns with an external id."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d"))
    rows = doc.select(F.explode(F.try_variant_get("d", "$.objects", "array<variant>")).alias("v")).where(F.try_variant_get("v", "$.type", "string") == "attack-pattern")
    ids = F.from_json(F.to_json(F.try_variant_get("v", "$.external_references", "variant")), "array<struct<external_id:string>>")
    tactics = F.from_json(F.to_json(F.try_variant_get("v", "$.kill_chain_phases", "variant")), "array<struct<phase_name:string>>")
    first = F.get(F.filter(F.transform(ids, lambda x: x["external_id"]), lambda x: x.startswith("T")), F.lit(0))
    none = F.array().cast("array<string>")
    return rows.select(first.alias("technique_id"), F.try_variant_get("v", "$.name", "string").alias("name"), F.coalesce(F.transform(tactics, lambda x: x["phase_name"]), none).alias("tactics")).where("technique_id is not null")


SUPPRESSION = "rule_id string, name string, match map<string,string>, max_severity string, created_at double, expires_at double, enabled boolean"


def load_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Suppression rules from JSON lines, one row for each field that a rule matches; rules without an id are left out."""
    rows = spark.read.schema(SUPPRESSION).json(path).where("rule_id is not null")
    return rows.select("rule_id", F.explode_outer("match").alias("field", "pattern"), "max_severity", "created_at", "expires_at", F.coalesce("enabled", F.lit(True)).alias("enabled"))


def load_documents(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """Nested JSON documents of a schema; those that lack a required field are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    return rows


# --- sinks -------------------------------------------------------------------------------------------


def export_jsonl(df: DataFrame, path: str) -> None:
    """S17, S21, S29."""
    df.write.mode("overwrite").json(path)


def flat_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The given columns, nested ones as JSON text; by default the scalar ones."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns or [n for n, t in fields.items() if not isinstance(t, nested)]
    return df.select(*(F.to_json(n).alias(n) if isinstance(fields[n], nested) else F.col(n) for n in names))


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """S22."""
    flat_columns(df, columns).write.mode("overwrite").csv(path, header=True)


def export_bundle(folder: str, payload: str | None = "raw", **tables: DataFrame) -> DataFrame:
    """Each table as JSON in a folder of its own, without the payload column if that is given; returns the manifest (table, rows)."""
    manifest = None
    for name, df in tables.items():
        (df.drop(payload) if payload else df).write.mode("overwrite").json(f"{folder}/{name}")
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def append_snapshots(df: DataFrame, path: str) -> None:
    """Incident snapshots, always added."""
    df.write.mode("append").parquet(path)


def save_embeddings(df: DataFrame, path: str, **metadata: Any) -> None:
    """Vectors by kind under ``path``, and one row of metadata beside them; vectors are written anew, so is the row."""
    df.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/vectors")
    row = df.sparkSession.createDataFrame([({k: str(v) for k, v in metadata.items()},)], "metadata map<string,string>")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_embeddings(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/vectors")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def embeddings_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """The metadata that was saved with the vectors."""
    row = spark.read.schema("metadata map<string,string>").json(f"{path}/metadata").first()
    return dict(row["metadata"] or {}) if row else {}
