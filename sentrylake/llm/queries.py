"""The numbered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fill_middle, mixing, pii, quality, sharding, simhash, sketches, substring_dedup, token_counts, toxicity, url_reputation
from .common import n_words, table, text_or_empty

#: Rules on hosts and paths as (verdict, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of more than one label under which the pages' hosts are registered.
URL_SUFFIXES = ("example.com", "example.net", "example.org", "co.uk", "com.au", "co.jp", "com.br")
BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"
TOXIC_AT = 0.7
MAX_TOKENS = 4096
N_SHARDS = 24


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # a page shows the document whose number ends its path; its outcome is that document's label
    number = F.try_to_number(F.nullif(F.regexp_extract(url_reputation.path_of(F.col("url")), r"/([0-9]{1,18})[^/0-9]*$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    judged = url_reputation.judge(pages, labels, number, bad, rules=URL_RULES, suffixes=URL_SUFFIXES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "text"), path, pattern, decoded_col="decoded")
    return encoded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = token_counts.token_counts(docs, public_tokenizers.path(PIECE_BPE))
    counted = docs.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    docs = docs.withColumn("sketch", sketches.sketch(F.col("text")))
    pairs = sketches.with_next(docs, "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"))
    pairs = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.sketch(F.col("edited")).alias("edited_sketch"), "sketch", "next_sketch")
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketches.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.PATTERNS), F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = conversations.repair(conversations.damage(rows))
    every = rows.select("conv_id").distinct()
    # a conversation of which the damage leaves nothing
    none = {"audit": F.lit(""), "digest": F.unhex(F.sha2(F.lit(""), 256))}
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *counts, *(F.coalesce(F.col(c), of).alias(c) for c, of in none.items()))
    return found.select("*", F.lower(F.hex("digest")).alias("repaired_sha256")).drop("digest")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("link"))
    dealt = sharding.assign(docs, shards=N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restore(F.col("fim.output"), F.col("fim.form"))
    return cut.select(
        "doc_id",
        "fim.n",
        "fim.form",
        F.col("fim.prefix").alias("prefix_chars"),
        F.col("fim.middle").alias("middle_chars"),
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_url_reputation, op3_byte_bpe, op4_quality_rules, op5_token_counts, op6_fingerprints, op7_mixing, op8_substring_dedup, op9_pii, op10_simhash, op11_conversation_repair, op12_sharding, op13_fill_middle)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP7_SQL = f"""WITH s AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
  t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
  w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS clamp, 1.5::DOUBLE * (SELECT sum(source_size) FROM t) AS total FROM t),
  l AS (SELECT *, (total - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  water AS (SELECT level FROM l WHERE level * weight < clamp ORDER BY clamp / weight, source NULLS LAST LIMIT 1),
  g AS (SELECT source, source_size, coalesce(least(clamp, (SELECT level FROM water) * weight), clamp) AS target FROM l),
  r AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, sum(size) OVER (PARTITION BY s.source ORDER BY md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS run
    FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
  SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN size > 0 AND run - size / 2 < target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r"""

_OP8_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM i), f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (gram) WHERE first < doc_id),
  u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _shrunk(name: str, children: str, parents: str, key: str) -> str:
    """Two tables of a level: ``name``_j (children with their parent's mean) and ``name`` (with a and b)."""
    on = " AND ".join(f"c.{k} = p.{k}" for k in key.split(", "))
    low, high = url_reputation.CONCENTRATION
    return f"""{name}_j AS (SELECT c.*, p.mean FROM {children} c JOIN {parents} p ON {on}),
  {name}_f AS (SELECT {key}, sum(CASE WHEN n > 0 THEN n * pow(k / n - mean, 2) END) AS v, sum(n) AS pages, count(*) FILTER (n > 0) AS groups, first(mean) AS m FROM {name}_j GROUP BY {key}),
  {name}_s AS (SELECT {key}, CASE WHEN groups < 2 OR pages <= groups THEN {low} WHEN (v / (m * (1 - m)) - groups) / (pages - groups) <= 0 THEN {high}
    ELSE least({high}, greatest({low}, 1 / ((v / (m * (1 - m)) - groups) / (pages - groups)) - 1)) END AS s FROM {name}_f),
  {name} AS (SELECT j.*, s * mean + k AS a, s * (1 - mean) + n - k AS b FROM {name}_j j JOIN {name}_s USING ({key}))"""


_OP2_SQL = f"""WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
  o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
  c AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM p LEFT JOIN o ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/0-9]*$', 1), '') AS BIGINT) GROUP BY 1),
  sx AS (SELECT *, CASE {" ".join(f"WHEN host LIKE '%.{x}' THEN '{x}'" for x in URL_SUFFIXES)} ELSE split_part(host, '.', -1) END AS suffix FROM c),
  tree AS (SELECT host, suffix, CASE WHEN length(host) <= length(suffix) THEN host ELSE split_part(substr(host, 1, length(host) - length(suffix) - 1), '.', -1) || '.' || suffix END AS domain, n, k FROM sx),
  dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM tree GROUP BY 1, 2), tp AS (SELECT suffix, '' AS root, sum(n) AS n, sum(k) AS k FROM dm GROUP BY 1),
  root AS (SELECT '' AS root, (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM tp), {_shrunk("tops", "tp", "root", "root")}, tm AS (SELECT suffix, a / (a + b) AS mean FROM tops),
  {_shrunk("doms", "dm", "tm", "suffix")}, hm AS (SELECT domain, suffix, a / (a + b) AS mean FROM doms), {_shrunk("hosts", "tree", "hm", "domain, suffix")},
  hz AS (SELECT host, a, b, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) AS h, {(url_reputation.Z**2 - 3) / 6} AS y FROM hosts),
  wz AS (SELECT *, CASE WHEN a > 1 AND b > 1 AND h + y > 0 THEN {url_reputation.Z} * sqrt(h + y) / h - (1 / (2 * b - 1) - 1 / (2 * a - 1)) * (y + 5.0::DOUBLE / 6 - 2 / (3 * h)) END AS w FROM hz),
  bound AS (SELECT host, CASE WHEN a <= 1 THEN 0 WHEN w IS NULL THEN greatest(0, a / (a + b) - {url_reputation.Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) ELSE a / (a + b * exp(2 * w)) END AS lower FROM wz),
  fits AS (SELECT p.*, lower, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p JOIN bound USING (host))
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower > {url_reputation.MAX_BAD_RATE} THEN 'block' ELSE 'allow' END AS verdict FROM fits"""

_OP13_SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
  d AS (SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS c, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS e, CAST('0x' || x[17:24] AS BIGINT) % 100 AS rate, CAST('0x' || x[25:32] AS BIGINT) % 100 AS way FROM h),
  f AS (SELECT *, least(c, e) AS a, greatest(c, e) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR rate >= 90 THEN 'plain' WHEN way < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
#: The other operators hash, tokenise or learn in ways that SQL lacks; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op2_url_reputation": _OP2_SQL, "op7_mixing": _OP7_SQL, "op8_substring_dedup": _OP8_SQL, "op13_fill_middle": _OP13_SQL}
