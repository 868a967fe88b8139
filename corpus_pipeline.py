"""A corpus pipeline of five stages.  Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.checkpoints import stored
from sentrylake.llm import mixing, near_copies, pii, quality
from sentrylake.llm.common import free_name, n_words
from sentrylake.llm.queries import bpe_digests


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rejects go.

    Null, empty and blank texts have no words and go; repeated rows are judged
    alike and stay or go together; texts of any length are judged as a whole.
    """
    flag = free_name(docs, "quality_kept")
    # the operator replaces a column named quality, so it gets the columns that it reads
    judged = quality.judge(docs.select(F.struct(*docs.columns).alias("row"), "lang", "text"))
    return judged.withColumn(flag, F.col("quality.kept")).where(flag).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, resemblance of 0.8) the document with the least id stays (and of its repeated rows one).

    Texts without words are one group.  A null id is greater than all others.
    Texts of any length are compared as a whole.
    """
    found = near_copies.near_copies(docs.select("doc_id", "text")).withColumn("_null", F.col("doc_id").isNull())
    head = F.min(F.struct("_null", "doc_id", "tk")).alias("head")
    of, at = free_name(docs, "head_id"), free_name(docs, "head_text")
    heads = found.groupBy("group").agg(head).select(F.col("head.doc_id").alias(of), F.col("head.tk").alias(at))
    tk = free_name(docs, "text_key")
    kept = docs.withColumn(tk, F.xxhash64("text")).join(heads, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(tk) == F.col(at)), "left_semi")
    return kept.dropDuplicates(["doc_id", tk]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and telling terms are replaced in the text; n_chars follows.

    Null and empty texts and texts without spans stay as they are, repeated rows
    stay and are alike, texts of any length are searched as a whole.
    """
    found = pii.find(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    clean = F.struct(pii.redact(F.col("text"), F.col("pii")).alias("text"), (F.size("pii") > 0).alias("changed"))
    found = found.select("row", clean.alias("clean"))
    new = {"text": F.col("clean.text"), "n_chars": F.when(F.col("clean.changed"), F.char_length("clean.text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice.

    Sizes are words, so null, empty and blank texts are taken in whole
    repetitions only; a null source is a source.  Of repeated rows of one id and
    text each is taken as often as the one that is taken most.  Texts of any
    length only count by their words.
    """
    key, of, at, copies = (free_name(docs, f"mix_{n}") for n in ("text", "id", "key", "copies"))
    marked = docs.withColumn(key, F.xxhash64("text"))
    sized = marked.select("doc_id", "source", F.col(key).alias("key"), n_words(F.col("text")).alias("size"))
    taken = mixing.mix(sized, "doc_id").where("copies > 0").groupBy(F.col("doc_id").alias(of), F.col("key").alias(at)).agg(F.max("copies").alias(copies))
    joined = marked.join(taken, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(at)))
    repeats = free_name(docs, "mix_n")
    return joined.withColumn(repeats, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to.

    Null and empty texts have no tokens; repeated rows stay and are alike, texts of
    any length are encoded as a whole, other columns are not looked at, and an
    empty table gives an empty table.
    """
    return bpe_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]
#: Hashes, near copies and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds a whole run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
