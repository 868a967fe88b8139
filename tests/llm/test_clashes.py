"""Every operator keeps columns whose names it uses itself, and the stages of the pipeline survive awkward rows."""

import re
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import bpe, mixing, near_copies, pii, quality, queries, simhash, sketches, substring_dedup, toxicity, url_reputation

LLM = Path(queries.__file__).parent
#: What stands in quotes or as the start of a name in the modules: every name that an operator could give to a column.
NAMES = sorted({n for f in [*LLM.glob("*.py"), Path(corpus_pipeline.__file__)] for n in re.findall(r'"(_?[a-z][a-z_]{0,18})"', f.read_text())} - {"doc_id", "text", "lang", "source", "n_chars", "url", "page_id", "html"})
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    prose = "the cat sat on the mat and the dog ran to the park with a red ball of wool for the child"
    rows = [(i, f"{prose} number {i} " * (1 + i % 3), ["en", "de"][i % 2], ["a", "b", None][i % 3], 9) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (22, " \n ", "en", "a", 3), (23, "w" * 80_000, "en", "a", 80_000), (24, "mail a.b@c.de now or never, again and again and over again", "en", "b", 57), rows[0], rows[3], (None, "no id " * 20, "en", "a", 120)]
    clash = [n for n in NAMES if n.lower() not in ("size", "toxic", "quality")]
    return spark.createDataFrame(rows, DOC).select("*", *(F.lit(f"own {n}").alias(n) for n in clash))


def kept(out, docs, new=()):
    """All rows are there, with the columns of ``docs`` unchanged, but for those that the operator's new ones replace."""
    assert not set(docs.columns) - set(out.columns)
    same = [c for c in docs.columns if c not in (*new, *DOC.replace(",", "").split())]
    row = out.select(*same).distinct().collect()
    assert len(row) == 1 and all(row[0][c] == f"own {c}" for c in same)


def test_names_are_found():
    assert len(NAMES) > 100 and {"target", "copies", "next_", "pii", "row"} <= set(NAMES)


@pytest.mark.parametrize("operator", ["bpe", "mix", "next", "quality", "pii", "dedup"])
def test_operators_keep_clashing_columns(spark, docs, operator):
    run = {
        "bpe": lambda: (bpe.encode(docs, public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.PATTERN, decoded_col="decoded"), ("ids", "decoded")),
        "mix": lambda: (mixing.mix(docs.withColumn("size", F.lit(5)), "doc_id"), ("size", "source_size", "target", "copies")),
        "next": lambda: (sketches.with_next(docs, "doc_id", ["text"]), ("next_text",)),
        "quality": lambda: (quality.judge(docs), ("quality",)),
        "pii": lambda: (pii.find(docs), ("pii",)),
        "dedup": lambda: (substring_dedup.dedup(docs), ("n_words", "n_removed", "kept", "spans")),
    }
    out, new = run[operator]()
    assert out.count() == docs.count()
    kept(out, docs, new)


@pytest.mark.parametrize("operator", ["simhash", "near_copies", "toxicity", "urls"])
def test_operators_that_return_their_own_columns(spark, docs, operator):
    if operator == "toxicity":
        labels = spark.createDataFrame([(i, i % 2, "x", "y") for i in range(12)], "doc_id long, toxic int, label string, text string")
        assert docs.select(toxicity.score(docs, toxicity.fit(docs, labels, max_labelled=100)).alias("score")).where("score between 0 and 1").count() == docs.count()
    elif operator == "urls":
        pages = docs.withColumn("url", F.lit("http://a.b/c")).withColumn("page_id", F.col("doc_id")).drop("host", "path", "bad")
        pages = pages.select("*", *(F.lit("x").alias(n) for n in ("host", "path", "bad", "rule", "verdict")))
        labels = spark.createDataFrame([(1, 1, "z")], "doc_id long, bad int, host string")
        assert url_reputation.judge(pages, labels, F.col("page_id"), F.col("bad")).count() == docs.count()
    else:
        find = simhash.near_duplicates if operator == "simhash" else near_copies.near_copies
        assert find(docs).count() == docs.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_survive_awkward_rows(spark, docs, name, stage):
    out = stage(spark, docs, "")
    assert out.count() >= 0
    if stage is not corpus_pipeline.byte_bpe:
        assert out.columns == docs.columns
        if out.count():
            kept(out, docs)
    assert stage(spark, docs.where("false"), "").collect() == []
