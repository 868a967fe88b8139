"""The pipeline against a plain version over a whole table, and its near-duplicates over planted rows."""

import base64
import random

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sentrylake.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents of 100 words, copies with one to five words changed, and a family of copies."""
    rng, vocabulary = random.Random(7), [f"w{i}" for i in range(4_000)]
    texts = [prose(rng, 100, vocabulary) for _ in range(60)]
    copies = []
    for i, w in enumerate(texts[:50]):
        w = list(w)
        for at in rng.sample(range(100), 1 + i % 5):
            w[at] = f"edit{i}x{at}"
        copies.append(w)
    for k in range(40):
        w = list(texts[55])
        w[99 - k] = f"family{k}"
        copies.append(w)
    rows = [(1_000 + i, " ".join(w), "en", "a", 0) for i, w in enumerate(texts)] + [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(copies)]
    rows += [(5_000, " ".join(texts[59]).upper(), "en", "a", 0), (5_001, None, None, None, 0), (5_002, "", None, None, 0), (5_003, "two words", "en", "a", 0), (None, "two words", "en", "a", 0)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder, {r[0]: r[1] for r in rows if r[0] is not None}


def test_near_dedup_finds_edited_copies(spark, planted):
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect())
    assert kept == sorted(set(plain.resembling(texts).values()))
    # one or two of 100 words changed leave five-word resemblance above 0.8, three do not; the family and the upper-cased copy are one each
    assert len(kept) == 92


def test_near_copies_keeps_rows_and_what_does_not_resemble(spark, planted):
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = near_copies.near_copies(docs).collect()
    assert len(rows) == docs.count()
    groups, want = {}, {}
    for r in rows:
        groups.setdefault(r["group"], set()).add(r["doc_id"])
    for i, least in plain.resembling(texts).items():
        want.setdefault(least, set()).add(i)
    assert sorted(sorted(g - {None}) for g in groups.values()) == sorted(map(sorted, want.values()))


def test_whole_run_against_a_plain_version(spark, sf):
    """Each stage by loops over the whole table: verdicts, all pairs, all terms, water-filling, the library's ids."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verdicts = plain.divergence([(r["text"], r["lang"]) for r in docs.values()])
    texts = {i: docs[i]["text"] for (i, _), v in zip(docs.items(), verdicts) if v[2]}
    heads = sorted(set(plain.resembling(texts).values()))
    found = plain.disclosed([texts[i] for i in heads])
    clean = {i: plain.redact(texts[i], found[texts[i]]) for i in heads}
    copies = plain.mixed({i: (docs[i]["source"], len(plain.words(t))) for i, t in clean.items()})
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = []
    for i, n in copies.items():
        ids = encode(clean[i]) if n else []
        want += [(i, len(ids), plain.sha(np.asarray(ids, "<u4").tobytes()), plain.sha(clean[i]))] * n
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert len(texts) < len(docs) and len(heads) < len(texts) and any(found[texts[i]] for i in heads)
    assert sorted(got) == sorted(want)


def test_candidates_come_from_simhash_too(spark, planted):
    """The links of the SimHash operator are candidates, and what it finds that does not resemble is no link."""
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    signed = docs.select(near_copies.signature(F.col("text")).alias("s"), simhash.fingerprints(F.col("text"), near_copies.WIDTH).alias("fp"))
    assert signed.where("s.fp <> fp").count() == 0
    one = signed.select("s.sk", "s.fp").distinct()
    # the least text of each fingerprint, and of each pair of linked fingerprints
    members = near_copies.simhash_members(one).groupBy("value").agg(F.sort_array(F.collect_set("sk")).alias("sks")).collect()
    assert members and all(len(r["sks"]) == 2 for r in members)
    found = {tuple(r["sks"]) for r in members}
    fp = dict(map(tuple, one.collect()))
    assert all((fp[a] ^ fp[b]) & 0xFFFFFFFFFFFFFFFF == 0 or ((fp[a] ^ fp[b]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= simhash.RADIUS for a, b in found)
