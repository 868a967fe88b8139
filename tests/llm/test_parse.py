"""The relative Lempel-Ziv parse: factors against blocks, and what is removed without it."""

import random

import plain
import pytest

from sentrylake.llm import substring_dedup
from sentrylake.llm.substring_dedup import Block, joined_factors

SCHEMA = "doc_id long, text string, dedup_id string, dedup_cut string, at int, id string"


def test_greedy_factors_are_the_longest_and_cross_boundaries():
    block = Block(b"a b c d e f g h c d e x y".split(), 3)
    # from c on the longer of two occurrences; at its end the seeds across the boundary are looked up
    assert list(block.factors(b"c d e x y q b c d h c d e".split())) == [(0, 5, 8), (6, 3, 1), (9, 4, 7)]
    assert list(block.factors(b"c d e f g h c".split())) == [(0, 7, 2)]
    assert list(block.factors(b"a b".split())) == []
    assert joined_factors([(0, 5, 7, 10), (3, 9, 7, 13), (8, 12, 6, 1)]) == [(0, 9, 7, 10), (8, 12, 6, 1)]


def planted():
    rng = random.Random(4)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, short = draw(90), draw(12)
    texts = [draw(700) for _ in range(6)]
    texts += [draw(20) + passage + draw(20) for _ in range(30)] + [draw(5) + short + draw(5) for _ in range(5)]
    texts += [draw(9) + texts[i][100 * i : 100 * i + 400] + passage[:40] + draw(9) for i in range(4)]
    texts += [["same"] * 3000, ["same"] * 40 + draw(3), draw(2) + ["same"] * 700]
    return [(i * 3, " ".join(t), "x", "y", 1, "z") for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_words", [16, 256])
def test_factors_cover_what_is_removed(spark, block_words):
    rows = planted()
    got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA), block_words=block_words).collect()
    texts = {r[0]: r[1] for r in rows}
    want = plain.substring_dedup(texts)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
        words = plain.words(r["text"])
        for s in r["spans"]:
            ref = plain.words(texts[s["ref_id"]])
            assert s["ref_id"] < r["doc_id"] and s["stop"] - s["start"] >= 13
            assert words[s["start"] : s["stop"]] == ref[s["ref_start"] : s["ref_start"] + s["stop"] - s["start"]]
    # a passage over many blocks is one factor
    assert any(s["stop"] - s["start"] >= 300 for r in got for s in r["spans"])


def test_nothing_is_removed_without_the_parse(spark, monkeypatch):
    monkeypatch.setattr(Block, "factors", lambda self, words: iter(()))
    # workers unpickle the class by name, so the parse is taken out where it is called
    monkeypatch.setattr(substring_dedup, "_parse", lambda met, keys, refs, *_: met.sparkSession.createDataFrame([], "id long, start int, stop int, ref_id long, ref_start int"))
    assert {r["n_removed"] for r in substring_dedup.dedup(spark.createDataFrame(planted(), SCHEMA)).collect()} == {0}


def test_a_stretch_sent_in_vain_removes_nothing(spark):
    # as if the hashes of two different seeds agreed: the words decide
    met = spark.createDataFrame([(2, 1, 0, 0, bytearray(b"a b c d"), bytearray(b"a b x d"))], "id long, ref_id long, block int, start int, words binary, reference binary")
    assert substring_dedup._parse(met, ["id"], ["ref_id"], 3, 16).collect() == []


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup.dedup(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
