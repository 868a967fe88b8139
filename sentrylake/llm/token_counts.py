"""Token counts by a map-side two-tier lookup.

A piece tokenizer marks the start of a word by U+2581 in place of a space, and
no piece of its vocabulary has that sign behind another character.  So no merge
crosses the border between a character and a following space, and the count of
a text is the sum of the counts of its pre-tokens: a run of spaces with the
non-spaces behind it.

Tier one is a hash table of frequent pre-tokens and their lengths, gathered from
a bounded sample of documents and broadcast; ``max_entries`` bounds its size.
Tier two is a cache in each worker: a pre-token that the table lacks is encoded
once and then remembered, up to ``cache_entries``, after which the cache starts
anew.  Both only save work: every whole text is counted, in the task that read
it, and no pre-token is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Signs for spaces and what follows up to the next.
PRE_TOKEN = "▁*[^▁]+|▁+"
MAX_ENTRIES = 50_000
CACHE_ENTRIES = 500_000
SAMPLE_DOCS = 2_000
#: A longer pre-token is encoded each time, so that a cache of few entries cannot grow large.
MAX_CACHED_CHARS = 64


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def check_model(path: str) -> None:
    """Raise ValueError unless the model lets a text be counted by pre-tokens."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("the model's normaliser changes texts across pre-tokens")
    if any("▁" in p.piece.lstrip("▁") for p in model.pieces):
        raise ValueError("the model has pieces that cross a space")
    if any(p.type == p.USER_DEFINED for p in model.pieces):
        raise ValueError("the model has user-defined pieces, which may cross a space")


class _Lengths(dict):
    """Pre-token to its number of tokens; a miss is encoded and kept."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.table, self.encode = table, _processor(path).encode

    def __missing__(self, pre: str) -> int:
        # the library puts one sign in front of what it is given
        n = len(self.encode(pre[1:])) if len(pre) > 1 else len(self.encode("a" + pre)) - len(self.encode("a"))
        if len(pre) <= MAX_CACHED_CHARS:
            if len(self) >= len(self.table) + CACHE_ENTRIES:
                self.clear()
                self.update(self.table)
            self[pre] = n
        return n


def _pre_tokens():
    import re

    split = re.compile(PRE_TOKEN).findall
    # the sign in front of the whole text, as the library adds it; an empty text stays empty
    return lambda text: split(("▁" + text).replace(" ", "▁")) if text else []


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", max_entries: int = MAX_ENTRIES, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample_docs`` documents and their lengths, at most ``max_entries``.

    Each task counts its own part of the sample and returns its most frequent;
    all tasks together return at most eight times ``max_entries`` rows, and
    nothing is shuffled.  The sample only decides what is looked up first.
    """
    n = docs.count()
    if not n:
        return {}
    part = 1_000_000
    share = min(part, -(-sample_docs * part // n))
    texts = docs.select(text_or_empty(text_col).alias("t"))
    of_task = max(1, 8 * max_entries // max(1, texts.rdd.getNumPartitions()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, seen = _pre_tokens(), Counter()
        for batch in batches:
            for text in batch["t"]:
                seen.update(w for w in split(text) if len(w) <= MAX_CACHED_CHARS)
        top = [(w, c) for w, c in seen.most_common(of_task) if c > 1]
        yield pd.DataFrame({"pre": [w for w, _ in top], "n": [c for _, c in top]}, columns=["pre", "n"]).astype({"pre": object, "n": "int64"})

    sample = texts.where(F.pmod(F.xxhash64("t"), F.lit(part)) < share)
    total: Counter[str] = Counter()
    for row in sample.mapInPandas(count, "pre string, n long").collect():
        total[row["pre"]] += row["n"]
    lengths = _Lengths(path, {})
    return {w: lengths[w] for w, _ in total.most_common(max_entries)}


def token_counts(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    max_entries: int = MAX_ENTRIES,
    sample_docs: int = SAMPLE_DOCS,
) -> Column:
    """The number of tokens of each whole text as a column of ``docs``, without begin, end or added special tokens.

    A null text counts as empty and has no tokens.  Strings that look like
    special tokens are ordinary text, as in the library.
    Repeated rows and copies get equal counts; over an empty table nothing is counted.
    """
    check_model(path)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col, max_entries, sample_docs))

    @F.pandas_udf("long")
    def count_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, lengths = _pre_tokens(), _Lengths(path, table.value)
        look_up = lengths.__getitem__
        for texts in batches:
            yield pd.Series([sum(map(look_up, split(t))) for t in texts], index=texts.index, dtype="int64")

    return count_tokens(text_or_empty(text_col))
