"""Word vectors by skip-grams, trained part by part: no task and no driver holds more words than a part has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A document's words in a row, a part's words, and the words that take a step together.
PIECE, PART, BLOCK = 1000, 2_000_000, 2048


def pieces(docs: DataFrame, tokens_col: str, window: int) -> DataFrame:
    """(tokens, lead): documents in rows of ``PIECE`` words, behind the ``lead`` words before them that are in their first word's window."""
    docs = docs.select(F.array_compact(tokens_col).alias("t")).where(F.size("t") > 0)
    starts = docs.select("t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / PIECE).cast("int"))).alias("i"))
    starts = starts.select("t", (F.col("i") * PIECE).alias("at")).withColumn("lead", F.least("at", F.lit(window)))
    return starts.select(F.slice("t", F.col("at") - F.col("lead") + 1, F.col("lead") + PIECE).alias("tokens"), "lead")


def start_vectors(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A row for each word, which only the word and the seed decide: a word starts in the same place in all parts."""
    rows = np.empty((len(words), size), np.float32)
    for i in range(size):
        rows[:, i] = (pd.util.hash_array(words, hash_key=f"{seed % 10**8:08d}{i:08d}", categorize=False) / 2.0**64 - 0.5) / size
    return rows


def _places(words: np.ndarray, size: int) -> np.ndarray:
    """Where the words' numbers lie in a table's memory: a row for each of ``size`` numbers, as numpy is fast along rows."""
    return words * size + np.arange(size)[:, None]


def _move(table: np.ndarray, seen: np.ndarray, words: np.ndarray, places: np.ndarray, step: np.ndarray, rate: float) -> None:
    """Steps of words are added up, shortened by what their words have moved before, as words with many rows would overshoot else."""
    np.add.at(seen, words, np.einsum("ij,ij->j", step, step))
    step *= rate / np.sqrt(seen[words])
    np.add.at(table, places.ravel(), step.ravel())


def train(words: np.ndarray, piece: np.ndarray, lead: np.ndarray, vectors: np.ndarray, window: int, negatives: int, rate: float, seed: int) -> None:
    """Moves ``vectors`` by one pass over ``words`` (numbers of rows), in blocks.

    A word is to be told from ``negatives`` random ones by each word in its
    window, which counts the less the farther it is.  The known number of
    negatives is taken off the odds, so that vectors start without a drift they
    would share.  Pairs of two ``lead`` words are those of another piece.
    """
    draw, (rows, size) = np.random.default_rng(seed), vectors.shape
    vectors = vectors.reshape(-1)
    others = np.zeros_like(vectors)
    seen, seen_others = np.ones(rows, np.float32), np.ones(rows, np.float32)
    noise = draw.permutation(words)
    padded, piece, lead = np.pad(words, window), np.pad(piece, window, constant_values=-1), np.pad(lead, window)
    # by distance, the weight of a place and the one behind it; and what a place is in pairs with others
    behind = [((piece[o:] == piece[:-o]) & ~(lead[o:] & lead[:-o])) * np.float32(1 - (o - 1) / window) * (piece[o:] >= 0) for o in range(1, window + 1)]
    pairs = np.zeros(len(padded), np.float32)
    for o, weight in enumerate(behind, 1):
        pairs[o:] += weight
        pairs[:-o] += weight
    for at in range(0, len(words), BLOCK):
        n = min(BLOCK, len(words) - at)
        near, core = padded[at : at + n + 2 * window], slice(window, window + n)
        # the block's n words, and random ones for each
        told = np.concatenate([near[core], noise.take(np.arange(at * negatives, (at + n) * negatives), mode="wrap")])
        from_x, from_y = _places(near, size), _places(told, size)
        x, y = vectors.take(from_x), others.take(from_y)
        dx, dy = np.zeros_like(x), np.zeros_like(y)
        for o in range(1, window + 1):
            for there, first in ((window + o, at + window), (window - o, at + window - o)):
                there = slice(there, there + n)
                g = behind[o - 1][first : first + n] / (1 + np.exp(np.einsum("ij,ij->j", x[:, there], y[:, :n])) / negatives)
                dy[:, :n] += g * x[:, there]
                dx[:, there] += g * y[:, :n]
        for i in range(1, negatives + 1):
            k = slice(i * n, (i + 1) * n)
            g = pairs[at + window : at + window + n] / (1 + negatives * np.exp(-np.einsum("ij,ij->j", x[:, core], y[:, k])))
            dy[:, k] = -g * x[:, core]
            dx[:, core] -= g * y[:, k]
        _move(others, seen_others, told, from_y, dy, rate)
        _move(vectors, seen, near, from_x, dx, rate)


def trained_parts(rows: DataFrame, size: int, window: int, negatives: int, rate: float, seed: int) -> DataFrame:
    """(word, times, v): each partition of ``pieces`` trained for itself; a word's vector there and its number of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lengths, leads = [], [], []
        for batch in batches:
            if batch.num_rows:
                # a batch's words become numbers before the next one comes
                tokens.append(batch["tokens"].flatten().dictionary_encode())
                lengths.append(np.diff(batch["tokens"].offsets.to_numpy()))
                leads.append(batch["lead"].to_numpy())
        if not tokens:
            return
        tokens = pa.chunked_array(tokens).unify_dictionaries()
        numbers = np.concatenate([c.indices.to_numpy() for c in tokens.chunks]).astype(np.int64)
        words, lengths = tokens.chunk(0).dictionary, np.concatenate(lengths)
        piece = np.repeat(np.arange(len(lengths)), lengths)
        lead = np.arange(len(piece)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat(np.concatenate(leads), lengths)
        vectors = start_vectors(words.to_numpy(zero_copy_only=False), size, seed)
        train(numbers, piece, lead, vectors, window, negatives, rate, seed)
        times = np.bincount(numbers[~lead], minlength=len(words))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * size), pa.array(vectors.ravel()))
        out = pa.table({"word": words, "times": times, "v": flat}).filter(pa.array(times > 0))
        yield from out.to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, "word string, times long, v array<float>")
