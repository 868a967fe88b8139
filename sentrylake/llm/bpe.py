"""Byte-level BPE over whole texts in overlapping chunks.

A text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own;
as a match of the pattern depends only on the text from its start on, two chunks
that both have a boundary at one place agree from there on.  The chunks are
stitched at the first such place of each overlap, and the pieces between the
stitches are encoded separately.  The end of a run of white space depends on
what is behind it (``\\s+(?!\\S)``), which a piece would not show; so a stitch lies
behind a character that is no white space.  Where the chunks do not agree within
their overlap (a pre-token longer than it), the overlap is widened step by step.

A text of up to ``spread_chars`` has its chunks, stitches and pieces in the worker that
reads it, without a shuffle.  A longer one is first cut in the same way into
chunks of that length, which different tasks pre-tokenise and encode.

Ids are kept as packed little-endian unsigned 32-bit integers, which take a
fifth of an array's room in a shuffle and can be hashed as they are.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed
from .common import free_name

CHUNK_CHARS, OVERLAP = 4_096, 256
#: Chunks of a text that several tasks share, and their overlap.
SPREAD_CHARS, SPREAD_OVERLAP = 65_536, 1_024
#: Overlaps that do not agree are widened by so much.
WIDER = 4
#: The longest look-ahead of the pattern: an apostrophe and two letters.
MARGIN = 3


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pack(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def _ends(match, part: str, is_last: bool) -> list[int]:
    """The boundaries of a chunk at which a piece may end, ascending, without those that the text behind the chunk may move."""
    ends = [m.end() for m in match.finditer(part)]
    if not is_last:
        # a match that touches the chunk's end, or ends too near to it, may go on beyond
        while ends and (ends[-1] == len(part) or ends[-1] + MARGIN > len(part)):
            ends.pop()
    return [b for b in ends if not part[b - 1].isspace()]


def _agree(left: list[int], right: list[int], by: int, within: int) -> int | None:
    """The first boundary of the right chunk that the left one has too.  by: where the right one starts in the left one."""
    if (i := bisect_left(left, by)) < len(left) and left[i] == by:
        return 0
    known = set(left[i:])
    return next((b for b in right if b < within and b + by in known), None)


def pieces(text: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[str]:
    """The pieces between the stitches of a text's chunks; the text itself if it is one chunk."""
    match, n = _matcher(pattern), len(text)
    cuts = range(chunk, n - overlap, chunk)
    if not cuts:
        return [text] if text else []

    def ends(at: int, wide: int) -> list[int]:
        return _ends(match, text[at : at + chunk + wide], at + chunk + wide >= n)

    starts, left = [0], ends(0, overlap)
    for at in cuts:
        right, wide = ends(at, overlap), overlap
        found = _agree(left, right, chunk, wide)
        while found is None and at + wide < n:
            wide *= WIDER
            found = _agree(ends(at - chunk, wide), ends(at, wide), chunk, wide)
        # a stitch beyond the next chunk's own one leaves that chunk without a piece
        starts.append(max(starts[-1], n if found is None else at + found))
        left = right
    return [text[a:b] for a, b in zip(starts, [*starts[1:], n]) if a < b]


def _binary(data: bytearray, ends: list[int]) -> pa.Array:
    """The values between ``ends`` (from 0 on) of what was joined, without a copy."""
    import numpy as np

    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.asarray(ends, np.int32)), pa.py_buffer(data)])


def _encode_column(path: str, pattern: str, decoded: bool, chunk: int, overlap: int):
    """A column of structs: the ids of a text and, if asked for, the bytes that they decode to.

    A batch's results are joined in one buffer each, so a worker holds them once.
    """

    def encoded(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, pattern)
        ids, id_ends, raw, raw_ends = bytearray(), [0], bytearray(), [0]
        for text in texts:
            for piece in pieces(text.as_py(), pattern, chunk, overlap):
                part = encoder.encode_ordinary(piece)
                ids += _pack(part)
                if decoded:
                    raw += encoder.decode_bytes(part)
            id_ends.append(len(ids))
            raw_ends.append(len(raw))
        fields = {"ids": _binary(ids, id_ends)} | ({"decoded": _binary(raw, raw_ends)} if decoded else {})
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    @F.arrow_udf("ids binary, decoded binary" if decoded else "ids binary")
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield encoded(texts)

    return encode_texts


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes of packed ``ids``: the tokens' bytes one after another.  Null gives null."""

    @F.pandas_udf("binary")
    def decode_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        to_bytes = _encoder(path, pattern).decode_bytes
        for packed in batches:
            yield pd.Series([None if p is None else to_bytes(np.frombuffer(p, "<u4").tolist()) for p in packed], index=packed.index, dtype=object)

    return decode_ids(ids)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, n, part): one row for each chunk of each different text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                yield pd.DataFrame(
                    {
                        "key": key,
                        "k": range(last + 1),
                        "n": len(text),
                        "part": [text[k * chunk : k * chunk + chunk + overlap] for k in range(last + 1)],
                    }
                )

    parts = long.mapInPandas(cut, "key string, k int, n long, part string")
    # copies of a text give equal chunks: one of them is enough, and map-side already
    return parts.groupBy("key", "k").agg(F.max("n").alias("n"), F.first("part").alias("part"))


def _stitches(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, k, start, stop, never): each chunk's piece of its text; never = true for a text with an overlap that does not agree."""

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = _matcher(pattern)
        for batch in batches:
            heads, tails = [], []
            for k, n, part in zip(batch["k"], batch["n"], batch["part"]):
                at, last = k * chunk, k * chunk + len(part) >= n
                ends = _ends(match, part, last)
                heads.append([at, *(at + b for b in ends if b < overlap)] if k else [])
                tails.append([] if last else [at + b for b in ends[bisect_left(ends, chunk) :]])
            yield pd.DataFrame({"key": batch["key"], "k": batch["k"], "n": batch["n"], "head": heads, "tail": tails})

    bounds = chunks.mapInPandas(pretokenise, "key string, k int, n long, head array<long>, tail array<long>")
    by_text = Window.partitionBy("key").orderBy("k")
    is_last = F.lead("k").over(by_text).isNull()
    return (
        bounds.withColumn("is_last", is_last)
        .withColumn("stop", F.when(F.col("is_last"), F.col("n")).otherwise(F.array_min(F.array_intersect("tail", F.lead("head").over(by_text)))))
        .withColumn("start", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("stop").over(by_text)))
        .withColumn("never", F.max(F.col("stop").isNull()).over(Window.partitionBy("key")))
        .select("key", "k", "start", "stop", "never")
    )


def encode_long_texts(long: DataFrame, path: str, pattern: str, spread: int, spread_overlap: int, chunk: int, overlap: int, decoded: bool = False) -> DataFrame:
    """(key, code) of every different text of (key, text); equal keys have equal texts.  code: ids and, if asked for, decoded.

    Texts with an overlap that does not agree are cut again with chunks and
    overlaps ``WIDER`` times as long, until none is left.
    """
    encode = _encode_column(path, pattern, decoded, chunk, overlap)
    chunks = _chunks(long, spread, spread_overlap)
    stitches = checkpointed(_stitches(chunks, pattern, spread, spread_overlap))
    found = chunks.join(stitches.where("not never"), ["key", "k"]).select(
        "key", "k", F.substring("part", F.col("start") - F.col("k") * spread + 1, F.col("stop") - F.col("start")).alias("piece")
    )
    names = ["ids", "decoded"] if decoded else ["ids"]

    def joined(name: str) -> Column:
        return F.aggregate("pieces", F.lit(b""), lambda all_, p: F.concat(all_, p["code"][name])).alias(name)

    parts = found.select("key", F.struct("k", encode("piece").alias("code")).alias("piece")).groupBy("key").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    stitched = parts.select("key", F.struct(*map(joined, names)).alias("code"))
    never = stitches.where("never").select("key").distinct()
    if never.isEmpty():
        return stitched
    rest = long.join(never, "key", "left_semi")
    return stitched.unionByName(encode_long_texts(rest, path, pattern, spread * WIDER, spread_overlap * WIDER, chunk, overlap, decoded))


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
    spread_chars: int = SPREAD_CHARS,
    spread_overlap: int = SPREAD_OVERLAP,
) -> DataFrame:
    """``docs`` and the packed token ids of each whole text, as the library's ``encode_ordinary`` gives them.

    path, pattern: the rank file and the pre-tokeniser's pattern.  decoded_col:
    if given, also the bytes that the ids decode to, made in the same worker.
    A null text counts as empty, an empty text has no ids (zero bytes).
    Repeated rows and copies stay and get equal ids; long copies are encoded
    once.  Every other column is kept, whatever its name; the new ones are
    replaced if they exist.  An empty table gives an empty table.
    """
    if min(overlap, spread_overlap) <= MARGIN or chunk_chars <= overlap or spread_chars <= spread_overlap:
        raise ValueError("chunks must be longer than their overlap, and that longer than the look-ahead")
    docs = docs.drop(*filter(None, (ids_col, decoded_col)))
    encode_text = _encode_column(path, pattern, decoded_col is not None, chunk_chars, overlap)
    is_long = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) > spread_chars
    key, code = free_name(docs, "text_key"), free_name(docs, "text_code")
    short = docs.where(~is_long).withColumn(code, encode_text(F.coalesce(F.col(text_col), F.lit(""))))
    long = docs.where(is_long).withColumn(key, F.sha2(F.col(text_col), 256))
    found = encode_long_texts(long.select(F.col(key).alias("key"), F.col(text_col).alias("text")), path, pattern, spread_chars, spread_overlap, chunk_chars, overlap, decoded_col is not None)
    rest = long.join(found.select(F.col("key").alias(key), F.col("code").alias(code)), key).drop(key)
    new = [F.col(f"{code}.ids").alias(ids_col)] + ([F.col(f"{code}.decoded").alias(decoded_col)] if decoded_col else [])
    return short.unionByName(rest).select(*docs.columns, *new)
