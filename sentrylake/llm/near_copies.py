"""Near copies by exact resemblance: pairs of texts that share most of their shingles.

The resemblance of two texts is the Jaccard index of their sets of shingles.
Candidates come from the SimHash operator: links of fingerprints within its radius,
found by BK-trees over shards.  Texts that resemble may differ in more bits than a tree
can be searched for (at 0.8 about 13 of 64), so there are candidates by MinHash too:
``BANDS`` bands of ``ROWS`` minima each, and texts
that agree in all minima of a band meet in its bucket.  A pair of resemblance s
shares no bucket with probability ``(1 - s^ROWS)^BANDS``: 5e-8 at 0.8, less above.
Every candidate is then compared by the shingles themselves, so what is linked
resembles.  Of the links in a bucket, a spanning forest is returned; the
components of all forests are those of all links.

Texts with the same set of shingles are one member of a bucket, and of buckets
with the same members one is searched, so copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpointed
from ..functions.components import connected_components
from .common import LOWER, UPPER
from .simhash import RADIUS, links, majority

WIDTH = 5
RESEMBLANCE = 0.8
SEED = 42
BANDS, ROWS = 32, 4


def _all_hashes(text: str | None, width: int, seed: int):
    """The XXH64 of a text's shingles, repeats included, as numpy uint64."""
    import numpy as np
    from xxhash import xxh64_intdigest

    lower = bytes.maketrans(UPPER.encode(), LOWER.encode())
    # bytes.split cuts at exactly the white space of the contract
    words = text.encode("utf-8", "surrogatepass").translate(lower).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    last = ends[width - 1 :] or ends[-1:]
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip([0, *(e + 1 for e in ends)], last)], dtype=np.uint64)


def _shingle_hashes(text: str | None, width: int, seed: int):
    """The different ones of ``_all_hashes`` in ascending order."""
    import numpy as np

    return np.unique(_all_hashes(text, width, seed))


def shingle_set(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """The different hashes of a text's shingles as binary: 8 bytes each, ascending.

    A-Z are lower-cased.  Shingles are ``width`` words joined by a space; fewer
    words give one shingle, none (or null) the empty set.
    """

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_shingle_hashes(t, width, seed).tobytes() for t in texts], index=texts.index, dtype=object)

    return of(text)


def signature(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """Struct (sk, fp, bands): a hash of the set of shingles, their SimHash, and a hash of the minima of each band."""

    @F.pandas_udf("sk long, fp long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from xxhash import xxh64_intdigest

        rng = np.random.default_rng(seed)
        odd, plus = rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
        odd |= np.uint64(1)
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        for texts in batches:
            keys, fps, bands = [], [], []
            for text in texts:
                hashes = _all_hashes(text, width, seed)
                fps.append(majority(hashes))
                hashes = np.unique(hashes)
                least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(hashes), 512):
                    part = hashes[i : i + 512, None] * odd
                    part += plus
                    np.minimum(least, part.min(axis=0), out=least)
                keys.append(signed(xxh64_intdigest(hashes.tobytes(), seed)))
                rows = least.reshape(BANDS, ROWS)
                bands.append([signed(xxh64_intdigest(rows[b].tobytes(), b)) for b in range(BANDS)])
            yield pd.DataFrame({"sk": pd.Series(keys, dtype="int64"), "fp": pd.Series(fps, dtype="int64"), "bands": pd.Series(bands, dtype=object)})

    return of(text)


def resembling_forest(members: Iterator[tuple[int, bytes]], at_least: float) -> Iterator[tuple[int, int]]:
    """Links that join what resembles among different ``members``: one fewer than members in each component."""
    import numpy as np

    parts: dict[int, list[frozenset]] = {}
    head = {}
    for key, data in members:
        x = frozenset(np.frombuffer(data, np.uint64).tolist())
        linked = []
        for part, sets in parts.items():
            # one link to a component is enough, all of its members are tried until then; the latest first
            for y in reversed(sets):
                small, large = sorted((len(x), len(y)))
                if small >= at_least * large and (n := len(x & y)) >= at_least * (len(x) + len(y) - n):
                    linked.append(part)
                    break
        for part in linked:
            yield head[part], key
        if not linked:
            parts[key], head[key] = [x], key
            continue
        into = max(linked, key=lambda part: len(parts[part]))
        for part in linked:
            if part != into:
                parts[into] += parts.pop(part)
        parts[into].append(x)


def bucket_members(texts: DataFrame) -> DataFrame:
    """(band, value, sk) of the buckets with two members or more, one of those with the same members.  texts: (sk, bands), each sk once."""
    keyed = texts.select("sk", F.posexplode("bands").alias("band", "value"))
    member = F.xxhash64("sk")
    counted = keyed.groupBy("band", "value").agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.sum(member.cast("decimal(38,0)")).alias("s"), F.min("sk").alias("a"), F.max("sk").alias("b"))
    chosen = counted.where("n > 1").groupBy("n", "x", "s", "a", "b").agg(F.min(F.struct("band", "value")).alias("k")).select("k.band", "k.value")
    return keyed.join(chosen, ["band", "value"], "left_semi")


def simhash_members(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(band, value, sk): a bucket of two for each candidate by SimHash.  texts: (sk, fp), each sk once.

    A text meets the least one of its fingerprint, and the least ones of two linked fingerprints meet.
    """
    heads = checkpointed(texts.groupBy("fp").agg(F.min("sk").alias("head")))
    same = texts.join(heads, "fp").where("sk <> head").select(F.col("head").alias("a"), F.col("sk").alias("b"))
    near = links(heads.select("fp"), radius).join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
    pairs = same.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return pairs.select(F.lit(BANDS).alias("band"), F.xxhash64("a", "b").alias("value"), F.explode(F.array("a", "b")).alias("sk"))


def forests(members: DataFrame, sets: DataFrame, at_least: float = RESEMBLANCE) -> DataFrame:
    """(src, dst) of each bucket's forest.  members: (band, value, sk), sets: (sk, shingles), each sk once."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, here = None, []

        def found() -> list[tuple[int, int]]:
            return list(resembling_forest(iter(here), at_least))

        for batch in batches:
            out: list[tuple[int, int]] = []
            for band, value, sk, data in zip(*(batch[c].tolist() for c in ("band", "value", "sk", "shingles"))):
                if (band, value) != key:
                    out += found()
                    key, here = (band, value), []
                here.append((sk, data))
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")
        yield pd.DataFrame(found(), columns=["src", "dst"], dtype="int64")

    # groups may span batches, so each task reads its buckets in order
    dealt = members.join(sets, "sk").select("band", "value", "sk", "shingles").repartition("band", "value").sortWithinPartitions("band", "value", "sk")
    return dealt.mapInPandas(search, "src long, dst long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = RESEMBLANCE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as (id, tk, group): rows of one group are joined by links of texts that resemble.

    tk: XXH64 of the text.  Texts without words resemble one another.  Repeated rows stay and are alike.
    A null id is kept as one; an empty table gives an empty table.
    """
    signed = signature(F.col(text_col), width, seed)
    marked = checkpointed(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), signed.alias("s")).select("id", "tk", "s.sk", "s.fp", "s.bands"))
    one = checkpointed(marked.groupBy("sk").agg(F.first("bands").alias("bands"), F.min("fp").alias("fp"), F.min("tk").alias("tk")))
    members = checkpointed(simhash_members(one.select("sk", "fp")).unionByName(bucket_members(one.select("sk", "bands"))))
    # shingles are made again for the texts that met another: one text for each set
    needed = one.select("sk", "tk").join(members.select("sk").distinct(), "sk", "left_semi")
    texts = docs.select(F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text")).join(needed, "tk").dropDuplicates(["sk"])
    edges = checkpointed(forests(members, texts.select("sk", shingle_set(F.col("text"), width, seed).alias("shingles")), at_least))
    parts = connected_components(edges).select(F.col("node").alias("sk"), F.col("component").alias("part"))
    return marked.join(parts, "sk", "left").select(F.col("id").alias(id_col), "tk", F.coalesce("part", "sk").alias("group"))
