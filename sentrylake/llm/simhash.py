"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Two fingerprints of 64 bits that differ in at most r bits agree in at least
s - r of any s blocks of bits, so they share the value of some choice of s - r
blocks.  Each such choice and value is a shard, and every pair within the radius
meets in one.  A shard's fingerprints, all different, go into a BK-tree: a child
hangs on the edge numbered by its Hamming distance to the parent, and a search
within the radius follows only edges whose number is within the radius of the
distance to the node.  Of the links found, a shard returns a spanning forest;
the components of all forests are those of all links, and none is lost.

A shard above ``hot_shard`` fingerprints (a large family of near copies) is cut
again by a finer choice of blocks, by the same argument.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpointed
from ..functions.components import connected_components
from .common import LOWER, UPPER

WIDTH = 3
RADIUS = 3
SEED = 42
#: Blocks into which the bits are cut for shards, and for shards that are too large.
BLOCKS, FINE_BLOCKS = 5, 8
HOT_SHARD = 2_000


def majority(hashes) -> int:
    """The signed number whose bits are those set in more than half of ``hashes`` (numpy uint64); 0 without any."""
    import numpy as np

    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(weights[total * 2 > len(hashes)].sum(dtype=np.uint64).astype(np.int64))


def fingerprints(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """SimHash of a text as a long: bit b is 1 if it is set in more than half of the shingles' XXH64.

    A-Z are lower-cased.  Shingles are ``width`` words joined by a space, repeats
    included; fewer words give one shingle, none (or null) the fingerprint 0.
    """

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        from xxhash import xxh64_intdigest

        lower = bytes.maketrans(UPPER.encode(), LOWER.encode())
        for texts in batches:
            out = []
            for text in texts:
                # bytes.split cuts at exactly the white space of the contract
                words = text.encode("utf-8", "surrogatepass").translate(lower).split() if text else []
                if not words:
                    out.append(0)
                    continue
                line, ends, at = b" ".join(words), [], -1
                for w in words:
                    at += len(w) + 1
                    ends.append(at)
                starts = [0, *(e + 1 for e in ends)]
                last = ends[width - 1 :] or ends[-1:]
                out.append(majority(np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, last)], dtype=np.uint64)))
            yield pd.Series(out, index=texts.index, dtype="int64")

    return of(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


class BKTree:
    """Numbers of up to 64 bits by Hamming distance."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict]] = []

    def add(self, x: int) -> None:
        new = (x, {})
        if self.nodes:
            node = self.nodes[0]
            while True:
                d = (node[0] ^ x).bit_count()
                child = node[1].get(d)
                if child is None:
                    node[1][d] = new
                    break
                node = child
        self.nodes.append(new)

    def within(self, x: int, radius: int) -> Iterator[int]:
        """The numbers at most ``radius`` from x."""
        todo = self.nodes[:1]
        while todo:
            y, children = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                yield y
            if children:
                if len(children) <= 2 * radius + 1:
                    todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
                else:
                    todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]


def spanning_forest(members: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what is linked among different ``members``: one fewer than members in each component."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    components = 0
    for x in members:
        parent[x] = x
        components += 1
        for y in tree.within(x, radius):
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                components -= 1
                yield x, y
            # all that came before is one component and x is in it: more links tell nothing new
            if components == 1:
                break
        tree.add(x)


def _keys(fp: Column, blocks: int, radius: int) -> Column:
    """The shard keys of a fingerprint: the number of the choice and the value of the chosen blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).cast("short").alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*keys)


def _forests(shards: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(src, dst) of each shard's forest; shards: keys and fp, each fp once in a shard."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members = None, []

        def links() -> list[tuple[int, int]]:
            return list(spanning_forest(members, radius)) if len(members) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            for *here, fp in zip(*(batch[c].tolist() for c in (*keys, "fp"))):
                if here != key:
                    found += links()
                    key, members = here, []
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
            yield _edges(found)
        yield _edges(links())

    # groups may span batches, so each task reads its shards in order
    return shards.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(search, "src long, dst long")


def _edges(found: list[tuple[int, int]]) -> pd.DataFrame:
    import numpy as np

    pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})


def links(fps: DataFrame, radius: int = RADIUS, hot_shard: int = HOT_SHARD) -> DataFrame:
    """(src, dst): links of fingerprints within the radius that join all that is linked.  fps: different ones in column fp."""
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), BLOCKS, radius)).alias("s")).select("s.choice", "s.value", "fp")
    sizes = keyed.groupBy("choice", "value").count().where("count > 1")
    cold = keyed.join(sizes.where(F.col("count") <= hot_shard), ["choice", "value"], "left_semi")
    hot = keyed.join(sizes.where(F.col("count") > hot_shard), ["choice", "value"], "left_semi")
    # pairs that meet in a hot shard meet in some finer one as well, whatever the hot shard was
    fine = hot.select("fp").distinct().select("fp", F.explode(_keys(F.col("fp"), FINE_BLOCKS, radius)).alias("s")).select("s.choice", "s.value", "fp")
    return _forests(cold, ["choice", "value"], radius).unionByName(_forests(fine, ["choice", "value"], radius))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    width: int = WIDTH,
    seed: int = SEED,
    hot_shard: int = HOT_SHARD,
) -> DataFrame:
    """The rows of ``docs`` as (id, tk, fp, group, component).

    tk: XXH64 of the text; fp: its SimHash; group: the least fingerprint and
    component: the least id that links reach.  Documents with equal
    fingerprints are linked, those without words too.  Repeated rows stay and
    are alike.  A component is null only if all its ids are.
    Texts of any length are read as a whole.  Only the id and the text are looked
    at, so other columns may have any name; an empty table gives an empty table.
    """
    marked = checkpointed(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), fingerprints(F.col(text_col), width, seed).alias("fp")))
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    edges = checkpointed(links(least.select("fp"), radius, hot_shard))
    parts = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("part"))
    grouped = least.join(parts, "fp", "left").select("fp", "least", F.coalesce("part", "fp").alias("group"))
    of_group = grouped.groupBy("group").agg(F.min("least").alias("component"))
    final = grouped.select("fp", "group").join(of_group, "group").select("fp", "group", "component")
    return marked.join(final, "fp").select(F.col("id").alias(id_col), "tk", "fp", "group", "component")
