"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the documents with smaller ids.  These are
the reference, cut into blocks of ``block_words`` words.  Seeds are windows of
``width`` words: an index tells for each seed that more than one document has the
block in which its first occurrence lies (the least id's).  A document's stretches
are sent to the blocks that its seeds name, each stretch to one block, so a
document meets every block that can hold a part of it and no other.

There the stretch is parsed greedily against the block's text: at each place the
seed is looked up in the block, each occurrence is extended word by word, the longest
is a factor, and the parse goes on behind it.  At the boundary the seeds that
cross it are looked up as well, so the next factor may begin inside the last one.
Factors have ``width`` words at least and are the duplicate spans; those that go on
from one block to the next are joined.  Words are compared themselves, so a
hash that two seeds share sends a stretch in vain but removes nothing.

To keep unique text out of the index, anchors come first: of each window the
gram of ``anchor`` words with the least hash.  Equal windows have equal anchors,
so only windows whose anchor two different texts have can be in the index.
Exact copies of a text are settled before, by the text's MD5.

A seed that very many documents have is known by its anchor's count; its rows
are dealt to ``SALTS`` tasks, and its one row of the index goes to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpointed
from .common import free_name

WIDTH = 13
#: Words of an anchor.
ANCHOR = 5
#: Words of a block of the reference; it also holds the words behind it that its last seeds reach.
BLOCK_WORDS = 256
#: Seeds of an anchor with more rows than that are dealt to so many tasks.
HOT_ANCHOR, SALTS = 2_000, 64
#: Words that are hashed at once.
SLICE_WORDS = 400_000
#: Stands for a null id, which nothing refers to.
NO_ID = -(2**63)


def _split(text: str) -> list[bytes]:
    # bytes.split cuts at exactly the white space of the contract
    return text.encode("utf-8", "surrogatepass").split()


def _grams(h, n: int):
    """A hash of each run of n words from the words' hashes."""
    import numpy as np

    m = max(0, len(h) - n + 1)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k : k + m]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _windows(texts: list[str], width: int, anchor: int):
    """(document, place, window hash, anchor hash) of every window, in slices of documents.

    The words of a slice lie in one array; windows that reach from one document
    into the next are left out.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    sizes: list[int] = []
    begin = 0
    for i, text in enumerate(texts):
        words = _split(text)
        hashes += map(xxh64_intdigest, words)
        sizes.append(len(words))
        if len(hashes) < SLICE_WORDS and i + 1 < len(texts):
            continue
        h, ends = np.array(hashes, np.uint64), np.cumsum(sizes)
        if len(h) >= width:
            doc = np.repeat(np.arange(len(sizes)), sizes)
            m = len(h) - width + 1
            inside = np.flatnonzero(doc[:m] == doc[width - 1 :])
            g = _grams(h, anchor)
            least = g[:m].copy()
            for k in range(1, width - anchor + 1):
                np.minimum(least, g[k : k + m], out=least)
            own = doc[inside]
            yield begin + own, (inside - (ends - sizes)[own]).astype(np.int32), _grams(h, width)[inside], least[inside]
        hashes, sizes, begin = [], [], i + 1


def _anchors(docs: DataFrame, keys: list[str], width: int, anchor: int) -> DataFrame:
    """(a, copy, keys): each document's anchors, runs of one anchor once; copy is a hash of the text."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            values = {k: batch[k].to_numpy() for k in (*keys, "copy")}
            for doc, _, _, least in _windows(batch["text"].tolist(), width, anchor):
                if len(doc):
                    new = np.concatenate([[True], (np.diff(doc) != 0) | (least[1:] != least[:-1])]) & (values["id"][doc] != NO_ID)
                    yield pd.DataFrame({"a": least[new].view(np.int64), **{k: v[doc[new]] for k, v in values.items()}})

    return docs.mapInPandas(emit, "a long, copy long, " + _schema(keys))


def _schema(keys: list[str]) -> str:
    return ", ".join(f"{k} long" for k in keys)


def _seeds(docs: DataFrame, keys: list[str], width: int, anchor: int, block_words: int) -> DataFrame:
    """(w, at, block, salt, keys): the windows whose anchor is in the document's array ``shared``; salt 0 unless it is in ``hot``."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        def joined(arrays) -> np.ndarray:
            return np.unique(np.concatenate([np.asarray(s, np.int64) for s in arrays]))

        for batch in batches:
            values = {k: batch[k].to_numpy() for k in keys}
            for doc, at, w, least in _windows(batch["text"].tolist(), width, anchor):
                if len(doc):
                    # an anchor that is shared is so in every document
                    here, least = slice(doc[0], doc[-1] + 1), least.view(np.int64)
                    mine = np.isin(least, joined(batch["shared"].iloc[here]))
                    doc, at, w, least = doc[mine], at[mine], w[mine].view(np.int64), least[mine]
                    ids = values["id"][doc]
                    salt = np.where(np.isin(least, joined(batch["hot"].iloc[here])), 1 + (ids * 31 + at // 16) % SALTS, 0)
                    yield pd.DataFrame({"w": w, "at": at, "block": at // block_words, "salt": salt.astype(np.int32), **{k: v[doc] for k, v in values.items()}})

    return docs.mapInPandas(emit, "w long, at int, block int, salt int, " + _schema(keys))


def _stretches(hits: DataFrame, keys: list[str], refs: list[str], width: int) -> DataFrame:
    """(refs, block, keys, start, words): what each document sends to each block.  hits: keys, text and arrays at, block and refs."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*refs, "block", *keys, "start", "words")}
            for i, (text, at) in enumerate(zip(batch["text"], batch["at"])):
                words = _split(text)
                columns = [np.asarray(batch[c].iloc[i]) for c in (*refs, "block")]
                order = np.lexsort((at, *columns))
                at, columns = np.asarray(at)[order], [c[order] for c in columns]
                new = np.diff(at) > width
                for c in columns:
                    new |= np.diff(c) != 0
                cuts = np.flatnonzero(np.concatenate([[True], new, [True]]))
                for s, e in zip(cuts, cuts[1:]):
                    for name, c in zip((*refs, "block"), columns):
                        out[name].append(c[s])
                    for k in keys:
                        out[k].append(batch[k].iloc[i])
                    out["start"].append(at[s])
                    out["words"].append(b" ".join(words[at[s] : at[e - 1] + width]))
            yield pd.DataFrame(out)

    return hits.mapInPandas(emit, f"{_schema(refs)}, block int, {_schema(keys)}, start int, words binary")


def _blocks(docs: DataFrame, keys: list[str], refs: list[str], width: int, block_words: int) -> DataFrame:
    """(refs, block, reference): the wanted blocks of each document.  docs: keys, text and the array ``wanted``."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*refs, "block", "reference")}
            for i, (text, wanted) in enumerate(zip(batch["text"], batch["wanted"])):
                words = _split(text)
                for b in wanted:
                    for r, k in zip(refs, keys):
                        out[r].append(batch[k].iloc[i])
                    out["block"].append(b)
                    out["reference"].append(b" ".join(words[b * block_words : (b + 1) * block_words + width - 1]))
            yield pd.DataFrame(out)

    return docs.mapInPandas(emit, f"{_schema(refs)}, block int, reference binary")


class Block:
    """A block of reference words and the places of its seeds."""

    def __init__(self, words: list[bytes], width: int):
        self.words, self.width = words, width
        self.places: dict[tuple[bytes, ...], list[int]] = {}
        for i in range(len(words) - width + 1):
            self.places.setdefault(tuple(words[i : i + width]), []).append(i)

    def longest(self, words: list[bytes], at: int) -> tuple[int, int]:
        """(place, length) of the longest match of ``words`` from ``at``; length 0 if it has no seed."""
        best = (0, 0)
        for place in self.places.get(tuple(words[at : at + self.width]), ()):
            n, most = self.width, min(len(self.words) - place, len(words) - at)
            while n < most and self.words[place + n] == words[at + n]:
                n += 1
            if n > best[1]:
                best = (place, n)
        return best

    def factors(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Greedy factors (start, length, place) of ``words``."""
        at = 0
        while at + self.width <= len(words):
            place, n = self.longest(words, at)
            if n:
                yield at, n, place
                # behind the factor; but the seeds that cross its end are looked up
                at += n - self.width + 1
            else:
                at += 1


def _parse(met: DataFrame, keys: list[str], refs: list[str], width: int, block_words: int) -> DataFrame:
    """(keys, start, stop, refs, ref_start): the factors of each stretch in the block that it met."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, block = None, None
        for batch in batches:
            out: list[tuple] = []
            for *known, b, start, words, reference in zip(*(batch[c].tolist() for c in (*keys, *refs, "block", "start", "words", "reference"))):
                if reference != last:
                    last, block = reference, Block(reference.split(), width)
                out += [(*known, start + at, start + at + n, b * block_words + place) for at, n, place in block.factors(words.split())]
            yield pd.DataFrame(out, columns=[*keys, *refs, "start", "stop", "ref_start"])

    return met.mapInPandas(emit, f"{_schema(keys)}, {_schema(refs)}, start int, stop int, ref_start int")


def joined_factors(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ascending (start, stop, ref, ref_start) with those joined that go on in the same text from block to block."""
    out: list[tuple[int, int, int, int]] = []
    open_: dict[tuple[int, int], int] = {}
    for start, stop, ref, ref_start in factors:
        along = (ref, ref_start - start)
        i = open_.get(along)
        if i is not None and start <= out[i][1]:
            out[i] = (out[i][0], max(stop, out[i][1]), ref, out[i][3])
        else:
            open_[along] = len(out)
            out.append((start, stop, ref, ref_start))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_removed, kept and spans.

    A word is removed if a window of ``width`` words that covers it also starts
    in a row with a smaller id; windows are judged on the input.  kept: the
    other words joined by a space.  spans: the factors as structs (start, stop,
    ref_id, ref_start) in words, stop exclusive; a copy of a smaller id's text is
    one span.  A null text has no words.  A null id refers to nothing smaller and
    nothing refers to it.  Rows of one id do not refer to each other, and
    repeated rows stay.  Texts may be of any length, as they are parsed against
    blocks; an empty table gives an empty table.  Ids are integers; others are
    refused.  Columns of these names are replaced, all others kept.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids are compared as integers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    docs = docs.drop("n_words", "n_removed", "kept", "spans")
    ident, tk, text = free_name(docs, "dedup_id"), free_name(docs, "dedup_tk"), free_name(docs, "dedup_text")
    marked = docs.withColumn(ident, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    names, keys = {ident: "id"}, ["id"]
    if docs.groupBy(id_col).count().where("count > 1").limit(1).count():
        # ids repeat, so a row is known by its id and a hash of its text
        marked = marked.withColumn(tk, F.xxhash64(text))
        names, keys = {ident: "id", tk: "tk"}, ["id", "tk"]
    refs = [f"ref_{k}" for k in keys]
    rows = marked.select(*(F.col(k).alias(v) for k, v in names.items()), F.col(text).alias("text"))

    digests = rows.select(*keys, F.unhex(F.md5("text")).alias("digest")).where(F.col("id") != NO_ID)
    least = digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("greatest")).where("greatest > least").select("digest", "least")
    copies = checkpointed(digests.join(least, "digest").where("id > least").groupBy(*keys).agg(F.min("least").alias("copy_of")))

    # an anchor that only copies of one text have has one hash of a text, and is not shared
    anchors = _anchors(rows.withColumn("copy", F.xxhash64("text")), keys, width, anchor)
    shared = anchors.groupBy("a").agg(F.min("copy").alias("c"), F.max("copy").alias("d"), F.count("*").alias("n"))
    shared = shared.where("c <> d").select("a", F.when(F.col("n") > HOT_ANCHOR, F.col("a")).alias("hot"))
    of_doc = checkpointed(anchors.drop("copy").join(shared, "a").groupBy(*keys).agg(F.collect_set("a").alias("shared"), F.collect_set("hot").alias("hot")))
    firsts = rows.join(of_doc, keys).join(copies.select(*keys), keys, "left_anti")
    seeds = _seeds(firsts, keys, width, anchor, block_words)
    first = F.min_by("block" if len(keys) == 1 else F.struct("tk", "block"), "id").alias("place")
    index = seeds.groupBy("w").agg(F.min("id").alias("ref_id"), first, F.max("id").alias("last"), F.max("salt").alias("salt")).where("last > ref_id")
    place = [F.col("place").alias("block")] if len(keys) == 1 else [F.col("place.tk").alias("ref_tk"), F.col("place.block").alias("block")]
    salts = F.explode(F.when(F.col("salt") > 0, F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))).alias("salt")
    found = seeds.drop("block").join(index.select("w", "ref_id", *place, salts), ["w", "salt"]).where("ref_id < id")
    hit = F.struct("at", *refs, "block")
    hits = found.groupBy(*keys).agg(F.collect_list(hit).alias("hits"))

    wanted = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: F.struct(*(h[r].alias(k) for r, k in zip(refs, keys)), h["block"].alias("block"))))).alias("h"))
    wanted = wanted.select("h.*").groupBy(*keys).agg(F.collect_set("block").alias("wanted"))
    stretches = _stretches(rows.join(hits, keys).select(*keys, "text", *(F.col(f"hits.{c}").alias(c) for c in ("at", *refs, "block"))), keys, refs, width)
    blocks = _blocks(rows.join(wanted, keys).select(*keys, "text", "wanted"), keys, refs, width, block_words)
    factors = _parse(stretches.join(blocks, [*refs, "block"]), keys, refs, width, block_words)
    factors = factors.groupBy(*keys).agg(F.collect_list(F.struct("start", "stop", "ref_id", "ref_start")).alias("f"))
    # a copy is marked by the place -1
    whole = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.col("copy_of").alias("ref_id"), F.lit(0).alias("ref_start"))
    settled = factors.unionByName(copies.select(*keys, F.array(whole).alias("f")))
    parts = ("start", "stop", "ref_id", "ref_start")
    given = {c: free_name(docs, f"dedup_{c}") for c in parts}
    settled = settled.select(*(F.col(v).alias(k) for k, v in names.items()), *(F.col(f"f.{c}").alias(n) for c, n in given.items()))

    @F.pandas_udf("n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int,ref_id:long,ref_start:int>>")
    def cut(texts: pd.Series, start: pd.Series, stop: pd.Series, ref: pd.Series, ref_start: pd.Series) -> pd.DataFrame:
        out = []
        for t, *found in zip(texts, start, stop, ref, ref_start):
            words = _split(t)
            if found[0] is None:
                spans = []
            elif found[0][0] < 0:
                spans = [(0, len(words), int(found[2][0]), 0)] if len(words) >= width else []
            else:
                spans = joined_factors(sorted(zip(*(f.tolist() for f in found))))
            left, end = [], 0
            for s, e, *_ in spans:
                left += words[end:s] if s > end else []
                end = max(end, e)
            left += words[end:]
            out.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass"), [dict(zip(parts, s)) for s in spans]))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "spans"])

    result = free_name(docs, "dedup_cut")
    joined = marked.join(settled, list(names), "left").withColumn(result, cut(text, *given.values()))
    # the id comes back from its key: so the exchange of the texts is the one that the seeds read
    own_id = F.nullif(F.col(ident), F.lit(NO_ID)).cast(docs.schema[id_col].dataType).alias(id_col)
    return joined.select(*(own_id if c == id_col else F.col(c) for c in docs.columns), f"{result}.*")
