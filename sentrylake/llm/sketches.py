"""Bottom-k sketches of a text's shingles.

A shingle is ``width`` consecutive words (a shorter text is one shingle, a text
without words none); its hash is XXH64 over the words one after another.  A sketch
is the ascending array of the ``k`` least different hashes.  Sketches of parts
merge into the sketch of the whole, and from two of them follow the texts'
resemblance, the containment of one in the other and each one's number of
different shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed
from .common import words

K = 128
WIDTH = 5
#: A group in which neighbours are looked for holds 2 ** GROUP_BITS different ids at most.
GROUP_BITS = 7
#: Bytes of values that a task is dealt, about.
TASK_BYTES = 64 << 20
#: So many first ids of groups are broadcast at most.
MAX_BROADCAST = 1_000_000


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text; null and blank texts give the empty array."""

    def of(w: Column) -> Column:
        n = F.size(w)
        # a window that runs over the end hashes fewer words; only a short text's first one counts
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, width))))
        kept = F.slice(hashes, F.lit(1), F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), n - (width - 1))))
        return F.slice(F.sort_array(F.array_distinct(kept)), 1, k)

    # bound once: a lambda's variable is evaluated once for each text
    return F.transform(F.array(words(text)), of)[0]


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all, 0 to 1; 1 for two empty sketches, exact up to k shingles."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles: exact below k, else (k - 1) over the k-th hash as a share of all."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    # |a & b| = r / (1 + r) (|a| + |b|)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (na + nb) / na))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash, joined; equal texts have equal ones."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, value_cols: list[str], prefix: str = "next_", group_bits: int = GROUP_BITS) -> DataFrame:
    """``docs`` and the value columns of the row with the next greater id, after the last those of the first.

    Rows are grouped by the id without its last ``group_bits`` bits, so a
    group holds so many ids at most however they are spread, and ``lead``
    runs inside groups.  The first row of each group is also sent to the
    group before it, where it stands behind the last row; so the texts are
    shuffled once.  Which group is before which is found in the same way,
    level by level, on the group numbers.  First ids are one in many: up to
    ``MAX_BROADCAST`` of them (24 bytes each) are broadcast, more are joined by
    shuffle.  Rows that share an id are put in order of their values, so
    each still has one neighbour.  A row with a null id has no neighbour and is
    nobody's: its next values are null.  Columns of the new names are replaced.
    """
    docs = docs.drop(*(f"{prefix}{c}" for c in value_cols))
    types = {c: docs.schema[c].dataType for c in value_cols}
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in types.items() if t.typeName() in ("string", "binary")]
    low, high, size = docs.agg(F.min(id_col), F.max(id_col), F.sum(sum(texts, F.lit(64)))).first()
    nothing = [F.lit(None).cast(t).alias(f"{prefix}{c}") for c, t in types.items()]
    nulls = docs.where(F.col(id_col).isNull()).select(*docs.columns, *nothing)
    if low is None:
        return nulls
    # a row travels as one value, so that no column of it clashes with those of the work
    known = docs.where(F.col(id_col).isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"))
    own = F.shiftright("id", group_bits)
    firsts = known.groupBy(own.alias("of")).agg(F.min("id").alias("first"))
    after = _next_group(firsts.select(F.col("of").alias("_g")), low >> group_bits, high >> group_bits, group_bits)
    sent = checkpointed(after.join(firsts, F.col("_after") == F.col("of")).select("first", F.col("_g").alias("before")))
    if sent.count() <= MAX_BROADCAST:
        sent = F.broadcast(sent)
    joined = known.join(sent, F.col("id") == F.col("first"), "left")
    here, there = F.struct(own.alias("g"), F.lit(0).alias("copy")), F.struct(F.col("before").alias("g"), F.lit(1).alias("copy"))
    placed = joined.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    placed = placed.select("row", "id", "at.g", "at.copy").repartition(tasks, "g")
    window = Window.partitionBy("g").orderBy("copy", "id", *(F.col("row")[c] for c in value_cols))
    out = placed.select("row", "copy", *(F.lead(F.col("row")[c]).over(window).alias(f"{prefix}{c}") for c in value_cols)).where("copy = 0")
    return out.select("row.*", *(f"{prefix}{c}" for c in value_cols)).unionByName(nulls)


def _next_group(groups: DataFrame, low: int, high: int, group_bits: int) -> DataFrame:
    """(_g, _after): each number of the table and the next greater one; after the greatest the least.

    The numbers are unique and lie between low and high.  A level looks inside
    groups that agree but for the last bits and leaves one number open for
    each, which the level above resolves; the top level is one group.
    """
    if high - low < 1 << group_bits:
        window = Window.partitionBy("_u").orderBy("_g")
        return groups.withColumn("_u", F.lit(0)).withColumn("_after", F.lead("_g").over(window)).select("_g", F.coalesce("_after", F.lit(low)).alias("_after"))
    # a few bytes for each group: kept, so that each level is worked out once
    groups = checkpointed(groups.withColumn("_u", F.shiftright("_g", group_bits)))
    tops = groups.groupBy("_u").agg(F.min("_g").alias("_min"))
    above = _next_group(tops.select(F.col("_u").alias("_g")), low >> group_bits, high >> group_bits, group_bits)
    jump = above.select(F.col("_g").alias("_v"), F.col("_after").alias("_w")).join(tops.select(F.col("_u").alias("_w"), "_min"), "_w").select("_v", "_min")
    found = groups.withColumn("_after", F.lead("_g").over(Window.partitionBy("_u").orderBy("_g")))
    return found.join(jump, F.col("_u") == F.col("_v")).select("_g", F.coalesce("_after", "_min").alias("_after"))
