"""Representative instances of programs: one k-means for each of many programs at once.

An instance (a process that ran a program) is the bag of its edges' labels,
hashed to a short vector.  All programs are clustered in the same Spark jobs:
their centres are a table of k rows a program, points meet those of their
program in rows of bounded size, each of which sends k sums, and the next
centres are their means.  A program with very many instances is dealt to several
such groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed

DIM = 32
#: Points of a program from which its first centres are chosen, for each centre.
SEED_POINTS = 16
#: Instances of a program that meet its centres in one group.
PART_ROWS = 50_000
#: Programs whose centres are broadcast at most.
SENT_PROGRAMS = 10_000


def _sent(programs: DataFrame, n: int) -> DataFrame:
    return F.broadcast(programs) if n <= SENT_PROGRAMS else programs


def instance_vectors(edges: DataFrame, program: str, instance: str, label: Column, dim: int = DIM) -> DataFrame:
    """(program, instance, x): counts of hashed edge labels with a hashed sign, scaled to length 1.  Null programs and instances are left out.

    Counts are sums in each task before anything is shuffled, so an instance
    with a third of all edges is a row a task.
    """
    rows = edges.where(F.col(program).isNotNull() & F.col(instance).isNotNull()).select(F.col(program).alias("program"), F.col(instance).alias("instance"), F.xxhash64(label).alias("h"))
    bucket, sign = F.pmod("h", F.lit(dim)), F.when(F.shiftright("h", 40) % 2 == 0, 1.0).otherwise(-1.0)
    sums = rows.groupBy("program", "instance").agg(F.array(*(F.sum(F.when(bucket == i, sign).otherwise(0.0)) for i in range(dim))).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return sums.withColumn("norm", norm).select("program", "instance", F.transform("x", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(v)).alias("x"))


def first_centres(points, k: int):
    """Rows of the centres to begin with: the first point, then always the one that is farthest from all chosen; fewer where points are equal."""
    import numpy as np

    chosen, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.max() > 1e-18:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def _distance(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def cluster_programs(points: DataFrame, k: int, rounds: int = 10, seed: int = 42, seed_points: int = SEED_POINTS, part_rows: int = PART_ROWS) -> DataFrame:
    """(program, instance, cluster, distance): Lloyd's rounds over all programs of ``points`` (program, instance, x) until no centre moves.

    The first centres lie far apart in a sample of ``k * seed_points`` points a
    program, those whose seeded hash is least.  A cluster that loses all points
    keeps its centre.
    """
    dim = F.size("x")
    counts = points.groupBy("program").agg(F.count("*").alias("n"))
    parts = checkpointed(counts.select("program", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")))
    programs = parts.count()
    placed = points.join(_sent(parts, programs), "program").withColumn("part", F.pmod(F.xxhash64("instance"), F.col("parts")).cast("int"))
    # a part is one row of flat numbers, made once; a round brings the centres to it
    packed = placed.groupBy("program", "part").agg(F.collect_list(F.struct("instance", "x")).alias("p"))
    packed = checkpointed(packed.select("program", F.transform("p", lambda r: r["instance"]).alias("instances"), F.flatten(F.transform("p", lambda r: r["x"])).alias("xs")))
    order = Window.partitionBy("program").orderBy("h", "instance")
    drawn = points.select("program", "instance", "x", F.xxhash64("instance", F.lit(seed)).alias("h")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k * seed_points)

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = group.sort_values("r")
        x = np.stack(rows["x"].to_numpy())
        chosen = first_centres(x, k)
        return pd.DataFrame({"program": rows["program"].iloc[0], "cluster": range(len(chosen)), "c": [x[i] for i in chosen]})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    centres = checkpointed(drawn.groupBy("program").applyInPandas(begin, f"program {kinds['program']}, cluster int, c array<double>"))
    n_dim = points.select(dim).first()
    if n_dim is None:
        return points.select("program", "instance", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))

    def beside(table: DataFrame) -> DataFrame:
        """Each part with its program's centres (k at most)."""
        centres = table.groupBy("program").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("cs"))
        centres = centres.select("program", F.transform("cs", lambda r: r["cluster"]).alias("clusters"), F.flatten(F.transform("cs", lambda r: r["c"])).alias("centres"))
        return packed.join(_sent(centres, programs), "program")

    def nearest(batch: pa.RecordBatch, i: int):
        import numpy as np

        x, c = (np.asarray(batch.column(name)[i].values).reshape(-1, n_dim[0]) for name in ("xs", "centres"))
        gaps = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
        return x, np.asarray(batch.column("clusters")[i].values)[gaps.argmin(axis=1)], gaps.min(axis=1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, at, _ = nearest(batch, i)
                there = sorted(set(at.tolist()))
                program = batch.column("program").take(pa.array([i] * len(there)))
                n, s = [int((at == c).sum()) for c in there], [x[at == c].sum(axis=0).tolist() for c in there]
                yield pa.RecordBatch.from_arrays([program, pa.array(there, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], ["program", "cluster", "n", "s"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, at, gap = nearest(batch, i)
                program = batch.column("program").take(pa.array([i] * len(at)))
                yield pa.RecordBatch.from_arrays([program, batch.column("instances")[i].values, pa.array(at, pa.int32()), pa.array(gap**0.5)], ["program", "instance", "cluster", "distance"])

    for _ in range(rounds):
        # a part of a program sends k sums
        partial = beside(centres).select("program", "xs", "clusters", "centres").mapInArrow(sums, f"program {kinds['program']}, cluster int, n long, s array<double>")
        # rounded, as the order of sums differs from run to run
        means = F.array(*(F.round(F.sum(F.col("s")[i]) / F.sum("n"), 9) for i in range(n_dim[0]))).alias("mean")
        moved = partial.groupBy("program", "cluster").agg(means)
        following = checkpointed(centres.join(moved, ["program", "cluster"], "left").withColumn("gap", F.coalesce(_distance(F.col("c"), F.col("mean")), F.lit(0.0))).select("program", "cluster", F.coalesce("mean", "c").alias("c"), "gap"))
        centres = following.drop("gap")
        if following.where("gap > 1e-18").isEmpty():
            break
    return beside(centres).mapInArrow(settled, f"program {kinds['program']}, instance {kinds['instance']}, cluster int, distance double")


def representative_actors(edges: DataFrame, program: str, instance: str, label: Column, k: int = 10, rounds: int = 10, dim: int = DIM, seed: int = 42) -> DataFrame:
    """(program, instance, cluster, members): of each program with more than ``k`` instances the one nearest to each cluster's centre.

    A program with up to k instances keeps them all, each its own cluster.
    Ties go to the lesser instance.  No points and no programs pass through the
    driver; an empty table gives an empty table.
    """
    points = checkpointed(instance_vectors(edges, program, instance, label, dim))
    n = checkpointed(points.groupBy("program").agg(F.count("*").alias("n")))
    programs = n.count()
    many = _sent(n.where(F.col("n") > k), programs)
    few = points.join(_sent(n.where(F.col("n") <= k), programs), "program").select("program", "instance", (F.row_number().over(Window.partitionBy("program").orderBy("instance")) - 1).alias("cluster"), F.lit(1).cast("long").alias("members"))
    found = cluster_programs(points.join(many, "program", "left_semi"), k, rounds, seed)
    medoids = found.groupBy("program", "cluster").agg(F.min(F.struct("distance", "instance")).alias("m"), F.count("*").alias("members"))
    return few.unionByName(medoids.select("program", F.col("m.instance").alias("instance"), "cluster", "members"))
