"""Sharding by balanced label propagation: linked documents share a shard, and shards are of even size.

A link is a key: documents with one key are neighbours (equal texts here; a
host or a component would do).  Nobody writes pairs: the documents of a key
are counted by shard, and the counts are joined back.  A key's documents are
first gathered to nodes by a hash of their ids, ``CELLS`` a shard, so a key that
holds a third of all rows is no more than ``CELLS`` times shards rows, and it can
be taken apart where one shard cannot hold it.

Nodes begin in the shard of their hash.  In each round a node asks for the shard
with the most of its neighbours.  What may move between two shards is a matter of
quotas: the wanted flows, one number for each pair of shards, are cut until no
shard goes beyond its capacity, counting what leaves it; each flow admits nodes in
a seeded order as far as it reaches.  Every second round a node only asks for
shards that have room, so it does not wait for one that stays full.

At the end documents without links, and what lies above the mean, are laid on
lines in the order of a hash of their keys, the largest documents first, which are
cut by the shards' rooms: sizes are equal to within a small document, and a key
that has to leave a shard leaves it as a whole.  Running sums go by buckets, so no shard is one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed, stored
from .common import free_name

#: Nodes that a key's documents make up for each shard, at most.
CELLS = 8
MAX_ROUNDS = 16
#: How far beyond the mean a shard may go before all are levelled.
SLACK = 0.25
#: Documents of more than these parts of a shard are dealt before the others.
LARGE = (1 / 64, 1 / 2_048)
#: Rows that a running sum adds up in one task's group, on average, and those of a key of many rows.
BUCKET_ROWS, KEY_ROWS = 5_000, 500


def _running(df: DataFrame, parts: list[str], rows: int, spread: Column, order: list[Column], value: Column, name: str, fine: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, by ``parts``: in the order of buckets of ``spread``, of ``fine`` parts of them, then of ``order``.

    Rows with a part above 0 come first: those of large keys, which so stay together, and the small keys leave as a whole.
    """
    bucket, sub, base = f"{name}_bucket", f"{name}_sub", f"{name}_base"
    of = [*parts, bucket, sub]
    n = max(1, math.ceil(rows / BUCKET_ROWS))
    part = F.lit(0) if fine is None else fine
    df = df.withColumn(bucket, (F.pmod(spread, F.lit(n)) + F.when(part > 0, 0).otherwise(n)).cast("int")).withColumn(sub, part.cast("int"))
    sums = df.groupBy(*of).agg(F.sum(value).alias(base))
    earlier = Window.partitionBy(*parts).orderBy(bucket, sub).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*of, F.coalesce(F.sum(base).over(earlier), F.lit(0)).alias(base))
    within = Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, of).withColumn(name, F.col(name) + F.col(base)).drop(bucket, sub, base)


def quotas(wanted: dict[tuple[int, int], float], loads: dict[int, float], limit: float, turn: int = 0) -> dict[tuple[int, int], float]:
    """The flows that are admitted: each at most as wanted, and no shard goes beyond ``limit``, or further beyond it, counting what leaves it.

    What a shard has no room for is taken off whole flows, in an order that
    turns round by round: parts of all flows could be too small for any node.
    A number for each pair of shards; how many documents there are does not matter.
    """
    flow = dict(wanted)
    shards = sorted({s for pair in wanted for s in pair})
    into = {t: sorted((pair for pair in wanted if pair[1] == t), key=lambda pair: ((pair[0] - turn) % (max(shards) + 1), pair)) for t in shards}
    for _ in range(1_000):
        settled = True
        for t in shards:
            come = sum(flow[pair] for pair in into[t])
            leave = sum(x for (a, _), x in flow.items() if a == t)
            over = min(come, come - leave + loads.get(t, 0) - limit)
            if over > 1e-6 * max(1.0, limit):
                settled = False
                for pair in into[t]:
                    less = min(over, flow[pair])
                    flow[pair] -= less
                    over -= less
        if settled:
            return flow
    return dict.fromkeys(flow, 0.0)


def propagate(nodes: DataFrame, members: DataFrame, shards: int, limit: float, max_rounds: int = MAX_ROUNDS, seed: int = 42) -> DataFrame:
    """``nodes`` (node, size, weight, shard) in the shards to which their neighbours draw them.

    members: (node, key), any number of keys a node.  weight: how many
    documents a node stands for.  A node asks for the shard where its keys have
    the greatest weight, its own there included, so two nodes of one key do not
    swap; ties go by a hash of key and shard, the same for all nodes of a key.
    """
    nodes, idle = checkpointed(nodes.select("node", "size", "weight", "shard")), 0
    loads = {r["shard"]: float(r["load"]) for r in nodes.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    for turn in range(max_rounds):
        votes = members.join(nodes, "node").groupBy("key", "shard").agg(F.sum("weight").alias("n")).withColumn("tie", F.xxhash64("key", "shard", F.lit(seed)))
        # all shards of a key in one row: at most as many as there are shards
        seen = members.join(votes.groupBy("key").agg(F.collect_list(F.struct("n", "tie", F.col("shard").alias("to"))).alias("votes")), "key")
        several = seen.select("node", F.explode("votes").alias("v")).groupBy("node", F.col("v.to").alias("to")).agg(F.sum("v.n").alias("n"), F.max("v.tie").alias("tie"), F.count("*").alias("keys"))
        drawn = several.groupBy("node").agg(F.collect_list(F.struct("n", "tie", "to", "keys")).alias("drawn"))
        room = F.array(*(F.lit(limit - loads.get(s, 0.0)) for s in range(shards)))
        here = lambda v: v["to"] == F.col("shard")
        open_ = lambda v: here(v) | (room[v["to"]] >= F.col("size"))
        # a node is in each of its keys, but draws itself once
        once = lambda v: F.struct((v["n"] - F.when(here(v), F.col("weight") * (v["keys"] - 1)).otherwise(0)).alias("n"), v["tie"].alias("tie"), v["to"].alias("to"))
        best = F.array_max(F.transform(F.filter("drawn", open_) if turn % 2 else F.col("drawn"), once))["to"]
        asked = checkpointed(nodes.join(drawn, "node", "left").select("node", "size", "weight", "shard", F.coalesce(best, F.col("shard")).alias("to")))
        flows = asked.where("to <> shard").groupBy("shard", "to").agg(F.sum("size").cast("double").alias("bytes"), F.count("*").alias("n")).collect()
        admitted = quotas({(r["shard"], r["to"]): r["bytes"] for r in flows}, loads, limit, turn)
        moved = 0
        if flows:
            table = nodes.sparkSession.createDataFrame([(*pair, x) for pair, x in admitted.items()], "shard int, to int, quota double")
            queue = _running(asked.where("to <> shard"), ["shard", "to"], max(r["n"] for r in flows), F.xxhash64("node", F.lit(seed)), [F.xxhash64("node", F.lit(seed)), F.col("node")], F.col("size"), "before")
            go = checkpointed(queue.join(F.broadcast(table), ["shard", "to"]).where(F.col("before") + F.col("size") <= F.col("quota") + 1).select("node", F.col("to").alias("new"), "shard", "size"))
            for r in go.groupBy("shard", "new").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
                moved += r["n"]
                loads[r["shard"]] -= r["bytes"]
                loads[r["new"]] = loads.get(r["new"], 0.0) + r["bytes"]
            if moved:
                nodes = asked.join(go.select("node", "new"), "node", "left").select("node", "size", "weight", F.coalesce("new", "shard").alias("shard"))
        idle = 0 if moved else idle + 1
        if idle == 2:
            break
    return nodes


def assign(docs: DataFrame, id_col: str = "doc_id", size_col: str = "size", link_col: str = "link", shards: int = 24, max_rounds: int = MAX_ROUNDS, seed: int = 42) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0 without gaps in each shard).

    Keep ``docs`` narrow; its rows are shuffled.  link_col: rows with an equal
    key are linked, null links to nothing.  Sizes of shards differ by about one
    document; a key stays in one shard unless it is too large for the room
    there.

    A null size counts as 0, a null id is an id; repeated rows are rows of
    their own, linked by their key like any other.  Only sizes and keys of
    texts come here, so texts may be of any length.  All columns are kept,
    whatever their names, but for ``shard`` and ``slot``, which are replaced.
    Rows that agree in id, key and size are interchangeable.  An empty table
    gives an empty table.
    """
    docs = docs.drop("shard", "slot")
    spread = F.xxhash64(F.col(id_col), F.col(link_col), F.lit(seed))
    rows = stored(
        docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), F.col(link_col).alias("link"), spread.alias("spread"))
    ).withColumn("cell", F.pmod("spread", F.lit(shards * CELLS)).cast("int"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    mean = total / shards
    of_key = rows.where("link is not null").groupBy("link", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("weight"))
    linked = of_key.withColumn("all", F.sum("weight").over(Window.partitionBy("link"))).where("all > 1")
    nodes = checkpointed(linked.select(F.struct("link", "cell").alias("node"), "size", "weight", F.floor(F.col("cell") / CELLS).cast("int").alias("shard")))
    settled = propagate(nodes, nodes.select("node", F.col("node.link").alias("key")), shards, mean * (1 + SLACK), max_rounds, seed)
    placed = rows.join(settled.select("node.link", "node.cell", "shard", "weight"), ["link", "cell"], "left")
    # a key of many rows is cut into parts wherever rows are put in order
    in_parts = F.floor(F.coalesce("weight", F.lit(0)) * (shards * CELLS / KEY_ROWS))
    fine = F.when(in_parts > 0, F.pmod("spread", in_parts) + 1).otherwise(0).cast("int")
    placed = checkpointed(placed.select("row", "id", "size", "link", "spread", "shard", fine.alias("fine")))
    # rows of a key follow each other, so what has to leave a shard leaves it together
    key_order = F.xxhash64(F.coalesce(F.xxhash64("link"), F.col("spread")), F.lit(seed))
    order = [key_order, F.col("link"), F.col("spread"), F.col("size")]
    fixed, free = placed.where("shard is not null"), placed.where("shard is null")
    loads = {r["shard"]: (float(r["bytes"]), r["n"]) for r in fixed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    if any(load > mean + 1 for load, _ in loads.values()):
        summed = checkpointed(_running(fixed, ["shard"], max(n for _, n in loads.values()), key_order, order, F.col("size"), "before", F.col("fine")))
        stays = F.col("before") + F.col("size") <= F.lit(mean)
        fixed, spilled = summed.where(stays).drop("before"), summed.where(~stays).drop("before").withColumn("shard", F.lit(None).cast("int"))
        free = free.unionByName(spilled)
        loads = {r["shard"]: (float(r["bytes"]), r["n"]) for r in fixed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    done, load = [fixed], [loads.get(s, (0.0, 0))[0] for s in range(shards)]
    tier = F.when(F.col("size") > mean * LARGE[0], 0).when(F.col("size") > mean * LARGE[1], 1).otherwise(2)
    free = free.withColumn("tier", tier)
    for r in sorted(free.groupBy("tier").agg(F.sum("size").cast("double").alias("bytes"), F.count("*").alias("n")).collect()):
        # the line of what is free, cut where the shares of the shards' rooms end; the smallest documents come last and level what the larger ones leave
        rooms = [max(0.0, mean - x) for x in load]
        ends = [sum(rooms[: s + 1]) / max(sum(rooms), 1.0) * r["bytes"] for s in range(shards)]
        line = _running(free.where(F.col("tier") == r["tier"]), [], r["n"], key_order, order, F.col("size"), "before", F.col("fine"))
        middle = F.col("before") + F.col("size") / 2
        cut = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle))
        dealt = checkpointed(line.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int")).drop("before", "tier"))
        done.append(dealt)
        for x in dealt.groupBy("shard").agg(F.sum("size").cast("double").alias("bytes")).collect():
            load[x["shard"]] += x["bytes"]
    everything = reduce(DataFrame.unionByName, done)
    numbered = _running(everything, ["shard"], -(-n_rows // shards), key_order, order, F.lit(1), "slot", F.col("fine"))
    return numbered.select("row.*", F.col("shard"), F.col("slot").cast("long").alias("slot"))


def cut_links(docs: DataFrame, link_col: str = "link", shard_col: str = "shard") -> DataFrame:
    """(links, cut) of the whole: pairs of documents with one key, and those of them that lie in two shards, by counts of keys and shards."""
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    key, shard, n = free_name(docs, "cut_key"), free_name(docs, "cut_shard"), F.col("n").cast("double")
    inside = docs.where(F.col(link_col).isNotNull()).groupBy(F.col(link_col).alias(key), F.col(shard_col).alias(shard)).agg(F.count("*").alias("n"))
    of_key = inside.groupBy(key).agg(F.sum("n").alias("n"), pairs(n).alias("same"))
    return of_key.agg(F.coalesce(pairs(n), F.lit(0.0)).alias("links"), F.coalesce(pairs(n) - F.sum("same"), F.lit(0.0)).alias("cut"))
