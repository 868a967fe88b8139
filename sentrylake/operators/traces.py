"""Provenance traces: stitching record kinds, cleaning events, attribution of alerts to training entities."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed


def stitch_types(events: DataFrame, *kinds: DataFrame) -> DataFrame:
    """Events with actor_type and object; kinds: (id, type) of each record kind, a later kind wins; unmatched rows go."""
    all_kinds = None
    for n, k in enumerate(kinds):
        rows = k.select("id", "type", F.lit(n).alias("n"))
        all_kinds = rows if all_kinds is None else all_kinds.unionByName(rows)
    dim = all_kinds.groupBy("id").agg(F.max_by("type", "n").alias("type"))
    objects, actors = dim.toDF("objectID", "object"), dim.toDF("actorID", "actor_type")
    return events.join(objects, "objectID").join(actors, "actorID")


def attach_netflow(events: DataFrame, flows: DataFrame) -> DataFrame:
    """The properties of flow objects become their addresses and ports; flows: (id, local_address, local_port, remote_address, remote_port)."""
    props = F.create_map(
        F.lit("localAddress"), F.col("local_address"), F.lit("localPort"), F.col("local_port").cast("string"), F.lit("remoteAddress"), F.col("remote_address"), F.lit("remotePort"), F.col("remote_port").cast("string")
    )
    joined = events.join(flows.select(F.col("id").alias("objectID"), props.alias("_flow")), "objectID", "left")
    return joined.withColumn("properties", F.when((F.col("object") == "NetFlowObject") & F.col("_flow").isNotNull(), F.col("_flow")).otherwise(F.col("properties"))).drop("_flow")


def fill_missing_paths(events: DataFrame) -> DataFrame:
    """A process object without properties gets the first exec that its own actor id had (by seq) as its path."""
    first = events.where("exec <> ''").groupBy(F.col("actorID").alias("objectID")).agg(F.min_by("exec", "seq").alias("_exec"))
    joined = events.join(first, "objectID", "left")
    empty = F.col("properties").isNull() | (F.size("properties") == 0)
    fill = (F.col("object") == "SUBJECT_PROCESS") & empty & F.col("_exec").isNotNull()
    return joined.withColumn("properties", F.when(fill, F.create_map(F.lit("objectpath"), "_exec")).otherwise(F.col("properties"))).drop("_exec")


def add_attributes(edges: DataFrame, events: DataFrame) -> DataFrame:
    """The different edges with the attributes of events of the same actor, object, action and time."""
    on = ["actorID", "objectID", "action", "timestamp"]
    text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in on})
    return text(edges).join(text(events), on).distinct()


OBJECTS, NOISE = ("PROCESS", "FILE", "FLOW", "MODULE"), ("START", "TERMINATE")


def dedup_trace_events(events: DataFrame, key: tuple[str, ...] = ("action", "actorID", "objectID", "object", "pid", "ppid"), keep: str = "last") -> DataFrame:
    """Useful objects and actions, no self edges, one row for each key: the last by seq, or the first."""
    rows = events.where(F.col("object").isin(*OBJECTS) & ~F.col("action").isin(*NOISE) & (F.col("actorID") != F.col("objectID")))
    order = F.desc("seq") if keep == "last" else F.asc("seq")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def _prop(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name))


def actor_object_names(events: DataFrame) -> DataFrame:
    """Actorname and objectname by object type; rows that lack one go."""
    actor = F.when(F.col("object") == "PROCESS", _prop("parent_image_path")).otherwise(_prop("image_path"))
    flow = F.when(_prop("dest_ip").isNotNull() & _prop("dest_port").isNotNull(), F.concat_ws(" ", _prop("dest_ip"), _prop("dest_port")))
    obj = F.when(F.col("object") == "PROCESS", _prop("image_path")).when(F.col("object") == "FILE", _prop("file_path")).when(F.col("object") == "MODULE", _prop("module_path")).when(F.col("object") == "FLOW", flow)
    return events.withColumn("actorname", actor).withColumn("objectname", obj).where("actorname is not null and objectname is not null")


def describe_event() -> Column:
    """P20: an event's phrase as tokens; a phrase with a missing part is the one empty token."""
    parts = {
        "PROCESS": ("parent_image_path", None, "image_path", "command_line"),
        "FILE": ("image_path", None, "file_path"),
        "FLOW": ("image_path", None, "src_ip", "src_port", "dest_ip", "dest_port", "direction"),
    }
    other = ("image_path", None, "module_path")

    def phrase(names: tuple) -> Column:
        columns = [F.col("action") if n is None else _prop(n) for n in names]
        whole = columns[0].isNotNull()
        for c in columns[1:]:
            whole = whole & c.isNotNull()
        return F.when(whole, F.concat_ws(" ", *columns)).otherwise(F.lit(""))

    out = phrase(other)
    for kind, names in parts.items():
        out = F.when(F.col("object") == kind, phrase(names)).otherwise(out)
    return F.split(out, " ")


#: Of each event kind the object's name, its id, the actor's id, and its class.
ETW = {
    "TcpIpSendIPV4": ("daddr", "daddr", "PID", "FLOW"), "TcpIpRecvIPV4": ("daddr", "daddr", "PID", "FLOW"), "FileIORead": ("FileName", "FileName", "PID", "FILE"),
    "FileIOWrite": ("FileName", "FileName", "PID", "FILE"), "ProcessStart": ("ImageFileName", "ProcessId", "PPID", "PROCESS"),
}


def map_etw_events(events: DataFrame) -> DataFrame:
    """(action, actorID, objectID, object, actorname, objectname, TimeStamp) of the five kinds that count."""

    def pick(of) -> Column:
        out = F.lit(None).cast("string")
        for kind, spec in ETW.items():
            out = F.when(F.col("Event") == kind, of(spec)).otherwise(out)
        return out

    arg = lambda name: F.try_element_at("args", F.lit(name))
    return events.where(F.col("Event").isin(*ETW)).select(
        F.col("Event").alias("action"), pick(lambda s: F.col(s[2]).cast("string")).alias("actorID"), pick(lambda s: arg(s[1])).alias("objectID"), pick(lambda s: F.lit(s[3])).alias("object"),
        F.col("PName").alias("actorname"), pick(lambda s: arg(s[0])).alias("objectname"), "TimeStamp",
    )


def canonical_properties(props: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(props))))


def second_object_rows(events: DataFrame) -> DataFrame:
    """P25: one row for each object of an event (objectID, objectID2)."""
    objects = F.array_compact(F.array("objectID", "objectID2"))
    return events.withColumn("_o", F.explode(objects)).withColumn("objectID", F.col("_o")).drop("_o", "objectID2")


def missing_semantics(events: DataFrame) -> DataFrame:
    """(side, type, missing, total, percent): actors without exec and objects without properties, by type."""
    empty = F.col("properties").isNull() | (F.size("properties") == 0)
    sides = F.explode(F.array(F.struct(F.lit("actor").alias("side"), F.col("actor_type").alias("type"), (F.col("exec") == "").alias("m")), F.struct(F.lit("object").alias("side"), F.col("object").alias("type"), empty.alias("m"))))
    rows = events.select(sides.alias("s")).select("s.*")
    return rows.groupBy("side", "type").agg(F.count_if("m").alias("missing"), F.count("*").alias("total")).withColumn("percent", F.round(100 * F.col("missing") / F.col("total"), 2))


def node_documents(events: DataFrame) -> DataFrame:
    """(node, tokens, name): the tokens of a node's events in order of seq; the name of the last one.

    events: seq, actorID, objectID, exec, action, path.  A hub's document is as
    long as its number of events; ``max_by`` and counts need no document.
    """
    tokens = F.array_compact(F.array("exec", "action", "path"))
    ends = F.explode(F.array(F.struct(F.col("actorID").alias("node"), F.col("exec").alias("name")), F.struct(F.col("objectID").alias("node"), F.col("path").alias("name"))))
    rows = events.select("seq", tokens.alias("t"), ends.alias("e")).select("seq", "t", "e.*")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "t")))
    return rows.groupBy("node").agg(F.flatten(F.transform(ordered, lambda x: x["t"])).alias("tokens"), F.max_by("name", F.struct("seq", "name")).alias("name"))


def dense_index(keys: DataFrame, col: str) -> DataFrame:
    """(col, index): the different values of a column numbered from 0 in their order, without gaps; null has no number.

    Values are dealt to tasks by ranges and numbered there, behind the counts of the tasks before.
    """
    dealt = checkpointed(keys.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(col)) - 1
    # a row for each task
    return dealt.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select(col, (F.col("before") + place).alias("index"))


def indexed_edges(events: DataFrame, src: str = "actorID", dst: str = "objectID") -> tuple[DataFrame, DataFrame]:
    """(node, index) of both ends' nodes, and the different edges as (src, dst) of indices."""
    ends = events.select(F.explode(F.array(src, dst)).alias("node"))
    nodes = checkpointed(dense_index(ends, "node"))
    edges = events.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()
    edges = edges.join(nodes.select(F.col("node").alias("a"), F.col("index").alias("src")), "a").join(nodes.select(F.col("node").alias("b"), F.col("index").alias("dst")), "b")
    return nodes, edges.select("src", "dst")


def class_labels(named: DataFrame, classes: list[str]) -> DataFrame:
    """``named`` (node, name, ..) with label: the place of its name in ``classes``, or their number for any other."""
    known = F.array_position(F.array(*map(F.lit, classes)), F.col("name"))
    return named.withColumn("label", F.when(F.coalesce(known, F.lit(0)) > 0, known - 1).otherwise(len(classes)).cast("int"))


def node_labels(events: DataFrame) -> DataFrame:
    """(node, name): the name that a node has in its last event; no documents are made."""
    ends = F.explode(F.array(F.struct(F.col("actorID").alias("node"), F.col("exec").alias("name")), F.struct(F.col("objectID").alias("node"), F.col("path").alias("name"))))
    return events.select("seq", ends.alias("e")).select("seq", "e.*").groupBy("node").agg(F.max_by("name", F.struct("seq", "name")).alias("name"))


def in_order(events: DataFrame, key: str) -> DataFrame:
    """(event_id, place): each event's place in order of time within its key, as training reads them."""
    return events.select("event_id", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")).alias("place"))


def neighbor_names(events: DataFrame) -> DataFrame:
    """(node, names): the different names at the other ends of a node's edges."""
    rows = events.select(F.explode(F.array(F.struct(F.col("actorID").alias("node"), F.col("objectname").alias("name")), F.struct(F.col("objectID").alias("node"), F.col("actorname").alias("name")))).alias("e")).select("e.*")
    return rows.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("names"))


def reduce_evaluation_graph(evaluation: DataFrame, benign: DataFrame, alert: str, attributed: str, match_actor: bool = False) -> DataFrame:
    """The objects of the alert entity that the attributed benign entity does not touch: (exec, path)."""
    mine = evaluation.where(F.col("exec") == alert).select("exec", "path").distinct()
    theirs = benign.where(F.col("exec") == attributed).select("exec", "path").distinct()
    on = ["exec", "path"] if match_actor else ["path"]
    return mine.join(theirs.select(*on).distinct(), on, "left_anti").select("exec", "path")


def top_k_contributors(scores: DataFrame, k: int = 3) -> DataFrame:
    """(entity, omitted, diff): of each entity the k omissions that raise its score most; scores: (omitted, entity, score) with ``zeroth``."""
    base = scores.where("omitted = 'zeroth'").select("entity", F.col("score").alias("base"))
    rows = scores.where("omitted <> 'zeroth'").join(base, "entity").withColumn("diff", F.col("score") - F.col("base"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("diff"), "omitted"))
    return rows.withColumn("r", rank).where(F.col("r") <= k).select("entity", "omitted", "diff")


def confidence(probabilities: DataFrame) -> DataFrame:
    """(id, confidence): (p1 - p2) / p1 of the two best classes, less its least, over its greatest before that."""
    s = F.sort_array("probabilities", asc=False)
    c = probabilities.select("id", ((F.get(s, F.lit(0)) - F.get(s, F.lit(1))) / F.get(s, F.lit(0))).alias("c"))
    span = c.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return c.join(F.broadcast(span)).select("id", ((F.col("c") - F.col("lo")) / F.col("hi")).alias("confidence"))


#: Values that are placed one by one; they take 50 bytes each on the driver.
HEAVY_VALUES = 10_000


def balanced_shards(events: DataFrame, col: str, n: int, heavy: int = HEAVY_VALUES) -> DataFrame:
    """(value, count, shard): values by descending count, each into the shard that is least loaded.

    The greedy rule is followed for the ``heavy`` values of the largest counts,
    ties to the lesser value.  All others have counts of at most the last of
    these and go by their hash, which evens out small ones.
    """
    spark = events.sparkSession
    counts = checkpointed(events.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count")))
    top = counts.orderBy(F.desc("count"), "value").limit(heavy)
    loads, placed = [(0, k) for k in range(n)], []
    for row in top.collect():
        load, k = heapq.heappop(loads)
        placed.append((row["value"], k))
        heapq.heappush(loads, (load + row["count"], k))
    kind = counts.schema["value"].dataType.simpleString()
    table = spark.createDataFrame(placed, f"of {kind}, shard int")
    by_hash = F.pmod(F.xxhash64("value"), F.lit(n)).cast("int")
    joined = counts.join(F.broadcast(table), F.col("value").eqNullSafe(F.col("of")), "left")
    return joined.select("value", "count", F.coalesce("shard", by_hash).alias("shard"))


def category_split(ids: DataFrame, n: int, col: str = "id") -> DataFrame:
    """(id, group): n runs of the ids in order, the first ones longer by one where n does not divide their number.

    The ids are dealt to tasks by ranges; each task numbers its own, behind
    those of the tasks before, of which only the counts go to one task.
    """
    dealt = checkpointed(ids.select(col).repartitionByRange(col).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(col)) - 1
    short, longer = F.floor(F.col("total") / n), F.col("total") % n
    # so many ids lie in the groups that are longer by one
    group = F.when(F.col("r") < longer * (short + 1), F.floor(F.col("r") / (short + 1))).otherwise(longer + F.floor((F.col("r") - longer * (short + 1)) / short))
    return dealt.join(F.broadcast(sizes), "part").withColumn("r", rank).select(col, (group + 1).cast("int").alias("group"))


def attribution_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mean, above): over entities with sets in both, the share of a's that b has, and how many are above 0.8."""
    sa, sb = a.groupBy("entity").agg(F.collect_set("omitted").alias("x")), b.groupBy("entity").agg(F.collect_set("omitted").alias("y"))
    share = F.size(F.array_intersect("x", "y")) / F.size("x")
    return sa.join(sb, "entity").agg(F.avg(share).alias("mean"), F.count_if(share > 0.8).alias("above"))
