"""Provenance graphs as two tables: nodes and edges.

A node is known by one string, its type and identity (``host:h1``).  Iterations
write each round to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed, stored
from ..functions.components import connected_components


def _key(kind: str, identity: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), identity)


def _event_nodes() -> dict[str, Column]:
    """The nodes that an event touches; null where it lacks one."""
    host = F.when(F.col("host") != "", _key("host", F.col("host")))
    name = F.coalesce("host", F.lit("unknown"))
    process = F.when(
        (F.col("process") != "") | F.col("pid").isNotNull(),
        _key("process", F.concat(name, F.lit("::"), F.coalesce("process", F.lit("?")), F.lit("["), F.coalesce(F.col("pid").cast("string"), F.lit("?")), F.lit("]"))),
    )
    parent = F.when(process.isNotNull() & F.col("parent_pid").isNotNull(), _key("process", F.concat(name, F.lit("::?["), F.col("parent_pid").cast("string"), F.lit("]"))))
    user = F.when((F.col("user") != "") & F.col("event_type").isin("auth", "audit"), _key("user", F.col("user")))
    file = F.when((F.col("file_path") != "") & process.isNotNull(), _key("file", F.col("file_path")))
    socket = F.when((F.col("dst_ip") != "") & process.isNotNull(), _key("socket", F.concat_ws(":", "dst_ip", F.coalesce("dst_port", F.lit(0)).cast("string"))))
    return {"host": host, "process": process, "parent": parent, "user": user, "file": file, "socket": socket}


def touched_nodes(events: DataFrame) -> DataFrame:
    """(event_id, ts, node), one row for each node that an event touches."""
    return events.select("event_id", "ts", F.explode(F.array_compact(F.array(*_event_nodes().values()))).alias("node"))


def graph_nodes(events: DataFrame) -> DataFrame:
    """(node, event_count, first_seen, last_seen); sums are made in each task first, so a hub costs a row a task."""
    return touched_nodes(events).groupBy("node").agg(F.count("*").alias("event_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def graph_edges(events: DataFrame) -> DataFrame:
    """(src, dst, type, weight, first_seen, last_seen)."""
    n = _event_nodes()
    wrote = F.when(F.col("action").isin("write", "create"), "wrote").otherwise("read")
    ends = [("host", "process", F.lit("executed")), ("parent", "process", F.lit("spawned")), ("host", "user", F.lit("authenticated")), ("process", "file", wrote), ("process", "socket", F.lit("connected"))]
    edges = F.array_compact(F.array(*(F.when(n[a].isNotNull() & n[b].isNotNull(), F.struct(n[a].alias("src"), n[b].alias("dst"), t.alias("type"))) for a, b, t in ends)))
    rows = events.select("ts", F.explode(edges).alias("e")).select("ts", "e.*")
    return rows.groupBy("src", "dst", "type").agg(F.count("*").alias("weight"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def attribute_detections(touched: DataFrame, detections: DataFrame) -> DataFrame:
    """(node, detection_count, detection_score): min(1, half the sum of scores)."""
    joined = touched.select("event_id", "node").distinct().join(detections.select("event_id", "score"), "event_id")
    return joined.groupBy("node").agg(F.count("*").alias("detection_count"), F.least(F.lit(1.0), F.sum("score") * 0.5).alias("detection_score"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse as (u, v)."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))


def _adjacent(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Edges as (u, v) on disk, one row for each; both ways are made as they are read."""
    ends = stored(edges.select("src", "dst").where("src <> dst"))
    return ends.select(F.col("src").alias("u"), F.col("dst").alias("v")) if directed else _both_ends(ends)


def _both_ends(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse as (u, v), from one reading of the edges."""
    ends = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


#: Nodes that are broadcast to the edges rather than met by a shuffle of all edges.
SENT_NODES = 100_000


def _sent(nodes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(nodes) if n <= SENT_NODES else nodes


def _layers(adjacent: DataFrame, seeds: DataFrame, cutoff: int | None) -> DataFrame:
    """(node, hops) over (u, v): the layers behind the seeds, up to ``cutoff`` or until nothing is added."""
    seen = layer = checkpointed(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    total = n = layer.count()
    k = 0
    while n and k != cutoff:
        k += 1
        reached = adjacent.join(_sent(layer.select(F.col("node").alias("u")), n), "u", "left_semi").select(F.col("v").alias("node")).distinct()
        layer = checkpointed(reached.join(_sent(seen.select("node"), total), "node", "left_anti").withColumn("hops", F.lit(k)))
        n = layer.count()
        total += n
        if n:
            seen = seen.unionByName(layer)
    return seen


def hop_distance(edges: DataFrame, seeds: DataFrame, cutoff: int, directed: bool = False) -> DataFrame:
    """(node, hops) of every node within ``cutoff`` hops of a seed (column node), the least number.

    Only the newest layer is joined, and each layer is checkpointed; the edges
    are written once for all hops, and each hop reads them where they lie unless
    a layer has over ``SENT_NODES`` nodes.
    """
    return _layers(_adjacent(edges, directed), seeds, cutoff)


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges both of whose ends lie within ``depth`` hops of a seed."""
    edges = checkpointed(edges)
    near = hop_distance(edges, seeds, depth).select("node")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)


def n_hop_edges(edges: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """Directed edges that leave a node at most n hops from a seed, so n + 1 layers of edges."""
    edges = checkpointed(edges)
    near = hop_distance(edges, seeds, n, directed=True).select(F.col("node").alias("src"))
    return edges.join(near, "src", "left_semi").select(edges.columns)


#: Names with these are left out of ego graphs.
SKIPPED_NAMES = (".dll", ".tmp")


def ego_graph(edges: DataFrame, target: DataFrame, radius: int = 2, skipped: tuple[str, ...] = SKIPPED_NAMES) -> DataFrame:
    """Undirected edges (a < b, each once) within ``radius`` of the target, without loops and skipped names."""
    plain = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    for s in skipped:
        plain = plain.where(~F.col("src").contains(s) & ~F.col("dst").contains(s))
    return subgraph(plain, target, radius)


def drop_self_loops(edges: DataFrame) -> DataFrame:
    """Edges between two different nodes; one with a null end stays, as it is no loop."""
    return edges.where(~F.coalesce(F.col("src") == F.col("dst"), F.lit(False)))


def neighbors(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """(node, direction) next to one node."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def cap_fanout(edges: DataFrame, n: int = 256) -> DataFrame:
    """Of each source the n edges seen last; the cap is the feature."""
    newest = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("last_seen"), "dst", "type"))
    return edges.withColumn("_n", newest).where(F.col("_n") <= n).drop("_n")


def expire_graph(nodes: DataFrame, edges: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """The nodes seen at or after the cutoff and the edges between them."""
    kept = nodes.where(F.col("last_seen") >= cutoff)
    keys = kept.select("node")
    return kept, edges.join(keys.withColumnRenamed("node", "src"), "src", "left_semi").join(keys.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and their weight."""
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree / (2 n - 2), times 1 + detection_score (0 where the column is null)."""
    n = nodes.agg(F.count("*").alias("n"))
    degree = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    value = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.coalesce("degree", F.lit(0)) / (2.0 * (F.col("n") - 1)) * (1 + F.coalesce("detection_score", F.lit(0.0))))
    return nodes.join(degree, "node", "left").join(F.broadcast(n)).select("node", value.alias("centrality"))


def subgraph_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(score): 0.7 of the mean detection score and 0.3 of the weight a node, full at 32."""
    a = nodes.agg(F.avg(F.coalesce("detection_score", F.lit(0.0))).alias("mean"), F.count("*").alias("n")).join(edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")))
    score = 0.7 * F.col("mean") + 0.3 * F.least(F.lit(1.0), F.col("w") / F.greatest(F.lit(1), F.col("n")) / 32.0)
    return a.select(F.coalesce(F.least(F.lit(1.0), score), F.lit(0.0)).alias("score"))


def _reachable(step: DataFrame, hops: int) -> list[DataFrame]:
    """For 0 to ``hops`` hops (node, far_hot, far_bonus): the greatest score and the greatest bonus that any walk from a node can still meet."""
    none = [F.lit(0.0).alias("far_hot"), F.lit(0.0).alias("far_bonus")]
    out = [step.select(F.col("src").alias("node"), *none).distinct()]
    for _ in range(hops):
        behind = step.join(out[-1].withColumnRenamed("node", "dst"), "dst", "left")
        hot, bonus = F.greatest("hot", F.coalesce("far_hot", F.lit(0.0))), F.col("bonus") + F.coalesce("far_bonus", F.lit(0.0))
        out.append(checkpointed(behind.groupBy(F.col("src").alias("node")).agg(F.max(hot).alias("far_hot"), F.max(bonus).alias("far_bonus"))))
    return out


def suspicious_paths(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4, min_score: float = 0.3) -> DataFrame:
    """(path, score): simple directed paths from seeds of at most ``max_depth`` nodes whose score is high enough.

    The score is the greatest detection score behind the seed; paths of three
    nodes and more gain 0.15 for each connected edge and 0.05 for each wrote edge.

    A path goes on only where it can still reach ``min_score``: from each node
    the best that the hops left can add is known before, so edges that are
    below it with the best path so far are not joined, and of what is joined only
    paths that can get there are made.
    """
    bonus = F.sum(F.when(F.col("type") == "connected", 0.15).when(F.col("type") == "wrote", 0.05).otherwise(0.0))
    step = edges.groupBy("src", "dst").agg(bonus.alias("bonus")).join(nodes.select(F.col("node").alias("dst"), F.coalesce("detection_score", F.lit(0.0)).alias("hot")), "dst")
    step = checkpointed(step.where("src <> dst"))
    far = _reachable(step, max_depth - 2)
    known = nodes.select("node").join(seeds.select("node"), "node", "left_semi").distinct()
    layer = known.select(F.array("node").alias("path"), F.col("node").alias("end"), F.lit(0.0).alias("hot"), F.lit(0.0).alias("bonus"))
    # sums are compared in another order than they are made in
    least = min_score - 1e-9
    found = []
    for length in range(2, max_depth + 1):
        best = layer.agg(F.max("hot"), F.max("bonus")).first()
        if best[0] is None:
            break
        # what an edge and the hops behind it can add
        reach = far[max_depth - length]
        ahead = step.join(reach.withColumnRenamed("node", "dst"), "dst", "left").select(
            "src", "dst", F.col("hot").alias("e_hot"), F.col("bonus").alias("e_bonus"),
            F.greatest("hot", F.coalesce("far_hot", F.lit(0.0))).alias("most_hot"), (F.col("bonus") + F.coalesce("far_bonus", F.lit(0.0))).alias("most_bonus"),
        )
        ahead = ahead.where(F.greatest(F.lit(best[0]), F.col("most_hot")) + F.lit(best[1]) + F.col("most_bonus") >= least)
        can = F.greatest("hot", "most_hot") + F.col("bonus") + F.col("most_bonus") >= least
        nxt = layer.join(ahead, (F.col("end") == F.col("src")) & can & ~F.array_contains("path", F.col("dst")))
        layer = checkpointed(
            nxt.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"), F.greatest("hot", "e_hot").alias("hot"), (F.col("bonus") + F.col("e_bonus")).alias("bonus"))
        )
        score = F.least(F.lit(1.0), F.col("hot") + (F.col("bonus") if length >= 3 else F.lit(0.0)))
        found.append(layer.select("path", score.alias("score")).where(F.col("score") >= min_score))
    if not found:
        return layer.select("path", F.lit(0.0).alias("score")).where("false")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: Neighbours of a node in one part of the join that spreads labels.
HUB_PART = 10_000


def _vertex(hop: int, slice_: str = "slice", node: str = "node") -> Column:
    return F.concat_ws(":", F.lit(hop), F.col(slice_).cast("string"), F.col(node))


def _spread(layer: DataFrame, adjacent: DataFrame, hubs: DataFrame) -> DataFrame:
    """(node, slice, first, last, origin): a layer's rows at the neighbours of their nodes.  A hub's neighbours are dealt to parts, each of which gets its rows."""
    parts = F.coalesce("parts", F.lit(1))
    ends = adjacent.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"))
    sent = layer.withColumnRenamed("node", "u").join(hubs, "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return sent.join(ends, ["u", "part"]).select(F.col("v").alias("node"), "slice", "first", "last", F.col("u").alias("origin"))


def _with_run(spans: DataFrame, keys: list[str], window: float, name: Column, order: list[str]) -> DataFrame:
    """``spans`` (first, last) with ``run``: the name of the first of those that follow one another at one key by at most ``window``."""
    w = Window.partitionBy(*keys).orderBy("first", *order)
    until = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_starts", until.isNull() | (F.col("first") - until > window))
    return marked.withColumn("run", F.last(F.when(F.col("_starts"), name), ignorenulls=True).over(w)).drop("_starts")


def _runs(cells: DataFrame, window: float) -> tuple[DataFrame, DataFrame]:
    """Cells (node, slice, first, last) with their run, and the runs as (node, slice, first, last); a run is known by its first slice."""
    cells = stored(_with_run(cells, ["node"], window, F.col("slice"), ["slice"]))
    return cells, stored(cells.groupBy("node", F.col("run").alias("slice")).agg(F.min("first").alias("first"), F.max("last").alias("last")))


def correlate(touched: DataFrame, window: float = 300.0, edges: DataFrame | None = None, radius: int = 0) -> DataFrame:
    """(event_id, group_id): detections near each other in the graph and in time form groups, named by their least event.

    touched: (event_id, ts, node) of detections; edges: (src, dst), for a
    radius above 0.  Two detections belong together if they lie within
    ``window`` seconds and a node of one within ``radius`` hops of a node of the
    other.  Rows without a time or a node are left out.

    No pairs are made.  Time is cut into slices of a window, and what touches a
    node within a slice is one cell, as it belongs together anyway.  Cells of a
    node that follow one another by at most a window are one run: whatever comes
    within a window of a run's span is within a window of a detection in it.
    Runs spread over radius // 2 hops and are joined to runs again where they
    meet: what meets at a node is at most a radius apart.  For an odd radius, runs
    at both ends of an edge are joined too.  Groups are the components of these links.

    A node with one neighbour need not be spread to: what would meet there meets
    at its neighbour, to which it is spread itself.  So rows are those of
    the runs times the neighbours that have others.  A node that everything touches costs
    a row for each slice, and its neighbours go to many tasks.
    """
    if radius and edges is None:
        raise ValueError("a radius needs edges")
    # the rows are written as they are; cells are made in each task before a shuffle
    rows = stored(touched.where("ts is not null and node is not null").select("event_id", "ts", "node", F.floor(F.col("ts") / window).cast("long").alias("slice")))
    cells, layer = _runs(rows.groupBy("node", "slice").agg(F.min("ts").alias("first"), F.max("ts").alias("last")), window)
    # the nodes of one event belong together
    of_event = rows.join(cells.select("node", "slice", "run"), ["node", "slice"]).select("event_id", _vertex(0, "run").alias("v"))
    of_event = stored(of_event.groupBy("event_id").agg(F.array_sort(F.collect_set("v")).alias("at")))
    # events at the same runs give the same links
    homes = of_event.select("at").distinct()
    links = [homes.select(F.explode("at").alias("src"), F.col("at")[0].alias("dst"))]
    if radius:
        adjacent = both_ways(edges).where("u <> v and u is not null and v is not null").distinct()
        ends = adjacent.groupBy("u").agg(F.count("*").alias("degree"))
        adjacent = adjacent.join(ends, "u").join(ends.select(F.col("u").alias("v"), F.col("degree").alias("v_degree")), "v")
        adjacent = checkpointed(adjacent.select("u", "v", "degree", "v_degree"))
        # of two nodes that have only each other one is spread to
        inner = adjacent.where((F.col("v_degree") > 1) | ((F.col("degree") == 1) & (F.col("u") > F.col("v"))))
        hubs = checkpointed(adjacent.groupBy("u").agg(F.ceil(F.max("degree") / HUB_PART).cast("int").alias("parts")).where("parts > 1"))
    for hop in range(1, radius // 2 + 1):
        reached = _spread(layer, inner.select("u", "v"), hubs).unionByName(layer.withColumn("origin", F.col("node")))
        reached = checkpointed(reached.withColumnRenamed("slice", "before").withColumn("slice", F.floor(F.col("first") / window).cast("long")))
        cells, layer = _runs(reached.groupBy("node", "slice").agg(F.min("first").alias("first"), F.max("last").alias("last")), window)
        at = reached.join(cells.select("node", "slice", "run"), ["node", "slice"])
        links.append(at.select(_vertex(hop - 1, "before", "origin").alias("src"), _vertex(hop, "run").alias("dst")))
    if radius % 2:
        # an edge to a node with one neighbour joins nothing more once something was spread
        across = adjacent.where("degree > 1 and v_degree > 1") if radius > 1 else adjacent
        far, edge = _vertex(radius // 2, node="origin"), [F.least("node", "origin").alias("a"), F.greatest("node", "origin").alias("b")]
        met = _spread(layer, across.select("u", "v"), hubs).select(*edge, "first", "last", far.alias("end"))
        met = _with_run(met, ["a", "b"], window, F.col("end"), ["end"])
        links.append(met.where("end <> run").select(F.col("end").alias("src"), F.col("run").alias("dst")))
    together = links[0]
    for more in links[1:]:
        together = together.unionByName(more)
    found = of_event.select("event_id", F.col("at")[0].alias("node"))
    # groups get their names by runs, of which there are fewer than events
    heads = found.groupBy("node").agg(F.min("event_id").alias("least")).join(connected_components(together), "node")
    names = heads.groupBy("component").agg(F.min("least").alias("group_id"))
    return found.join(heads.join(names, "component").select("node", "group_id"), "node").select("event_id", "group_id")


def rescale_edge_weights(edges: DataFrame, seeds: DataFrame, hops: int = 2, flag_at: float = 0.2) -> DataFrame:
    """Edges of the subgraph with weights scaled to 0 .. 1 and a flag from ``flag_at`` on."""
    near = subgraph(edges, seeds, hops)
    span = near.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return near.join(F.broadcast(span)).select("src", "dst", "weight", scaled.alias("scaled")).withColumn("flagged", F.col("scaled") >= flag_at)


def relaxed_confusion(predicted: DataFrame, truth: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Counts of node sets; a false positive near a truth is forgiven, a miss near a hit counts as found."""
    # each is read by several counts, and the edges by both searches
    adjacent = _adjacent(edges)
    p, t = checkpointed(predicted.select("node").distinct()), checkpointed(truth.select("node").distinct())
    hits = checkpointed(p.join(t, "node", "left_semi"))
    near_truth, near_hit = _layers(adjacent, t, hops).select("node"), _layers(adjacent, hits, hops).select("node")
    fp = p.join(t, "node", "left_anti").join(near_truth, "node", "left_anti")
    missed = t.join(p, "node", "left_anti")
    found, fn = missed.join(near_hit, "node", "left_semi"), missed.join(near_hit, "node", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = count(hits, "h").join(count(found, "m")).join(count(fp, "fp")).join(count(fn, "fn")).join(count(nodes.select("node").distinct(), "n"))
    return row.select((F.col("h") + F.col("m")).alias("tp"), "fp", "fn", (F.col("n") - F.col("h") - F.col("m") - F.col("fp") - F.col("fn")).alias("tn"))


def export_cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON element for each node and edge."""
    n = nodes.select(F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct(F.col("node").alias("id")).alias("data"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.lit("edges").alias("group"), F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("label")).alias("data"))).alias("element"))
    return n.unionByName(e)


def export_dot(edges: DataFrame) -> DataFrame:
    """One DOT line for each edge."""
    return edges.select(F.format_string('"%s" -> "%s" [label="%s"];', "src", "dst", "type").alias("element"))


def prune_shared_periphery(g1: DataFrame, g2: DataFrame, target: str, max_rounds: int = 1_000) -> DataFrame:
    """Undirected edges (src < dst) of g1 after its outermost nodes were compared with g2, layer by layer.

    A node of the layer that g2 has too goes if its neighbours are the same in
    both; else the edges to neighbours that both have go.  All nodes of a layer
    change at once.  Each round looks at the layer that is then outermost, as
    far as the target reaches, and the end is when nothing changes.
    """
    plain = lambda g: g.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    # of a node's edges those that both graphs have go, whether that is all of them or not
    both = plain(g1).join(plain(g2).withColumn("shared", F.lit(True)), ["src", "dst"], "left")
    left = stored(both.select("src", "dst", F.coalesce("shared", F.lit(False)).alias("shared")))
    reach = checkpointed(_layers(_both_ends(left), g1.sparkSession.createDataFrame([(target,)], "node string"), None))
    for _ in range(max_rounds):
        outer = reach.agg(F.max("hops")).first()[0]
        if not outer:
            break
        layer = checkpointed(reach.where(F.col("hops") == outer).select("node"))
        n = layer.count()
        at = lambda end: _sent(layer.select(F.col("node").alias(end), F.lit(True).alias(f"at_{end}")), n)  # noqa: E731, B023
        marked = left.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
        kept = stored(marked.where(~(F.col("shared") & (F.col("at_src").isNotNull() | F.col("at_dst").isNotNull()))).select("src", "dst", "shared"))
        if kept.count() == left.count():
            break
        left = kept
        # no other node was reached through the outermost ones, so only they are sought again
        inner = reach.where(F.col("hops") < outer)
        around = stored(_both_ends(left).join(_sent(layer.select(F.col("node").alias("v")), n), "v", "left_semi"))
        again = _layers(around, inner.where(F.col("hops") == outer - 1), None).where("hops > 0")
        reach = checkpointed(inner.unionByName(again.withColumn("hops", F.col("hops") + F.lit(outer - 1))))
    else:
        raise RuntimeError(f"the periphery did not settle in {max_rounds} rounds")
    return left.select("src", "dst")
