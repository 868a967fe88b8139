"""What a query moves, sends and holds grows no faster than its input."""

import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from sentrylake.operators import attribution, graph, influence, ml, representatives, store, word_vectors
from sentrylake.plans import file_queries, graph_queries, ingest_queries
from sentrylake.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_embedding_carries_no_vector_for_each_occurrence(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "x"] * 50), (2, ["b"]), (3, ["x"]), (4, [])], "node long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [0.5, -1.0, 4.0])], "word string, vector array<double>")
    out = ml.embed_documents(docs, vectors, 3)
    assert "Window" not in plan(out)
    got = {r["node"]: r["x"] for r in out.collect()}
    known = {1: ["a", "b", "a"] * 50, 2: ["b"]}
    of = {"a": [1.0, 2.0, 3.0], "b": [0.5, -1.0, 4.0]}
    for node, words in known.items():
        want = [np.mean([of[w][i] + (math.sin if i % 2 == 0 else math.cos)(p * math.exp(-(i - i % 2) * math.log(10000.0) / 3)) for p, w in enumerate(words)]) for i in range(3)]
        assert np.allclose(got[node], want, atol=1e-9)
    assert got[3] == got[4] == [0.0] * 3


def test_influence_hands_flat_chunks_to_python(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"e{i % 3}", i % 3, [float(v) for v in rng.normal(i % 3, 1.0, 2)]) for i in range(90)]
    train = spark.createDataFrame(rows, "entity string, label int, x array<double>")
    asked = [(i, f"e{i // 4 % 2}" if i % 4 == 0 else None, rows[i][2]) for i in range(90)]
    test = spark.createDataFrame(asked, "node long, entity string, x array<double>")
    seen, before = [], influence.checkpointed
    monkeypatch.setattr(influence, "checkpointed", lambda df: seen.append(plan(df)) or before(df))
    whole = {(r["omitted"], r["entity"]): r["score"] for r in influence.influence_scores(train, test).collect()}
    # objects for nodes were handed over a batch of chunks at a time
    assert not any("MapInPandas" in p and "nodes" in p for p in seen)
    monkeypatch.setattr(influence, "CHUNK", 7)
    parts = {(r["omitted"], r["entity"]): r["score"] for r in influence.influence_scores(train, test).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 8
    assert all(math.isclose(whole[k], parts[k], rel_tol=1e-6, abs_tol=1e-6) for k in whole)


def _pruned(left, right, target):
    """The layers in plain Python: a node's edges that both graphs have go, the outermost layer first."""
    left, right = ({tuple(sorted(e)) for e in g if e[0] != e[1]} for g in (left, right))
    while True:
        hops, layer = {target: 0}, {target}
        while layer:
            layer = {b for e in left for a, b in (e, e[::-1]) if a in layer} - hops.keys()
            hops |= {n: max(hops.values()) + 1 for n in layer}
        outer = max(hops.values())
        rim = {n for n, h in hops.items() if h == outer}
        gone = {e for e in left & right if rim & set(e)} if outer else set()
        if not gone:
            return left
        left = left - gone


def test_periphery_is_not_sought_from_the_target_each_round(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rounds, before = [], graph._layers
    monkeypatch.setattr(graph, "_layers", lambda adjacent, seeds, cutoff: rounds.append(seeds.count()) or before(adjacent, seeds, cutoff))
    for trial in range(3):
        left = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 24, (30, 2)).tolist()] + [(f"n{i}", f"n{i + 1}") for i in range(6)]
        right = [e for e in left if rng.random() < 0.8]
        got = graph.prune_shared_periphery(spark.createDataFrame(left, "src string, dst string"), spark.createDataFrame(right, "src string, dst string"), "n0").collect()
        assert {tuple(r) for r in got} == _pruned(left, right, "n0")
    assert max(rounds) > 1


def test_small_layers_do_not_shuffle_the_edges(spark, monkeypatch):
    seen, before = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: seen.append(plan(df)) or before(df))
    edges = spark.range(200).select((F.col("id") % 20).cast("string").alias("src"), (F.col("id") % 31).cast("string").alias("dst"))
    hops = {r["node"]: r["hops"] for r in graph.hop_distance(edges, spark.createDataFrame([("3",)], "node string"), 3).collect()}
    assert hops["3"] == 0 and len(hops) == 31
    assert not any("SortMergeJoin" in p for p in seen)


def test_rounds_of_clusters_do_not_move_the_points(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 3, i, [float(v) for v in rng.normal(i % 2, 0.1, 4)]) for i in range(600)]
    points = spark.createDataFrame(rows, "program int, instance long, x array<double>")
    seen, before = [], representatives.checkpointed
    monkeypatch.setattr(representatives, "checkpointed", lambda df: seen.append(df) or before(df))
    out = representatives.cluster_programs(points, 2, rounds=3, part_rows=50)
    assert out.count() == 600
    # the centres are sent to the points, which were dealt once
    assert "CoGroup" not in plan(out) and "SortMergeJoin" not in plan(out)
    by_cluster = {}
    for r in out.collect():
        by_cluster.setdefault((r["program"], r["cluster"]), set()).add(r["instance"] % 2)
    assert all(len(v) == 1 for v in by_cluster.values()) and len(by_cluster) == 6


def test_shards_share_one_pass_over_the_test_nodes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    train = spark.createDataFrame([(f"e{i % 8}", i % 3, [float(v) for v in rng.normal(i % 3, 1.0, 2)]) for i in range(240)], "entity string, label int, x array<double>")
    test = spark.createDataFrame([(i, f"t{i % 2}" if i % 3 == 0 else None, [float(v) for v in rng.normal(1, 1.0, 2)]) for i in range(60)], "node long, entity string, x array<double>")
    passes, before = [], attribution._scored
    monkeypatch.setattr(attribution, "_scored", lambda *a: passes.append(1) or before(*a))
    got = {(r["shard"], r["omitted"], r["entity"]): r["score"] for r in attribution.sharded_leave_one_out(train, test, 4).collect()}
    assert len(passes) == 1 and len(got) == 4 * 3 * 2
    of = {o: s for s, o, _ in got if o != "zeroth"}
    for shard in range(4):
        own = train.where(F.col("entity").isin([e for e, s in of.items() if s == shard]))
        alone = {(shard, r["omitted"], r["entity"]): r["score"] for r in attribution.leave_one_out_scores(own, test).collect()}
        assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in alone.items()) and len(alone) == 6


def test_users_of_files_are_broadcast(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"datum":{"com.bbn.tc.schema.avro.cdm20.Event":{"type":"E"}},"userId":"u1"}\n')
    out = files.read_cdm_events(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan(out) and [r["userid"] for r in out.collect()] == ["u1"]


def test_written_provenance_is_compressed(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(file_queries.files, "read_cdm_events", lambda s, path: kept.append(path) or spark.range(0).selectExpr(*(f"'' as {c}" for c in ("actorID", "objectID", "action", "timestampNanos", "exec", "userid")), "map('a', 'b') as properties"))
    file_queries.read_cdm_events(spark, sf)
    assert all(f.endswith(".gz") for f in os.listdir(kept[0]) if f.startswith("part"))


def test_predictions_are_not_joined_to_themselves(spark):
    rng = np.random.default_rng(6)
    nodes = spark.createDataFrame([(i, [float(v) for v in rng.normal(i % 3, 1.0, 2)], i % 3) for i in range(60)], "node long, x array<double>, label int")
    out = attribution.predict_node_types(attribution.fit_node_types(nodes), nodes)
    assert "HashJoin" not in plan(out) and "SortMergeJoin" not in plan(out)
    sure = [r["confidence"] for r in out.collect()]
    assert len(sure) == 60 and min(sure) == 0.0 and max(sure) < 1.0


def test_touched_rows_are_not_joined_or_shuffled_before_cells(spark, sf, monkeypatch):
    seen, before = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: seen.append(plan(df)) or before(df))
    touched = graph_queries.hot_touched(spark, sf, 0.75)
    assert "Join" not in plan(touched) and "Exchange" not in plan(touched)
    assert graph.correlate(touched, 1800.0).count() > 0
    assert seen and "Exchange" not in seen[0]


def test_appended_rows_meet_in_parts_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(store, "APPEND_ROWS", 100, raising=False)
    stored = spark.createDataFrame([(i, "s") for i in range(0, 900, 3)] + [(None, "s")], "k int, v string")
    arriving = spark.createDataFrame([(i, v) for i in range(900) for v in ("b", "a")] + [(None, "z"), (None, "y")], "k int, v string")
    out = store.append_new(stored, arriving, "k")
    assert "BroadcastHashJoin" not in plan(out)
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r["k"] or -1, r["v"]) for r in got if r["k"] != 0) == sorted([(i, "a") for i in range(900) if i % 3] + [(-1, "y")])
    assert len({r["part"] for r in got}) > 15


def test_lines_are_dealt_before_they_are_parsed(spark, sf):
    out = plan(ingest_queries.parse_lines(spark, sf))
    # the events' one row group was parsed in one task
    assert out.index("Generate explode") < out.index("Exchange hashpartitioning(event_id")


def test_vocabulary_does_not_go_through_the_driver(spark, monkeypatch):
    draw = random.Random(8)
    kinds = [[f"{k}{i}" for i in range(150)] for k in "ab"]
    docs = spark.createDataFrame([([draw.choice(kinds[n % 2]) for _ in range(60)],) for n in range(500)], "tokens array<string>")
    monkeypatch.setattr(ml.word_vectors, "PART", 8000)
    out = ml.fit_token_embeddings(docs, size=8)
    # Spark ML's model is a local table of all words
    assert "LocalTableScan" not in plan(out)
    vector = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in out.collect()}
    assert set(vector) == {*kinds[0], *kinds[1]}
    a, b = (np.array([vector[w] for w in kind]) for kind in kinds)
    # four parts, whose vectors agree
    every = np.vstack([a, b])
    nearest = (every @ every.T - 3 * np.eye(300)).argmax(1)
    assert np.mean((nearest < 150) == (np.arange(300) < 150)) > 0.97
    assert np.mean(a @ a.T) > np.mean(a @ b.T) + 0.5 and np.mean(b @ b.T) > np.mean(a @ b.T) + 0.5


def test_pieces_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(word_vectors, "PIECE", 7)
    docs = spark.createDataFrame([([str(i) for i in range(n)],) for n in (23, 7, 8, 1, 0)] + [(None,), (["x", None, "y"],)], "tokens array<string>")
    got = []
    for r in word_vectors.pieces(docs, "tokens", 5).collect():
        t = r["tokens"]
        got += [(t[i], t[j]) for i in range(len(t)) for j in range(len(t)) if 0 < abs(i - j) <= 5 and (i >= r["lead"] or j >= r["lead"])]
    want = [(str(i), str(j)) for n in (23, 7, 8) for i in range(n) for j in range(n) if 0 < abs(i - j) <= 5] + [("x", "y"), ("y", "x")]
    assert sorted(got) == sorted(want)


def test_a_pass_moves_along_the_gradient(monkeypatch):
    """A block against plain loops: pairs in a window, fewer by distance, not across pieces and not of two leading words."""
    rng = np.random.default_rng(2)
    words, piece, lead = rng.integers(0, 9, 40), np.repeat([0, 1, 2], [15, 5, 20]), np.isin(np.arange(40), [15, 16, 20])
    start = word_vectors.start_vectors(np.array([f"w{i}" for i in range(9)], dtype=object), 4, 1)
    got = start.copy()
    monkeypatch.setattr(word_vectors, "BLOCK", 16)
    word_vectors.train(words, piece, lead, got, 3, 2, 1.0, 1)
    vectors, others, seen = start.astype(float), np.zeros((9, 4)), np.ones((2, 9))
    noise = np.random.default_rng(1).permutation(words)
    weight = lambda i, j: 0.0 if not 0 < abs(i - j) <= 3 or piece[i] != piece[j] or (lead[i] and lead[j]) else 1 - (abs(i - j) - 1) / 3
    for at in range(0, 40, 16):
        block, steps = range(at, min(at + 16, 40)), ([], [])
        dx = {}
        for i in block:
            dy = np.zeros(4)
            for j in range(40):
                g = weight(i, j) / (1 + math.exp(vectors[words[j]] @ others[words[i]]) / 2)
                dy, dx[j] = dy + g * vectors[words[j]], dx.get(j, np.zeros(4)) + g * others[words[i]]
            steps[1].append((words[i], dy))
        for i in block:
            for k in range(2):
                w, x = noise[(at * 2 + k * len(block) + i - at) % 40], vectors[words[i]]
                g = sum(weight(i, j) for j in range(40)) / (1 + 2 * math.exp(-x @ others[w]))
                dx[i] = dx[i] - g * others[w]
                steps[1].append((w, -g * x))
        steps[0].extend((words[j], d) for j, d in dx.items())
        for table, s, moved in ((vectors, seen[0], steps[0]), (others, seen[1], steps[1])):
            for w, d in moved:
                s[w] += d @ d
            for w, d in moved:
                table[w] += d / math.sqrt(s[w])
    assert np.abs(got - start).max() > 0.05 and np.allclose(got, vectors, atol=1e-5)


def test_rare_words_leave_before_the_windows(spark):
    docs = spark.createDataFrame([(["a", "z", "b", "a"],), (["b", None],), (None,)], "tokens array<string>")
    kept = sorted(r["tokens"] for r in ml._without_rare(docs, "tokens", 2).collect())
    assert kept == [["a", "b", "a"], ["b"]]
    assert {r["word"] for r in ml.fit_token_embeddings(docs, size=2, min_count=2).collect()} == {"a", "b"}
