"""A table that batches are merged into: each batch once, one version for a reader, parts summed up."""

import random

import pytest

from sentrylake.streaming import keyed, streams

VALUES = {"n": "sum", "lo": "min", "hi": "max"}
SCHEMA = "k string, n long, lo double, hi double"


@pytest.fixture
def table(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], VALUES).create(SCHEMA)


def batch(spark, seed):
    draw = random.Random(seed)
    return spark.createDataFrame([(draw.choice("abcd"), 1, draw.random(), draw.random()) for _ in range(20)] + [(None, 1, 0.5, 0.5)], SCHEMA)


def plain(spark, seeds):
    out = {}
    for s in seeds:
        for k, n, lo, hi in batch(spark, s).collect():
            a = out.get(k, (0, 9.0, -9.0))
            out[k] = (a[0] + n, min(a[1], lo), max(a[2], hi))
    return sorted(((k, *v) for k, v in out.items()), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_batch_counts_once(spark, table):
    assert rows(table.read()) == []
    assert [table.merge(batch(spark, i), i) for i in (0, 1, 1, 0, 2)] == [True, True, False, False, True]
    assert rows(table.read()) == plain(spark, [0, 1, 2])
    # creating it again leaves it as it is
    assert rows(table.create(SCHEMA).read()) == plain(spark, [0, 1, 2])


def test_a_batch_that_failed_before_it_was_published(spark, table, monkeypatch):
    table.merge(batch(spark, 0), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(batch(spark, 1), 1)
    assert rows(table.read()) == plain(spark, [0])
    table.merge(batch(spark, 1), 1)
    assert rows(table.read()) == plain(spark, [0, 1])


def test_parts_are_summed_up_and_old_ones_go(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "COMPACT_AFTER", 2)
    for i in range(9):
        table.merge(batch(spark, i), i)
        assert len(table.manifest()["parts"]) <= 2
    assert rows(table.read()) == plain(spark, range(9))
    folders = [p.name for p in (tmp_path / "t").iterdir()]
    assert len(folders) <= keyed.EPOCHS + 2, folders


def test_a_reader_keeps_its_version(spark, table, monkeypatch):
    monkeypatch.setattr(keyed, "COMPACT_AFTER", 2)
    table.merge(batch(spark, 0), 0)
    before = table.read()
    # one more batch sums up the parts into another folder
    table.merge(batch(spark, 1), 1)
    assert rows(before) == plain(spark, [0])
    assert rows(table.read()) == plain(spark, [0, 1])


def test_a_manifest_that_is_only_half_written(spark, table, tmp_path):
    table.merge(batch(spark, 0), 0)
    table.merge(batch(spark, 1), 1)
    import shutil

    # the place of the newest version is gone, as while it is being written over: the one before counts
    shutil.rmtree(tmp_path / "t" / f"manifest-{table.manifest()['version'] % 2}")
    assert rows(table.read()) == plain(spark, [0])
    assert table.merge(batch(spark, 1), 1) and rows(table.read()) == plain(spark, [0, 1])


def test_graph_of_a_repeated_batch(spark, tmp_path):
    schema = "event_id long, ts double, host string, process string, pid int, parent_pid int, user string, event_type string, file_path string, dst_ip string, dst_port int, action string"
    events = spark.createDataFrame([(i, float(i), f"h{i % 2}", "p", i % 3, 1, "u", "process", f"/f{i % 4}", None, None, "write") for i in range(30)], schema)
    write = streams.graph_sink(spark, str(tmp_path / "g"))
    write(events.where("ts < 15"), 0)
    write(events.where("ts >= 15"), 1)
    write(events.where("ts >= 15"), 1)
    from sentrylake.operators import graph

    nodes, edges = streams.graph_tables(spark, str(tmp_path / "g"))
    assert rows(nodes.read()) == rows(graph.graph_nodes(events)) and rows(edges.read()) == rows(graph.graph_edges(events))
