"""Following files that grow, rotate and are truncated; no line twice, none lost, over restarts."""

import os

import pytest

from sentrylake.streaming import follow, streams


@pytest.fixture
def run(spark, tmp_path):
    """Runs the query over what is there, from its checkpoint, and gives all lines so far."""
    logs = tmp_path / "logs"
    logs.mkdir()

    def go(path=logs, **options):
        out, state = f"{tmp_path}/out", f"{tmp_path}/state"
        streams.run_available(follow.follow_lines(spark, str(path), **options), streams.batch_sink(out), state)
        return sorted(r["line"] for r in spark.read.schema("line string, file string, start long").parquet(out).collect()) if os.path.isdir(out) else []

    go.logs = logs
    return go


def put(path, *lines, end="\n", mode="a"):
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write("\n".join(lines) + end)


def test_appended_lines(run):
    put(run.logs / "a.log", "one", "two")
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    put(run.logs / "a.log", "three")
    put(run.logs / "b.log", "four\r", "", "ünï")
    assert run() == ["", "four", "one", "three", "two", "ünï"]


def test_a_line_without_an_end_waits(run):
    put(run.logs / "a.log", "one", "tw", end="")
    assert run() == ["one"]
    put(run.logs / "a.log", "o", "three", end="")
    assert run() == ["one", "two"]
    put(run.logs / "a.log", "")
    assert run() == ["one", "three", "two"]
    # a file whose first line has no end is not known yet
    put(run.logs / "new.log", "half", end="")
    assert run() == ["one", "three", "two"]
    put(run.logs / "new.log", " line")
    assert run() == ["half line", "one", "three", "two"]


def test_rotation(run):
    put(run.logs / "a.log", "1 one")
    assert run() == ["1 one"]
    # what was written before the rotation is read under the new name, what comes after it from the new file
    put(run.logs / "a.log", "2 two")
    os.rename(run.logs / "a.log", run.logs / "a.log.1")
    put(run.logs / "a.log", "3 three")
    assert run() == ["1 one", "2 two", "3 three"]
    os.rename(run.logs / "a.log.1", run.logs / "a.log.2")
    os.rename(run.logs / "a.log", run.logs / "a.log.1")
    put(run.logs / "a.log.1", "4 four")
    put(run.logs / "a.log", "5 five")
    assert run() == ["1 one", "2 two", "3 three", "4 four", "5 five"]
    os.remove(run.logs / "a.log.2")
    put(run.logs / "a.log", "6 six")
    assert run()[-1] == "6 six" and len(run()) == 6


def test_truncation(run):
    put(run.logs / "a.log", "one", "two", "three")
    assert len(run()) == 3
    put(run.logs / "a.log", "new", mode="w")
    assert run() == ["new", "one", "three", "two"]
    # also where the new content is longer than the old one
    put(run.logs / "a.log", "other", *(f"line {i}" for i in range(50)), mode="w")
    assert len(run()) == 4 + 51
    # and where the first line is the same but the file is shorter
    put(run.logs / "a.log", "other", "again", mode="w")
    assert len(run()) == 4 + 51 + 2


def test_from_the_end(run):
    put(run.logs / "a.log", "old")
    assert run(from_start=False) == []
    put(run.logs / "a.log", "new")
    put(run.logs / "b.log", "of a new file")
    assert run(from_start=False) == ["new", "of a new file"]


def test_ranges_do_not_cut_lines(run):
    lines = [f"{i} " + "x" * (i % 37) for i in range(2_000)]
    put(run.logs / "a.log", *lines)
    assert run(range_bytes=101) == sorted(lines)
    more = [f"more {i}" for i in range(300)]
    put(run.logs / "a.log", *more)
    assert run(range_bytes=13) == sorted(lines + more)


def test_patterns_and_hidden_files(run):
    put(run.logs / "a.log", "a")
    put(run.logs / "b.txt", "b")
    put(run.logs / "_SUCCESS", "hidden")
    put(run.logs / ".c.log", "hidden")
    assert run(run.logs / "*.log") == ["a"]


def test_renamed_between_planning_and_reading(tmp_path):
    put(tmp_path / "a.log", "one", "two")
    reader = follow.FollowReader(str(tmp_path), True, 1 << 20, True)
    (part,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    put(tmp_path / "a.log", "three")
    assert [line for line, _, _ in reader.read(part)] == ["one", "two"]
    os.remove(tmp_path / "a.log.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))
    reader.fail_on_loss = False
    assert list(reader.read(part)) == []


def test_paths():
    assert follow.local_path("file:///a/b") == follow.local_path("file:/a/b") == follow.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        follow.local_path("s3a://bucket/logs")


def test_a_query_that_goes_on(spark, tmp_path):
    """With an interval, lines that are written while the query runs are found."""
    import time

    logs = tmp_path / "logs"
    logs.mkdir()
    put(logs / "a.log", "one")
    out = f"{tmp_path}/out"
    query = streams.run_every(follow.follow_lines(spark, str(logs)), streams.batch_sink(out), f"{tmp_path}/state", "200 milliseconds")
    try:
        for want in (["one"], ["one", "two"]):
            for _ in range(100):
                got = sorted(r["line"] for r in spark.read.schema("line string").parquet(out).collect()) if os.path.isdir(out) else []
                if got == want:
                    break
                time.sleep(0.2)
            assert got == want
            put(logs / "a.log", "two")
    finally:
        query.stop()


def test_parsed_lines(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    put(tmp_path / "logs" / "a.log", '{"ts": 1, "hostname": "H1", "cmd": "powershell -enc QUJD"}', "<3>Jan  2 03:04:05 box sshd[7]: failed", "", "plain", "{broken")
    events = streams.parsed_events(follow.follow_lines(spark, str(tmp_path / "logs")), 2024)
    streams.run_available(events, streams.batch_sink(f"{tmp_path}/out"), f"{tmp_path}/state")
    rows = {r["source"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows["json"]["host"] == "h1" and rows["json"]["command_line"].startswith("powershell") and rows["syslog"]["pid"] == 7 and rows["raw"]["message"] in ("plain", "{broken")
