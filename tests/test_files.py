"""Readers and writers on small files, some of them malformed."""

import gzip
import json

from pyspark.sql import functions as F

from sentrylake.operators import rules
from sentrylake.sources import files


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_event_jsonl(spark, tmp_path):
    lines = '{"ts": 1700000000, "hostname": "H", "process": {"name": "p", "pid": "12"}}\nnot json\n[1]\n{"event_type": "FILE", "path": "/a", "pid": "x", "user": {"name": "u"}}\n'
    with gzip.open(tmp_path / "e.jsonl.gz", "wt") as f:
        f.write(lines)
    rows = {r["event_type"]: r for r in files.read_event_jsonl(spark, str(tmp_path / "e.jsonl.gz")).collect()}
    assert len(rows) == 2
    assert (rows["process"]["host"], rows["process"]["process"], rows["process"]["pid"], rows["process"]["timestamp"]) == ("H", "p", 12, 1.7e9)
    assert (rows["file"]["file_path"], rows["file"]["pid"], rows["file"]["user"]) == ("/a", None, "u")


def feed(df):
    return sorted((r["type"], r["value"], round(r["confidence"], 2), r["tags"]) for r in df.collect())


def test_feeds(spark, tmp_path):
    csv = write(tmp_path, "f.csv", "indicator,type,score,labels\n1.2.3.4,,0.9,a; b\nEVIL.com,domain,,\n,ip,,\n")
    assert feed(files.load_feed(spark, csv)) == [("domain", "evil.com", 0.8, []), ("ip", "1.2.3.4", 0.8, ["a", "b"])]
    records = [{"type": "ip", "value": "1.1.1.1:80", "confidence": 0.5, "tags": ["x"]}, {"type": "ip"}, 3]
    assert feed(files.load_feed(spark, write(tmp_path, "f.json", json.dumps({"iocs": records})))) == [("ip", "1.1.1.1", 0.5, ["x"])]
    assert feed(files.load_feed(spark, write(tmp_path, "g.json", json.dumps(records)))) == [("ip", "1.1.1.1", 0.5, ["x"])]
    lines = "# no\n\n{bad\n" + json.dumps(records[0]) + "\n"
    assert feed(files.load_feed(spark, write(tmp_path, "f.jsonl", lines))) == [("ip", "1.1.1.1", 0.5, ["x"])]
    stix = {"indicators": [{"pattern": "[ipv4-addr:value = '9.9.9.9'] OR [file:hash = 'ABCDEF']", "confidence": 40, "labels": ["l"]}]}
    assert feed(files.load_feed(spark, write(tmp_path, "f.stix", json.dumps(stix)))) == [("hash_sha256", "abcdef", 0.4, ["l"]), ("ip", "9.9.9.9", 0.4, ["l"])]
    assert feed(files.load_feed(spark, write(tmp_path, "hosts", "0.0.0.0 www.bad.org # x\n#\n\n"))) == [("domain", "bad.org", 0.8, [])]


def test_traces(spark, tmp_path):
    tsv = write(tmp_path, "t.tsv", "a\tP\tb\tF\tread\t1\na\tP\tb\n")
    assert files.read_labelled_tsv(spark, tsv).count() == 1
    glued = write(tmp_path, "glued.txt", '{"a": 1}{"a": 2}\n{"a": 3}')
    assert sorted(r["a"] for r in files.read_concatenated_json(spark, glued, "a int").collect()) == [1, 2, 3]
    (tmp_path / "etw" / "x").mkdir(parents=True)
    write(tmp_path / "etw" / "x", "e.json", '{"Event": "FileIORead", "PID": 1, "args": {"FileName": "f"}}\n\n')
    write(tmp_path / "etw", "e.log", "{}")
    assert [r["args"] for r in files.read_etw_json(spark, str(tmp_path / "etw")).collect()] == [{"FileName": "f"}]
    event = {"datum": {"com.bbn.tc.schema.avro.cdm20.Event": {"type": "EVENT_READ", "subject": {"com.bbn.tc.schema.avro.cdm20.UUID": "S"}, "properties": {"map": {"exec": "vi"}}, "predicateObjectPath": {"string": "/x"}}}, "hostId": "h"}
    user = {"datum": {"com.bbn.tc.schema.avro.cdm20.Principal": {"userId": "7", "username": {"string": "root"}}}}
    cdm = write(tmp_path, "c.json", "\n".join(json.dumps(x, separators=(",", ":")) for x in (user, event, {"FILE_OBJECT_DIR": "20.Event"})))
    (row,) = files.read_cdm_events(spark, cdm).collect()
    assert (row["actorID"], row["objectID"], row["exec"], row["properties"], row["username"], row["userid"], row["cmdline"]) == ("S", "", "vi", {"objectpath": "/x"}, "root", "7", "")


def test_rules_from_json(spark):
    text = json.dumps([{"id": "R", "score": 0.5, "where": {"event_type": "process", "pid": {"op": ">", "value": 3}, "host": ["a", "b"], "command_line": {"regex": "x+"}}}])
    df = spark.createDataFrame([("process", 4, "A", "axx"), ("process", 3, "a", "x"), ("file", 9, "b", "x"), ("process", None, "a", "x")], "event_type string, pid int, host string, command_line string")
    assert df.where(F.size(rules.rule_hits(files.load_rules(text))) > 0).count() == 1


def test_bundle_and_suppressions(spark, tmp_path):
    bundle = {"objects": [{"type": "attack-pattern", "name": "N", "external_references": [{"external_id": "T1"}], "kill_chain_phases": [{"phase_name": "p"}]}, {"type": "attack-pattern"}, {"type": "x"}]}
    assert [tuple(r) for r in files.load_technique_bundle(spark, write(tmp_path, "b.json", json.dumps(bundle))).collect()] == [("T1", "N", ["p"])]
    lines = '{"rule_id": "r", "match": {"host": "h*", "user": "u"}}\n{"name": "no id"}\n'
    assert files.load_suppressions(spark, write(tmp_path, "s.json", lines)).count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "r")], "id int, tags array<string>, raw string")
    files.export_csv(df, str(tmp_path / "csv"), ["id", "tags"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["tags"] == '["a"]'
    assert files.flat_columns(df).columns == ["id", "raw"]
    manifest = files.export_bundle(str(tmp_path / "bundle"), events=df, detections=df.limit(0))
    assert {r["table"]: r["rows"] for r in manifest.collect()} == {"events": 1, "detections": 0}
    assert "raw" not in spark.read.json(str(tmp_path / "bundle/events")).columns
    vectors = df.select(F.lit("log").alias("kind"), F.array(F.lit(1.0)).alias("v"))
    files.save_embeddings(vectors, str(tmp_path / "v"))
    assert files.load_embeddings(spark, str(tmp_path / "v"), "log").count() == 1
