import json

import pytest
from pyspark.sql import functions as F

from loomwatch.sources import ingest
from loomwatch.streaming import incremental

EVENTS = [
    {"EventID": 4103, "Channel": "Microsoft-Windows-PowerShell/Operational", "Hostname": "W5.lab.local", "EventTime": "2019-03-19 01:02:03"},
    {"EventID": 1, "Channel": "Microsoft-Windows-Sysmon/Operational", "Hostname": "W5.lab.local", "@timestamp": "2019-03-19T01:02:04.288Z", "CommandLine": "x"},
    {"EventID": 9999, "Channel": "Security", "Hostname": "W5.lab.local", "EventTime": "2019-03-19 01:02:05"},
]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "events"
    d.mkdir()
    (d / "cap.json").write_text("\n".join(json.dumps(e) for e in EVENTS) + "\n\n")
    meta = {"id": "CAP-1", "attack_mappings": [{"technique": "T1069", "sub-technique": "001", "tactics": ["TA0007"]}], "files": [{"type": "Host", "link": "https://example.org/x/cap.json"}]}
    m = tmp_path / "meta"
    m.mkdir()
    (m / "a.json").write_text(json.dumps(meta))
    return d, m


def test_single_technique(spark, folder):
    events, meta = folder
    out = ingest.normalise_single(ingest.read_events(spark, str(events)), ingest.read_metadata(spark, str(meta)), "set")
    rows = {r["fields"]["EventID"]: r for r in out.collect()}
    assert len(rows) == 3 and rows["9999"]["event_type"] == "other" and rows["1"]["event_type"] == "process"
    assert {r["attack_technique"] for r in rows.values()} == {"T1069"} and rows["1"]["attack_subtechnique"] == "001"
    assert rows["1"]["timestamp"].isoformat() == "2019-03-19T01:02:04.288000"
    assert len({r["id"] for r in rows.values()}) == 3
    assert rows["1"]["field_types"]["EventID"] == "BIGINT"


def test_other_sources(spark, folder):
    events = ingest.read_events(spark, str(folder[0]))
    compound = ingest.normalise_compound(events, "cap2", "set")
    benign = ingest.normalise_benign(events, "base", "baseline", start=5)
    assert compound.filter("technique_unresolved AND is_malicious").count() == 3
    assert benign.count() == 2 and sorted(r["id"].split(":")[2] for r in benign.collect()) == ["5", "6"]
    assert ingest.load_corpus(compound, compound, benign).count() == 8


def test_malformed_lines_raise(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        ingest.read_events(spark, str(tmp_path)).collect()


def test_missing_time_raises(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"EventID": 1, "EventTime": "soon"}')
    with pytest.raises(Exception, match="no event time"):
        ingest.normalise_compound(ingest.read_events(spark, str(tmp_path)), "c", "d").collect()


def test_flatten_nested(spark):
    nested = {
        "Event": {
            "#attributes": {"xmlns": "u"},
            "System": {"Provider": {"#attributes": {"Name": "P", "Guid": "G"}}, "EventID": {"#attributes": {}, "#text": 4624}, "Channel": "Security", "Computer": "W", "TimeCreated": {"#attributes": {"SystemTime": "2022-04-04T01:00:00Z"}}, "EventRecordID": 7, "Execution": {"#attributes": {"ProcessID": 1, "ThreadID": 2}}, "Level": 0},
            "EventData": {"TargetUserName": "-", "Channel": "data loses"},
        }
    }
    df = spark.createDataFrame([(json.dumps(nested),)], "value string")
    raw = ingest.flatten_nested(df).select(F.transform_values("raw", lambda k, v: v.cast("string")).alias("m")).first()["m"]
    assert raw["Channel"] == "Security" and raw["EventID"] == "4624" and raw["Hostname"] == "W"
    assert raw["EventTime"] == raw["@timestamp"] == "2022-04-04T01:00:00Z"
    assert raw["RecordNumber"] == "7" and raw["ThreadID"] == "2" and raw["ProviderGuid"] == "G" and raw["TargetUserName"] == "-"


def test_verdict_log_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"record_id": "r1", "verdict": "benign"}\n{"record_id": "r1", "verdict": "malicious"}\nbroken\n')
    last = incremental.read_verdict_log(spark, str(log)).collect()
    assert [(r["record_id"], r["verdict"]) for r in last] == [("r1", "malicious")]
    arrive, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",), ("b",)], "id string").write.parquet(str(arrive))

    def score(rows):
        return rows.select("id", F.lit("benign").alias("verdict"), F.lit(0.5).alias("confidence"), *[F.lit(None).cast(t).alias(n) for n, t in (("attack_technique", "string"), ("reasoning", "string"), ("key_indicators", "array<string>"))])

    for _ in range(2):
        stream = spark.readStream.schema("id string").parquet(str(arrive))
        incremental.score_stream(stream, score, out, str(tmp_path / "ck")).awaitTermination(60)
        spark.createDataFrame([("b",), ("c",)], "id string").write.mode("append").parquet(str(arrive))
    assert sorted(r["record_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_normalise_a_stream(spark, tmp_path):
    """Events with offsets of their own are normalised as a stream, with the records of a batch."""
    lines = [json.dumps({"EventID": e, "Channel": "Security", "EventTime": "2022-04-04 10:00:00", "Hostname": "H"}) for e in (4624, 4688, 1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    shape = lambda df: df.select(F.col("value").alias("raw_json"), F.from_json("value", "map<string,variant>").alias("raw"), F.length("value").cast("long").alias("index"))
    stream = ingest.normalise_benign(shape(spark.readStream.text(str(tmp_path / "in"))), "cap", "set", known_only=False).select("id", "event_type", "timestamp")
    query = stream.writeStream.format("memory").queryName("normalised").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = ingest.normalise_benign(shape(spark.read.text(str(tmp_path / "in"))), "cap", "set", known_only=False).select("id", "event_type", "timestamp")
    assert sorted(map(tuple, spark.table("normalised").collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 3


def test_a_nested_document_is_parsed_once(spark):
    """However many fields are taken from it; a parse for each made scans of nested logs slow."""
    df = spark.createDataFrame([('{"Event":{"System":{"Channel":"a","Level":3},"EventData":{"x":"1"}}}',)], "value string")
    plan = ingest.flatten_nested(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json(") + plan.lower().count("parsejson(") == 1
