"""File lines, numbered streams, committed stores and logs in buckets: splits, restarts and replays."""

import json
import random

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from loomwatch.sources import event_lines, ingest
from loomwatch.streaming import incremental, numbering, verdict_store

VERDICTS = "record_id string, verdict string, confidence double"


def lines_of(data):
    out, at = [], 0
    for x in data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]:
        out.append((at, x.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(x) + 1
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1 << 22])
def test_splits_of_any_size(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(event_lines, "_CHUNK", chunk)
    rng, fs, path = random.Random(chunk), pyarrow.fs.LocalFileSystem(), tmp_path / "x.txt"
    for _ in range(400):
        data = b"\n".join(bytes(rng.choice(b"ab\r\xc3") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(8))) + rng.choice([b"", b"\n", b"\n\n"])
        path.write_bytes(data)
        got = []
        for split in event_lines.splits([(str(path), 0, len(data))], rng.choice([1, 2, 3, 5, 100]), True):
            for batch in event_lines.lines_of(fs, split):
                got += zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())
        assert got == lines_of(data)


def test_lines_of_a_tree(spark, tmp_path):
    files = {"a/one.json": b'{"x": 1}\n\n{"x": "\xc3\xa9"}\n', "a/sub/two.json": b'{"x": 3}', "b.json": b"", "c.json": b'{"x": 4}\r\n{"x": 5}\n', "_hidden.json": b"no", ".a/b.json": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want, base = [], 0
    for name in sorted(n for n in files if not n.startswith(("_", "."))):
        want += [(f"{tmp_path}/{name}", at, base + at, x) for at, x in lines_of(files[name])]
        base += len(files[name])
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert sorted(map(tuple, event_lines.read_lines(spark, path, 5).collect())) == sorted(want)
    events = ingest.with_place(ingest.events_of(event_lines.read_lines(spark, str(tmp_path), 7)), F.lit("c"))
    assert [(r["index"], r["x"]) for r in events.select("index", F.col("raw")["x"].cast("string").alias("x")).orderBy("index").collect()] == [(p, json.loads(x)["x"] if isinstance(json.loads(x)["x"], str) else str(json.loads(x)["x"])) for _, _, p, x in sorted(want, key=lambda w: w[2]) if x]
    assert event_lines.read_lines(spark, str(tmp_path / "b.json")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        event_lines.read_lines(spark, str(tmp_path / "nowhere")).count()


def test_malformed_line_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        ingest.events_of(event_lines.read_lines(spark, str(tmp_path))).collect()


def test_stream_of_growing_files(spark, tmp_path):
    """A line is read once its line feed is there; a restart goes on from where the stream was."""
    arriving, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    arriving.mkdir()

    def run():
        stream = event_lines.stream_lines(spark, str(arriving), 4)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start().awaitTermination(120)
        return sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["line"]) for r in spark.read.parquet(out).collect())

    (arriving / "a.txt").write_text("one\ntwo\nthr")
    first = [("a.txt", 0, "one"), ("a.txt", 4, "two")]
    assert run() == first
    with (arriving / "a.txt").open("a") as f:
        f.write("ee\nfour\n")
    (arriving / "b.txt").write_text("five\n")
    assert run() == sorted([*first, ("a.txt", 8, "three"), ("a.txt", 14, "four"), ("b.txt", 0, "five")])


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    known = spark.conf.get(name)
    spark.conf.set(name, numbering.STORE)
    yield
    spark.conf.set(name, known)


def test_numbers_go_on_over_triggers_and_restarts(spark, tmp_path, rocks):
    """Ids of events that a stream reads in three turns, restarted each time, are those of one batch."""
    arriving, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    arriving.mkdir()
    event = lambda c, k: json.dumps({"EventID": 4624 + k % 3, "Channel": "Security", "Hostname": c, "EventTime": "2022-04-04 10:00:00", "RecordNumber": k})
    turns = [[("x", range(0, 30)), ("y", range(0, 4))], [("x", range(30, 31)), ("z", range(0, 3))], [("y", range(4, 9)), ("x", range(31, 60))]]

    def shaped(lines):
        named = lines.filter(F.trim("line") != "").select(F.regexp_extract("file", "([a-z])-[0-9]+.txt", 1).alias("capture_id"), "file", "offset", F.col("line").alias("raw_json"))
        return named

    def normalised(numbers):
        raw = numbers.withColumn("raw", F.from_json("raw_json", "map<string,variant>", {"mode": "FAILFAST"}))
        return ingest._records(raw, "set", {"is_malicious": F.lit(False), "attack_technique": F.lit(None).cast("string"), "attack_subtechnique": F.lit(None).cast("string"), "attack_tactics": F.array().cast("array<string>"), "technique_unresolved": F.lit(False)}).select("id", "source_host")

    for n, turn in enumerate(turns):
        for capture, numbers in turn:
            (arriving / f"{capture}-{n}.txt").write_text("".join(event(capture, k) + "\n" for k in numbers))
        stream = normalised(numbering.numbered(shaped(event_lines.stream_lines(spark, str(arriving))), ["file", "offset"]))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start().awaitTermination(120)
    lines = shaped(event_lines.read_lines(spark, str(arriving)))
    from pyspark.sql import Window

    batch = normalised(lines.withColumn("index", F.row_number().over(Window.partitionBy("capture_id").orderBy("file", "offset")) - 1))
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 72 and {i.split(":")[2] for i, h in got if h == "x"} == {str(k) for k in range(60)}


def test_numbering_needs_its_store(spark):
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != numbering.STORE:
        with pytest.raises(ValueError, match="stateStore"):
            numbering.numbered(spark.readStream.format("rate").load().withColumn("capture_id", F.lit("a")), ["value"])


def test_store_writes_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(str(k), "benign", 0.5) for k in range(50)], VERDICTS).repartition(3)
    assert verdict_store.read_store(spark, path, VERDICTS).count() == 0
    verdict_store.append_batch(rows, path, "a")
    verdict_store.append_batch(rows, path, "a")  # the job is repeated
    verdict_store.append_batch(rows.limit(0), path, "none")
    verdict_store.append_batch(rows.limit(7), path, "b")
    assert verdict_store.read_store(spark, path, VERDICTS).count() == 57
    assert {k: v["rows"] for k, v in verdict_store.committed(path).items()} == {"a": 50, "b": 7, "none": 0}
    parts = sum(len(v["files"]) for v in verdict_store.committed(path).values())
    assert len(list((tmp_path / "store" / "data").glob("*.parquet"))) == parts  # nothing is left of the repeated job
    bad = rows.withColumn("confidence", F.when(F.col("record_id") == "33", F.raise_error(F.lit("lost")).cast("double")).otherwise(0.5))
    with pytest.raises(Exception):
        verdict_store.append_batch(bad, path, "c")
    assert verdict_store.read_store(spark, path, VERDICTS).count() == 57
    with pytest.raises(Exception, match="appended"):
        verdict_store.register(spark)
        rows.write.format("verdict_store").mode("overwrite").save(path)


def test_store_survives_a_crash_before_the_stream_marks_its_batch(spark, tmp_path):
    """The commit of the last batch is taken from the checkpoint, as after a kill between both: the batch runs again and no row is there twice."""
    arriving, path, mark = tmp_path / "in", str(tmp_path / "store"), tmp_path / "mark"
    verdict_store.register(spark)

    def run():
        stream = spark.readStream.schema(VERDICTS).parquet(str(arriving))
        stream.writeStream.format("verdict_store").option("path", path).option("checkpointLocation", str(mark)).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["record_id"] for r in verdict_store.read_store(spark, path, VERDICTS).collect())

    spark.createDataFrame([(str(k), "benign", 0.5) for k in range(20)], VERDICTS).write.parquet(str(arriving))
    assert len(run()) == 20
    for f in (mark / "commits").iterdir():
        f.unlink()
    assert len(run()) == 20
    spark.createDataFrame([(str(k), "benign", 0.5) for k in range(20, 25)], VERDICTS).write.mode("append").parquet(str(arriving))
    assert run() == sorted(str(k) for k in range(25))
    assert verdict_store.committed(path).keys() == {"stream-0", "stream-1"}


def _score(rows):
    return rows.select("id", F.lit("benign").alias("verdict"), F.lit(0.5).alias("confidence"), *[F.lit(None).cast(t).alias(n) for n, t in (("attack_technique", "string"), ("reasoning", "string"), ("key_indicators", "array<string>"))])


def test_a_log_in_buckets_is_not_moved(spark, tmp_path):
    arriving, mark, log = tmp_path / "in", str(tmp_path / "mark"), str(tmp_path / "log")
    for turn in (range(0, 400), range(300, 500)):
        spark.createDataFrame([(str(k),) for k in turn], "id string").write.mode("append").parquet(str(arriving))
        stream = spark.readStream.schema("id string").parquet(str(arriving))
        incremental.score_stream_into(stream, _score, "bucketed_log", mark, 4, path=log).awaitTermination(120)
    assert sorted(int(r["record_id"]) for r in spark.table("bucketed_log").collect()) == list(range(500))
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = incremental.pending_in_log(spark.range(490, 510).select(F.col("id").cast("string").alias("id")), "bucketed_log")
        assert sorted(r["id"] for r in todo.collect()) == [str(k) for k in range(500, 510)]
        plan = todo._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(") == 1 and "Bucketed: true" in final  # the new rows only
    spark.sql("DROP TABLE bucketed_log")


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    rows = [("a", "2022-04-04 10:00:00"), ("a", "2022-04-04 10:10:00"), ("b", "2022-04-04 12:30:00"), ("a", "2022-04-04 12:40:00")]  # b ends the hour after a
    for n, row in enumerate(rows):
        spark.createDataFrame([row], "id string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, at timestamp").parquet(str(tmp_path / "in"))
        incremental.distinct_stream(stream, "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "a", "b"]


def test_checkpoint_tells_the_context(spark):
    rows = spark.createDataFrame([("a", True, 1, "T1", {"User": "bob"}), ("b", False, 2, None, {"User": "-"}), ("c", False, 2, None, {})], "id string, is_malicious boolean, event_code int, attack_technique string, fields map<string,string>")
    verdicts = spark.createDataFrame([("a", "malicious", 0.9, "T2"), ("b", None, None, None)], "record_id string, verdict string, confidence double, attack_technique string")
    out = {r["id"]: (r["context_rich"], r["verdict"], r["predicted_technique"]) for r in incremental.checkpoint_table(rows, verdicts).collect()}
    assert out == {"a": (True, "malicious", "T2"), "b": (False, None, None)}


def test_splits_are_not_without_number(spark, tmp_path):
    """Small splits grow where they would be more than ``most_splits``; lines and places stay the same."""
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(500)))
    few, many = (event_lines.read_lines(spark, str(tmp_path), 10, most) for most in (6, 400))
    assert few.rdd.getNumPartitions() <= 6 < 300 < many.rdd.getNumPartitions()
    assert sorted(few.collect()) == sorted(many.collect())
    assert event_lines.read_lines(spark, str(tmp_path), 10).rdd.getNumPartitions() <= 64
