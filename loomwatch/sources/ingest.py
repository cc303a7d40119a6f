"""Event files to alert records.

Raw events are one JSON object per line, kept as text and as a map of variants.
``normalise_*`` give the alert schema. A record's index, which its id is made
of, counts the events of a capture by file and by place in the file; the place
comes from byte order within a file, kept by reading a file's lines in order.
Events that bring an ``index`` of their own, as those of a stream with offsets
do, keep it: normalisation is then stateless and runs on streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwatch.functions.constants import EVENT_TYPES, UNRESOLVED
from loomwatch.sources.shared import written

METADATA = "id string, attack_mappings array<struct<technique string, `sub-technique` string, tactics array<string>>>, files array<struct<type string, link string>>"
VERDICT_LOG = "record_id string, verdict string, confidence double, attack_technique string, reasoning string, key_indicators array<string>"
ALERT_COLUMNS = [
    "id", "timestamp", "source_host", "event_type", "source_dataset", "source_capture_id", "raw_json", "fields",
    "field_types", "is_malicious", "attack_technique", "attack_subtechnique", "attack_tactics", "technique_unresolved",
]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw_json, raw) of a file or folder tree; blank lines are skipped, malformed ones raise."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    kept = lines.withColumn("line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return kept.select("file", "block", "line", F.col("value").alias("raw_json"), F.from_json("value", "map<string,variant>", {"mode": "FAILFAST"}).alias("raw"))


def events_of(lines: DataFrame) -> DataFrame:
    """(file, offset, position, raw_json, raw) of ``event_lines`` rows; blank lines are skipped, malformed ones raise."""
    kept = lines.filter(F.trim("line") != "")
    return kept.select("file", "offset", "position", F.col("line").alias("raw_json"), F.from_json("line", "map<string,variant>", {"mode": "FAILFAST"}).alias("raw"))


def with_place(events: DataFrame, capture: Column) -> DataFrame:
    """``capture_id`` and, as ``index``, the byte of the capture at which an event begins, its files one behind the other.

    It orders and tells apart a capture's events as their count would, and
    needs no window: one aggregate, a row for each capture, is written and
    joined back, broadcast if it is small, so no task reads a whole large capture.
    A capture's files must lie next to each other in the order of paths.
    """
    named = events.withColumn("capture_id", capture)
    first = written(named.groupBy("capture_id").agg(F.min(F.col("position") - F.col("offset")).alias("__first")).withColumnRenamed("capture_id", "__capture"), "capture-places")
    joined = named.join(first, F.col("capture_id").eqNullSafe(F.col("__capture")))
    return joined.withColumn("index", F.col("position") - F.col("__first")).drop("__first", "__capture")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Capture metadata, one JSON document per file; anything else raises."""
    return spark.read.schema(METADATA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pair_metadata(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """Events of files that a capture's metadata names; others are dropped, on either side."""
    named = metadata.filter(F.size("files") > 0).withColumn("__base", basename(F.col("files")[0]["link"]))
    return events.withColumn("__base", basename(F.col("file"))).join(named, "__base").drop("__base", "files")


def event_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_TYPES, "channel string, code int, event_type string, meaning string").drop("meaning")


def classify_events(rows: DataFrame, channel: Column, event: Column) -> DataFrame:
    """``event_type`` by channel and event id; 'other' for what is not known."""
    types = event_types(rows.sparkSession).select(F.col("channel").alias("__channel"), F.col("code").alias("__code"), "event_type")
    on = (F.lower(F.coalesce(channel, F.lit(""))) == F.col("__channel")) & (event.try_cast("int") == F.col("__code"))
    return rows.join(F.broadcast(types), on, "left").withColumn("event_type", F.coalesce("event_type", F.lit("other"))).drop("__channel", "__code")  # 24 rows


def keep_known_events(rows: DataFrame, channel: Column, event: Column, types: DataFrame | None = None) -> DataFrame:
    """Rows whose channel and event id are in the table of types."""
    types = event_types(rows.sparkSession) if types is None else types
    keys = types.select(F.lower("channel").alias("__channel"), F.col("code").alias("__code"))
    return rows.join(keys, (F.lower(F.coalesce(channel, F.lit(""))) == F.col("__channel")) & (event.try_cast("int") == F.col("__code")), "left_semi")


def text_of(raw: Column, key: str) -> Column:
    return F.try_variant_get(raw[key], "$", "string")


def event_time(raw: Column) -> Column:
    """The first filled one of three time fields; an error if it is no time or there is none."""
    filled = F.coalesce(*[F.nullif(text_of(raw, k), F.lit("")) for k in ("EventTime", "@timestamp", "EventReceivedTime")])
    return F.coalesce(F.regexp_replace(filled, "Z$", "").try_cast("timestamp_ntz"), F.raise_error(F.concat(F.lit("no event time: "), F.coalesce(filled, F.lit("none")))).cast("timestamp_ntz"))


def record_id(dataset: Column, capture: Column, index: Column, raw_json: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", capture, index.cast("string"), raw_json), 256)
    return F.concat_ws(":", dataset, capture, index.cast("string"), F.substring(digest, 1, 16))


def with_index(rows: DataFrame, start: int = 0) -> DataFrame:
    """The place of a row within its capture: a rank within the file's block, shifted by the blocks before."""
    inside = Window.partitionBy("capture_id", "file", "block").orderBy("line")
    blocks = rows.groupBy("capture_id", "file", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("capture_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = rows.withColumn("__k", F.row_number().over(inside) - 1).join(shifts, ["capture_id", "file", "block"])
    return ranked.withColumn("index", F.col("__k") + F.col("__shift") + start).drop("__k", "__shift")


def _records(rows: DataFrame, dataset: str, labels: dict[str, Column], start: int = 0) -> DataFrame:
    raw = F.col("raw")
    rows = rows if "index" in rows.columns else with_index(rows, start)
    rows = classify_events(rows, text_of(raw, "Channel"), text_of(raw, "EventID"))
    types = F.transform_values(raw, lambda k, v: F.schema_of_variant(v))
    values = F.transform_values(raw, lambda k, v: v.cast("string"))
    out = rows.withColumns(
        {
            "source_dataset": F.lit(dataset),
            "source_capture_id": F.col("capture_id"),
            "id": record_id(F.lit(dataset), F.col("capture_id"), F.col("index"), F.col("raw_json")),
            "timestamp": event_time(raw),
            "source_host": F.coalesce(text_of(raw, "Hostname"), F.lit("unknown")),
            "fields": values,
            "field_types": types,
            **labels,
        }
    )
    return out.select(*ALERT_COLUMNS)


def normalise_single(events: DataFrame, metadata: DataFrame, dataset: str) -> DataFrame:
    """Events of single-technique captures, labelled by the first mapping of their capture."""
    paired = pair_metadata(events.drop("capture_id"), metadata).withColumn("capture_id", F.col("id"))
    first = F.when(F.size("attack_mappings") > 0, F.col("attack_mappings")[0])
    labels = {
        "is_malicious": F.lit(True),
        "attack_technique": F.coalesce(first["technique"], F.raise_error(F.lit("no attack_mappings")).cast("string")),
        "attack_subtechnique": first["sub-technique"],
        "attack_tactics": F.coalesce(first["tactics"], F.array().cast("array<string>")),
        "technique_unresolved": F.lit(False),
    }
    return _records(paired.drop("id"), dataset, labels)


def normalise_compound(events: DataFrame, capture_id: str, dataset: str) -> DataFrame:
    """Events of a capture with several techniques, of which none can be told per event."""
    none = F.array().cast("array<string>")
    labels = {"is_malicious": F.lit(True), "attack_technique": F.lit(UNRESOLVED), "attack_subtechnique": F.lit(None).cast("string"), "attack_tactics": none, "technique_unresolved": F.lit(True)}
    return _records(events.withColumn("capture_id", F.lit(capture_id)), dataset, labels)


def normalise_benign(events: DataFrame, capture_id: str, dataset: str, start: int = 0, known_only: bool = True) -> DataFrame:
    """Benign events; those of unknown types are left out before the index is taken."""
    none = F.array().cast("array<string>")
    missing = F.lit(None).cast("string")
    labels = {"is_malicious": F.lit(False), "attack_technique": missing, "attack_subtechnique": missing, "attack_tactics": none, "technique_unresolved": F.lit(False)}
    if known_only:
        events = keep_known_events(events, text_of(F.col("raw"), "Channel"), text_of(F.col("raw"), "EventID"))
    return _records(events.withColumn("capture_id", F.lit(capture_id)), dataset, labels, start)


def load_corpus(single: DataFrame, compound: DataFrame, benign: DataFrame) -> DataFrame:
    return single.unionByName(compound).unionByName(benign)


def flatten_nested(rows: DataFrame, nested: str = "value") -> DataFrame:
    """Nested event-log JSON to flat fields: ``raw`` is a map of variants, as from ``read_events``.

    Data fields come first and system fields win, but a record number in the
    data stays. Wrapped values are unwrapped. What is used more than once is a
    column of a step of its own, so a document is parsed once and not for each field.
    """
    doc, data, taken = F.col("__doc"), F.col("__data"), F.col("__taken")
    at = lambda path: F.try_variant_get(doc, path, "variant")
    empty = F.expr("cast(map() as map<string,variant>)")
    data_of = F.coalesce(F.try_variant_get(doc, "$.Event.EventData", "map<string,variant>"), empty)
    wrapped = lambda path: F.coalesce(F.try_variant_get(doc, path + "['#text']", "variant"), at(path))
    system = "$.Event.System"
    time = at(f"{system}.TimeCreated['#attributes'].SystemTime")
    always = {"Channel": at(f"{system}.Channel"), "EventID": wrapped(f"{system}.EventID"), "Hostname": at(f"{system}.Computer")}
    if_there = {
        "EventTime": time,
        "@timestamp": time,
        **{k: at(f"{system}.{k}") for k in ("Keywords", "Task", "Opcode", "Version", "Level")},
        "ProviderGuid": at(f"{system}.Provider['#attributes'].Guid"),
        "ExecutionProcessID": at(f"{system}.Execution['#attributes'].ProcessID"),
        "ThreadID": at(f"{system}.Execution['#attributes'].ThreadID"),
        "ActivityID": at(f"{system}.Correlation['#attributes'].ActivityID"),
        "UserID": at(f"{system}.Security['#attributes'].UserID"),
    }
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.filter(F.array(*[entry(k, v) for k, v in {**always, **if_there}.items()]), lambda e: e["value"].isNotNull() | e["key"].isin(list(always)))
    number = F.when(~F.map_contains_key(data, "RecordNumber"), F.map_from_entries(F.array(entry("RecordNumber", at(f"{system}.EventRecordID"))))).otherwise(empty)
    rest = F.map_filter(data, lambda k, v: ~F.map_contains_key(taken, k))
    steps = rows.withColumn("__doc", F.parse_json(F.col(nested))).withColumns({"__data": data_of, "__taken": F.map_from_entries(entries)})
    return steps.withColumn("raw", F.map_concat(rest, taken, number)).drop("__doc", "__data", "__taken")
