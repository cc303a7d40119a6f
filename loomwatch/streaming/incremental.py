"""Resumable scoring, verdict logs, and streams of arriving events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwatch.functions.expressions import context_rich
from loomwatch.sources.ingest import VERDICT_LOG

LOG_COLUMNS = ["record_id", "verdict", "confidence", "attack_technique", "reasoning", "key_indicators"]


def last_verdicts(log: DataFrame, position: str = "log_pos") -> DataFrame:
    """The last row of each record; of equal positions the greater row."""
    latest = log.groupBy("record_id").agg(F.max_by(F.struct(*log.columns), F.struct(position, *[c for c in log.columns if c not in (position, "record_id")])).alias("r"))
    return latest.select("r.*")


def read_verdict_log(spark, path: str) -> DataFrame:
    """A JSON-lines log, the last line of each record; lines that can't be read are skipped."""
    rows = spark.read.schema(VERDICT_LOG).option("mode", "DROPMALFORMED").json(path)
    rows = rows.withColumn("log_pos", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    latest = Window.partitionBy("record_id").orderBy(F.desc("log_pos"))
    return rows.filter(F.col("record_id").isNotNull()).withColumn("__r", F.row_number().over(latest)).filter("__r = 1").drop("__r", "log_pos")


def pending(rows: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows that the log has no verdict row for."""
    return rows.join(log.select(F.col("record_id").alias(id_col)), id_col, "left_anti")


LOG_TABLE = "record_id string, verdict string, confidence double, attack_technique string, reasoning string, key_indicators array<string>"


def create_log(spark, table: str, buckets: int = 64, path: str | None = None) -> None:
    """A verdict log as a table in buckets of record ids, if there is none of this name; it lies at ``path`` or in the warehouse."""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({LOG_TABLE}) USING parquet CLUSTERED BY (record_id) SORTED BY (record_id) INTO {int(buckets)} BUCKETS{place}")


def append_to_log(scored: DataFrame, table: str, buckets: int = 64, id_col: str = "id") -> None:
    """Add verdicts to a log of buckets; each task writes the buckets that it was dealt, one file a bucket."""
    rows = scored.select(F.col(id_col).cast("string").alias("record_id"), *LOG_COLUMNS[1:])
    rows.repartition(buckets, "record_id").write.mode("append").bucketBy(buckets, "record_id").sortBy("record_id").saveAsTable(table)


def pending_in_log(rows: DataFrame, table: str, id_col: str = "id") -> DataFrame:
    """Rows that the log has no verdict for. Only ``rows`` are dealt out; the log lies in its buckets and isn't moved."""
    known = rows.sparkSession.table(table).select(F.col("record_id"))
    return rows.join(known, rows[id_col].cast("string") == F.col("record_id"), "left_anti")


def score_stream_into(stream: DataFrame, score: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, buckets: int = 64, id_col: str = "id", path: str | None = None) -> StreamingQuery:
    """Score arriving records into a log of buckets; a micro-batch joins its own rows with the buckets in place."""
    create_log(stream.sparkSession, table, buckets, path)

    def batch(rows: DataFrame, batch_id: int) -> None:
        append_to_log(score(pending_in_log(rows.dropDuplicates([id_col]), table, id_col)), table, buckets, id_col)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_verdicts(scored: DataFrame, path: str, id_col: str = "id") -> None:
    scored.select(F.col(id_col).cast("string").alias("record_id"), *LOG_COLUMNS[1:]).write.mode("append").parquet(path)


def checkpoint_table(rows: DataFrame, verdicts: DataFrame, event: str = "event_code") -> DataFrame:
    """Records with their verdicts, flat; where records have fields, with whether they tell who acted or on what."""
    rich = [context_rich(F.col("fields")).alias("context_rich")] if "fields" in rows.columns else []
    mine = rows.select("id", "is_malicious", event, "attack_technique", *rich)
    return mine.join(verdicts.select(F.col("record_id").alias("id"), "verdict", "confidence", F.col("attack_technique").alias("predicted_technique")), "id")


def path_exists(spark, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], log_path: str, checkpoint: str, id_col: str = "id") -> StreamingQuery:
    """Score arriving records and append to the log; a replayed batch scores only what the log lacks."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        todo = rows.dropDuplicates([id_col])
        if path_exists(spark, log_path):  # not before the first batch
            todo = pending(todo, spark.read.parquet(log_path), id_col)
        append_verdicts(score(todo), log_path, id_col)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(stream: DataFrame, time_col: str, delay: str = "1 hour", id_col: str = "id") -> DataFrame:
    """Drop records that arrive again within the delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])
