"""Tables in a total order, without a task that sorts them whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.functions.expressions import draw_key


def write_ordered(rows: DataFrame, order: list[Column | str], path: str, parts: int | None = None) -> DataFrame:
    """Write ``rows`` in order and return them with ``ordinal``, their place from 0.

    Rows go to ranges of the order, each range is sorted by its own task and
    becomes one or more files whose names are in the order of ranges. A row's
    place is its place in its range and the sizes of the ranges before; sizes
    are a row for each range. ``order`` should be total, or the order of ties
    depends on the run that wrote the table.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)  # the range in the upper bits, the place below
    written = spark.read.parquet(path)
    span, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = written.groupBy(span.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    shifts = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    joined = written.join(F.broadcast(shifts), span == F.col("__range"))  # ``parts`` rows
    return joined.select((place + F.col("__shift")).alias("ordinal"), *rows.columns)


def write_shuffled(rows: DataFrame, seed: int, path: str, id_col: str = "id", parts: int | None = None) -> DataFrame:
    """``write_ordered`` by a hash of id and seed: a shuffle that can be repeated."""
    return write_ordered(rows, [draw_key(F.col(id_col), seed), F.col(id_col)], path, parts)


def first_rows(ordered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a table in order."""
    return ordered.filter(F.col("ordinal") < n)
