"""Hashed bitmaps of fixed size: a cheap test before an exact join.

A bitmap says of a key that it is certainly not in a set, or that it may be. It
has ``2 ** BITS`` bits whatever the size of the set; a larger set only makes
the test let more through. An exact join must follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import mix
from loomwatch.llm.shared import in_batches

BITS = 24


def places(keys: np.ndarray) -> np.ndarray:
    """The bit of each 64-bit key."""
    return (mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


class Bitmap:
    """The set of a column's values. ``has`` may err on one side: it may say yes to others."""

    def __init__(self, df: DataFrame, key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(places(batch.column(0).drop_null().to_numpy(zero_copy_only=False)))
                word, first = np.unique(at >> 6, return_index=True)
                masks = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(masks.view(np.int64))], names=["word", "mask"])

        words = in_batches(df.select(F.col(key).cast("long")), run, "word long, mask long")
        merged = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # 2**(BITS - 6) rows at most
        table = np.zeros(1 << (BITS - 6), np.int64)
        table[merged["word"].to_numpy(np.int64)] = merged["mask"].to_numpy(np.int64)
        self.shared = df.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = places(keys)
        return (self.shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def rows_where(df: DataFrame, key: str, bitmap: Bitmap, wanted: bool) -> DataFrame:
    """Rows whose key may be in the set, or those for which it certainly is not (null keys too)."""
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            has = bitmap.has(pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
            has &= pc.is_valid(column).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(has == wanted))

    return in_batches(df, run, df.schema)


def filtered_lists(bitmap: Bitmap) -> Callable[[pa.ListArray], pa.ListArray]:
    """Keep those elements of lists of 64-bit values that may be in the set."""

    def run(lists: pa.ListArray) -> pa.ListArray:
        values = lists.flatten().to_numpy(zero_copy_only=False)
        keep = bitmap.has(values)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[keep]))

    return run


def keep_decided(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` but those whose id and text hash ``decided`` (doc_id, th, kept) rejects, and one each of those it keeps.

    Rows that it doesn't name all stay. Only rows that may be named meet the exact join.
    """
    th = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.withColumns({"__loom_id": F.col(id_col).cast("long"), "__loom_th": th}).withColumn("__loom_at", F.xxhash64("__loom_id", "__loom_th"))
    named = decided.select(F.xxhash64("doc_id", "th").alias("__loom_key"), F.col("doc_id").alias("__loom_doc"), F.col("th").alias("__loom_text"), F.col("kept").alias("__loom_kept"))
    bitmap = Bitmap(named, "__loom_key")
    maybe = rows_where(rows, "__loom_at", bitmap, True)
    same = (F.col("__loom_at") == F.col("__loom_key")) & F.col("__loom_id").eqNullSafe(F.col("__loom_doc")) & (F.col("__loom_th") == F.col("__loom_text"))
    left = rows_where(rows, "__loom_at", bitmap, False).unionByName(maybe.join(named, same, "left_anti"))
    again = named.filter("__loom_kept")
    if not again.isEmpty():
        left = left.unionByName(maybe.join(again, same, "left_semi").dropDuplicates(["__loom_id", "__loom_th"]))
    return left.select(*docs.columns)
