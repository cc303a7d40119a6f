"""Shortcut audit: how well a single feature predicts the class by majority vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions.constants import TIME_KEYS
from loomwatch.functions.expressions import value_type
from loomwatch.operators.leakage import shared_events
from loomwatch.operators.sampling import take_quota

THRESHOLD = 0.65


def single_feature_accuracy(rows: DataFrame, feature: Column, name: str) -> DataFrame:
    """(check, key, n, accuracy) of the best rule that reads one feature only."""
    per = rows.groupBy(feature.alias("f")).agg(F.count_if("is_malicious").alias("m"), F.count_if(~F.col("is_malicious")).alias("b"))
    sums = per.agg(F.sum(F.col("m") + F.col("b")).alias("n"), F.sum(F.greatest("m", "b")).alias("best"))
    n = F.coalesce("n", F.lit(0))
    accuracy = F.when(n == 0, F.raise_error(F.lit("nothing to audit")).cast("double")).otherwise(F.col("best") / F.col("n"))
    return sums.select(F.lit(name).alias("check"), F.lit("").alias("key"), n.alias("n"), accuracy.alias("accuracy"))


def key_feature_accuracy(rows: DataFrame, feature: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """The same for a feature of every key's value at once; records without the key, or with null, form a value of their own.

    ``feature`` is an SQL expression over ``v``, the text of a value. Rows are
    counted by (key, feature value) before anything else happens.
    """
    pairs = rows.select("is_malicious", F.explode("fields").alias("key", "v"))
    if keys is not None:
        pairs = pairs.filter(F.col("key").isin(keys))
    pairs = pairs.withColumn("f", F.expr(feature))
    counted = pairs.filter("f IS NOT NULL").groupBy("key", "f").agg(F.count_if("is_malicious").alias("m"), F.count_if(~F.col("is_malicious")).alias("b"))
    per_key = counted.groupBy("key").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.sum(F.greatest("m", "b")).alias("best"))
    totals = rows.agg(F.count_if("is_malicious").alias("tm"), F.count_if(~F.col("is_malicious")).alias("tb"))
    n = F.col("tm") + F.col("tb")
    best = F.col("best") + F.greatest(F.col("tm") - F.col("m"), F.col("tb") - F.col("b"))
    return per_key.join(F.broadcast(totals)).select(F.lit(name).alias("check"), "key", n.alias("n"), (best / n).alias("accuracy"))


def type_accuracy(rows: DataFrame) -> DataFrame:
    """How well the type of each key's value tells the class, from ``field_types``: the text "5" and the number 5 differ."""
    types = F.transform_values("field_types", lambda k, t: value_type(t))
    return key_feature_accuracy(rows.select("is_malicious", types.alias("fields")), "v", "value_type")


def shortcut_audit(rows: DataFrame, event: str = "event_code", threshold: float = THRESHOLD, per_class: int | None = None, seed: int = 20260818) -> DataFrame:
    """All checks: year, field count, (event, field count), time prefix, value type by key, event.

    Types are those of ``field_types`` where records have it, else they are told
    by the text. ``per_class`` caps the rows of each class, drawn by hash.
    """
    if per_class is not None:
        counts = rows.groupBy("is_malicious").agg(F.count(F.lit(1)).alias("n")).withColumn("quota", F.least("n", F.lit(per_class)))
        rows = take_quota(rows, counts, ["is_malicious"], seed)
    count = F.size(F.map_keys("fields"))
    kind = "CASE WHEN v RLIKE '^[+-]?[0-9]+$' THEN 'number' WHEN v RLIKE '^0[xX][0-9a-fA-F]+$' THEN 'hex' WHEN v IS NOT NULL THEN 'text' END"
    both = rows.join(shared_events(rows, event), event, "left_semi")
    parts = [
        single_feature_accuracy(rows, F.year("ts"), "year"),
        single_feature_accuracy(rows, count, "field_count"),
        single_feature_accuracy(both, F.struct(F.col(event), count), "event_field_count"),
        key_feature_accuracy(rows, "substr(v, 1, 4)", "time_prefix", TIME_KEYS),
        type_accuracy(rows) if "field_types" in rows.columns else key_feature_accuracy(rows, kind, "value_type"),
        single_feature_accuracy(rows, F.col(event), "event"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("flagged", F.col("accuracy") >= threshold)
