"""Removing what tells the class without behaviour: one-sided events and keys, class ratios, calendar time.

Records have ``id, is_malicious, event_code, fields`` (a map of strings) and,
for time, ``ts`` and ``source_capture_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions.constants import COLLECTOR_KEYS, CORE_KEYS, UNMAPPABLE_KEYS, VERSION_KEYS
from loomwatch.functions.expressions import EPOCH, canonical, canonical_type, rebase_fields
from loomwatch.operators.sampling import take_quota
from loomwatch.sources.shared import written


def sides(by: list[Column | str]) -> list[Column]:
    return [F.bool_or(F.col("is_malicious")).alias("malicious"), F.bool_or(~F.col("is_malicious")).alias("benign")]


def shared_events(rows: DataFrame, event: str = "event_code") -> DataFrame:
    """Event codes that both classes have."""
    return rows.groupBy(event).agg(*sides([event])).filter("malicious AND benign").select(event)


def key_sides(rows: DataFrame, event: str = "event_code") -> DataFrame:
    """(event, key, malicious, benign): which class has a key, for each event code, in one pass."""
    keys = rows.select(event, "is_malicious", F.explode(F.map_keys("fields")).alias("key"))
    return keys.groupBy(event, "key").agg(*sides([event, "key"]))


def shared_keys(rows: DataFrame, event: str = "event_code") -> DataFrame:
    """Keys that both classes have, but for those without a counterpart."""
    return key_sides(rows, event).filter(F.col("malicious") & F.col("benign") & ~F.col("key").isin(UNMAPPABLE_KEYS)).select(event, "key")


def key_parity(rows: DataFrame, event: str | list[str] = "event_code") -> DataFrame:
    """Keys of one side only, without those that are documented as such; by event, or by channel and event."""
    allowed = COLLECTOR_KEYS + VERSION_KEYS
    by = [event] if isinstance(event, str) else event
    keys = rows.select(*by, "is_malicious", F.explode(F.map_keys("fields")).alias("key")).groupBy(*by, "key").agg(*sides(by))
    odd = keys.filter((F.col("malicious") != F.col("benign")) & ~F.col("key").isin(allowed))
    return odd.select(*by, "key", F.when(F.col("malicious"), "malicious").otherwise("benign").alias("side"))


def missing_core_keys(rows: DataFrame, core: dict[int, list[str]] | None = None, event: str = "event_code") -> DataFrame:
    """(event, key, side): core keys that a side never has, for events that both sides have.

    Keys of one side may be excused as a collector's own; these may not.
    """
    core = CORE_KEYS if core is None else core
    wanted = rows.sparkSession.createDataFrame([(e, k) for e, keys in core.items() for k in keys], "__event int, __key string")
    needed = shared_events(rows, event).join(F.broadcast(wanted), F.col(event) == F.col("__event"))  # a few keys for each event
    found = key_sides(rows, event).withColumnRenamed(event, "__e")
    both = needed.join(found, (F.col("__event") == F.col("__e")) & (F.col("__key") == F.col("key")), "left")
    lacking = F.filter(F.array(*[F.when(~F.coalesce(F.col(side), F.lit(False)), F.lit(side)) for side in ("malicious", "benign")]), lambda s: s.isNotNull())
    return both.select(event, F.col("__key").alias("key"), F.explode(lacking).alias("side"))


def restrict_fields(rows: DataFrame, event: str = "event_code") -> DataFrame:
    """Rows of shared events, with exactly the event's shared keys, in one spelling; missing ones are null."""
    return with_fields(rows, written(shared_fields(rows, event), "shared-fields"), event)


def shared_fields(rows: DataFrame, event: str = "event_code") -> DataFrame:
    """(__event, __keys): a row for each shared event, with its shared keys in order."""
    keys = shared_keys(rows, event).groupBy(event).agg(F.array_sort(F.collect_set("key")).alias("__keys"))
    return shared_events(rows, event).join(keys, event, "left").select(F.col(event).alias("__event"), F.coalesce("__keys", F.array().cast("array<string>")).alias("__keys"))


def with_fields(rows: DataFrame, events: DataFrame, event: str = "event_code") -> DataFrame:
    """Rows of the given events with exactly their keys. A row for each event: Spark decides by its size whether to broadcast it.

    Where the types of values are known, values are brought into one spelling
    by them, and the types become those of the new values.
    """
    joined = rows.join(events, rows[event].eqNullSafe(F.col("__event")))
    typed = "field_types" in rows.columns
    kind = lambda k: F.col("field_types")[k] if typed else None
    new = {"fields": F.map_from_arrays("__keys", F.transform("__keys", lambda k: canonical(F.col("fields")[k], kind(k))))}
    if typed:
        new["field_types"] = F.map_from_arrays("__keys", F.transform("__keys", lambda k: canonical_type(F.col("fields")[k], kind(k))))
    return joined.withColumns(new).drop("__keys", "__event")


def cap_quota(rows: DataFrame, ratio: float = 1.5, event: str = "event_code") -> DataFrame:
    """(event, is_malicious, n, quota): the larger class of an event gets ``ratio`` times the smaller one at most."""
    counts = rows.groupBy(event).agg(F.count_if("is_malicious").alias("m"), F.count_if(~F.col("is_malicious")).alias("b")).filter("m > 0 AND b > 0")
    cap = F.floor(F.least("m", "b") * F.lit(float(ratio))).cast("long")
    both = F.array(
        F.struct(F.lit(True).alias("is_malicious"), F.col("m").alias("n"), F.least(F.col("m"), cap).alias("quota")),
        F.struct(F.lit(False).alias("is_malicious"), F.col("b").alias("n"), F.least(F.col("b"), cap).alias("quota")),
    )
    return counts.select(event, F.explode(both).alias("c")).select(event, "c.*")


def restrict_to_shared_support(rows: DataFrame, ratio: float = 1.5, seed: int = 20260818, event: str = "event_code") -> DataFrame:
    """Shared events and keys only, with the class ratio of every event capped.

    The rows are drawn first, by event, class and id alone, and only those that
    stay have their fields brought into one spelling.
    """
    kept = take_quota(rows, cap_quota(rows, ratio, event), [event, "is_malicious"], seed)
    return with_fields(kept, written(shared_fields(rows, event), "shared-fields"), event)


def neutralize_times(rows: DataFrame, capture: str = "source_capture_id") -> DataFrame:
    """Every capture begins in the year 2000; distances within it stay, in ``ts`` and in the fields.

    The start of a capture is an aggregate joined back, not a window, since one
    capture may hold most rows. It is written first, so that Spark knows its
    size before it plans the join: few captures are broadcast and no row is
    moved, so a large capture isn't read by one task.
    """
    starts = written(rows.groupBy(capture).agg(F.min("ts").alias("__start")).withColumnRenamed(capture, "__capture"), "capture-starts")
    joined = rows.join(starts, rows[capture].eqNullSafe(F.col("__capture")))
    moved = joined.withColumn("ts", F.expr(EPOCH) + (F.col("ts") - F.col("__start")))
    if "fields" in rows.columns:
        moved = moved.withColumn("fields", rebase_fields(F.col("fields"), F.col("__start")))
    return moved.drop("__start", "__capture")
