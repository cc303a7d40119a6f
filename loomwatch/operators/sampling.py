"""Reproducible sampling: by stratum, by class, with quotas in closed form.

A sample is decided by a hash of id and seed, so it doesn't depend on how rows
are partitioned. Most rows of a stratum are decided by the hash alone, since
their share lies far below or above the quota's; only the band in between,
whose size is about the square root of the quota, is ranked. So a stratum with
most of the rows is never sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.functions.expressions import draw_key, uniform
from loomwatch.operators.evaluation import before
from loomwatch.sources.shared import written

FLOOR = 385


def quotas(sizes: DataFrame, target: int | str, stratum: str = "stratum", by: list[str] | None = None) -> DataFrame:
    """Quota of each stratum for a budget, as if small strata were filled up first.

    ``sizes`` has stratum and n; ``target`` is a number or a column of it.
    Strata that fit their even share are taken whole; the rest share what is
    left evenly, the smaller ones (then the lesser key) taking the remainder.
    """
    by = by or []
    budget = F.lit(target) if isinstance(target, int) else F.col(target)
    up = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = up.orderBy("n", stratum)
    ranked = sizes.withColumns(
        {"t": F.least(budget.cast("long"), F.sum("n").over(up)), "j": F.row_number().over(order), "k": F.count(F.lit(1)).over(up), "prefix": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))}
    )
    full = ranked.withColumn("whole", F.col("prefix") + (F.col("k") - F.col("j")) * F.col("n") <= F.col("t"))
    taken = full.withColumns({"m": F.count_if("whole").over(up), "used": F.coalesce(F.sum(F.when(F.col("whole"), F.col("n"))).over(up), F.lit(0))})
    open_ = F.greatest(F.col("k") - F.col("m"), F.lit(1))
    level = F.floor((F.col("t") - F.col("used")) / open_)
    extra = F.col("t") - F.col("used") - level * open_
    quota = F.when(F.col("t") <= 0, 0).when(F.col("whole"), F.col("n")).when(F.col("j") <= F.col("m") + extra, level + 1).otherwise(level)
    return taken.select(*by, stratum, "n", quota.cast("long").alias("quota"))


def take_quota(rows: DataFrame, quota: DataFrame, strata: list[str], seed: int, id_col: str = "id") -> DataFrame:
    """``quota`` rows of each stratum, those with the least hashes. ``quota`` has strata, n, quota.

    Where ids repeat, hashes don't spread as they would, and the band may miss
    the quota. So the rows below and within the band are counted first, by a job
    of its own whose result, a row for each stratum, is written; strata that miss
    their quota are drawn by ``_take_repeated``. Where ids are unique there are none.
    """
    # Written, so that Spark knows its size: a join of few strata then moves no row, and the largest stratum isn't read by one task.
    named = written(quota.select(*[F.col(s).alias(f"__{s}") for s in strata], F.col("n").alias("__n"), F.col("quota").alias("__q")), "quota")
    same = lambda left: [left[s].eqNullSafe(F.col(f"__{s}")) for s in strata]
    drop = [f"__{s}" for s in strata]
    joined = rows.join(named, same(rows)).drop(*drop)
    # Shares that are certainly within the quota need no rank, and those that are certainly beyond it neither.
    q, n = F.col("__q"), F.col("__n")
    slack = 8 * F.sqrt(q) + 64
    share = uniform(F.col(id_col), str(seed))
    near = joined.filter((q > 0) & (share <= (q + slack) / n)).withColumn("__sure", share <= (q - slack) / n)
    counts = near.groupBy(*strata).agg(F.count_if("__sure").alias("__in"), F.count_if(~F.col("__sure")).alias("__band"))
    had = named.filter(q > 0).join(counts, [F.col(f"__{s}").eqNullSafe(counts[s]) for s in strata], "left").select(*drop, "__n", "__q", F.coalesce("__in", F.lit(0)).alias("__in"), F.coalesce("__band", F.lit(0)).alias("__band"))
    had = written(had, "quota-counts")
    fits = (F.col("__in") <= q) & (F.col("__in") + F.col("__band") >= F.least(q, n))
    odd = had.filter(~fits)
    repeated = not odd.isEmpty()
    sure = near.filter("__sure")
    band = near.filter("NOT __sure").drop("__n", "__q").withColumn("__h", draw_key(F.col(id_col), seed))
    rank = Window.partitionBy(*strata).orderBy("__h", id_col)
    ranked = band.withColumn("__r", F.row_number().over(rank))
    rest = ranked.join(had.filter(fits), same(ranked)).filter(F.col("__r") <= q - F.col("__in"))
    if repeated:
        sure = sure.drop("__n", "__q").join(odd, same(sure), "left_anti")
    out = sure.select(*rows.columns).unionByName(rest.select(*rows.columns))
    if repeated:
        again = rows.join(odd.select(*drop, "__q"), same(rows)).drop(*drop)
        out = out.unionByName(_take_repeated(again, strata, seed, id_col).select(*rows.columns))
    return out


def _take_repeated(rows: DataFrame, strata: list[str], seed: int, id_col: str) -> DataFrame:
    """``__q`` rows of each stratum where ids repeat: whole ids in the order of their hashes, and of the last id as many rows as are left.

    Ids are counted first; sums over the ids before one come from cells of
    hashes. Rows of the last id are drawn by numbers of their own.
    """
    ids = rows.groupBy(*strata, id_col).agg(F.count(F.lit(1)).alias("__count"), F.max("__q").alias("__q")).withColumn("__key", -uniform(F.col(id_col), str(seed)))
    placed = before(ids, strata, "__key", ["__count"], [id_col]).withColumn("__left", F.col("__q") - F.col("__count_before")).filter("__left > 0")
    chosen = placed.select(*[F.col(c).alias(f"__k_{c}") for c in (*strata, id_col)], "__count", "__left")
    met = rows.join(chosen, [rows[c].eqNullSafe(F.col(f"__k_{c}")) for c in (*strata, id_col)])
    whole = met.filter(F.col("__left") >= F.col("__count"))
    cut = met.filter(F.col("__left") < F.col("__count")).withColumn("__row", F.monotonically_increasing_id())
    share = uniform(F.col("__row"), str(seed))
    slack = 8 * F.sqrt("__left") + 64
    near = cut.filter(share <= (F.col("__left") + slack) / F.col("__count"))
    rank = Window.partitionBy(*strata).orderBy(share, "__row")
    part = near.withColumn("__r", F.row_number().over(rank)).filter(F.col("__r") <= F.col("__left"))
    return whole.select(*rows.columns).unionByName(part.select(*rows.columns))


def stratified_sample(rows: DataFrame, target: int, stratum: str, seed: int, id_col: str = "id") -> DataFrame:
    """A sample of ``target`` rows, spread evenly over strata."""
    if target <= 0:
        return rows.limit(0)
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return take_quota(rows, quotas(sizes, target, stratum), [stratum], seed, id_col)


def class_targets(size: int = 1925, fraction: float = 385 / 1925) -> tuple[int, int]:
    if size <= 0 or not 0 <= fraction <= 1:
        raise ValueError("size must be positive and fraction from 0 to 1")
    malicious = round(size * fraction)
    return malicious, size - malicious


def eval_sample(rows: DataFrame, stratum: str, size: int = 1925, fraction: float = 385 / 1925, seed: int = 20260818, label: str = "is_malicious", id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """A sample stratified within each class (and within each value of ``by``)."""
    by = by or []
    malicious, benign = class_targets(size, fraction)
    sizes = rows.groupBy(*by, label, stratum).agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.when(F.col(label), malicious).otherwise(benign))
    return take_quota(rows, quotas(sizes, "target", stratum, [*by, label]), [*by, label, stratum], seed, id_col)


def sample_report(sample: DataFrame, size: int = 1925, fraction: float = 385 / 1925, label: str = "is_malicious") -> DataFrame:
    """Wanted and achieved rows of each class, and whether both reach the floor."""
    malicious, benign = class_targets(size, fraction)
    counts = sample.agg(F.count_if(F.col(label)).alias("malicious"), F.count_if(~F.col(label)).alias("benign"))
    return counts.select(F.lit(malicious).cast("long").alias("target_malicious"), F.lit(benign).cast("long").alias("target_benign"), "malicious", "benign", (F.least("malicious", "benign") >= FLOOR).alias("floor_met"))


def uniform_sample(rows: DataFrame, n: int, total: int, seed: int, id_col: str = "id") -> DataFrame:
    """Exactly ``n`` of ``total`` rows without replacement, or all if there are fewer."""
    if n >= total:
        return rows
    quota = rows.sparkSession.createDataFrame([(0, total, n)], "__all int, n long, quota long")
    return take_quota(rows.withColumn("__all", F.lit(0)), quota, ["__all"], seed, id_col).drop("__all")
