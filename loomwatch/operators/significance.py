"""Paired tests and resampling.

A bootstrap of accuracy or MCC only needs counts of a few cells: drawing the
cells of a replicate from a multinomial is the same as drawing rows. So a
replicate costs the number of cells, whatever the number of rows, and
replicates are spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame, pred: str = "pred", id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """Items on which both systems commit: a_right, b_right. Items without a value of ``by`` are a group too."""
    by = by or []
    left = a.filter(F.col(pred).isNotNull()).select(*by, id_col, (F.col(pred) == F.col("is_malicious")).alias("a_right"))
    right = b.filter(F.col(pred).isNotNull()).select(*[F.col(c).alias(f"__{c}") for c in [*by, id_col]], (F.col(pred) == F.col("is_malicious")).alias("b_right"))
    alike = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return left.join(right, [F.col(id_col) == F.col(f"__{id_col}"), *alike]).select(*by, id_col, "a_right", "b_right")


def mcnemar_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a_right") & ~F.col("b_right")).alias("b"),
        F.count_if(~F.col("a_right") & F.col("b_right")).alias("c"),
    )


def mcnemar_p(b: int, c: int, exact_below: int = 25) -> tuple[float | None, float]:
    """Statistic and p-value from the discordant counts: exact binomial if they are few."""
    n = b + c
    if n == 0:
        return None, 1.0
    if n < exact_below:
        tail = sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n
        return None, min(1.0, 2 * tail)
    statistic = (abs(b - c) - 1) ** 2 / n
    return statistic, math.erfc(math.sqrt(statistic / 2))


def log10_erfc(z: float) -> float:
    """Decimal logarithm of erfc(z), also where erfc itself is too small for a double."""
    if z < 10:
        return math.log10(math.erfc(z))
    x = 1 / (2 * z * z)
    series = 1 - x * (1 - 3 * x * (1 - 5 * x * (1 - 7 * x * (1 - 9 * x))))  # asymptotic; what is left out is below 1e-9 from z = 10 on
    return -z * z / math.log(10) - math.log10(z * math.sqrt(math.pi)) + math.log10(series)


def mcnemar_log10_p(b: int, c: int, exact_below: int = 25) -> float:
    """Decimal logarithm of the p-value of ``mcnemar_p``, which is 0 as a double where the counts are large."""
    statistic, p = mcnemar_p(b, c, exact_below)
    return math.log10(p) if statistic is None else log10_erfc(math.sqrt(statistic / 2))


def mcnemar(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts with statistic, p-value and its decimal logarithm: a row for each compared system."""
    counts = mcnemar_counts(pairs, by)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tests = [mcnemar_p(int(b), int(c)) for b, c in zip(batch["b"], batch["c"])]
            logs = [mcnemar_log10_p(int(b), int(c)) for b, c in zip(batch["b"], batch["c"])]
            yield batch.assign(statistic=pd.Series([t[0] for t in tests], dtype="float64", index=batch.index), p=[t[1] for t in tests], log10_p=logs)

    schema = ", ".join(f"{n} {t}" for n, t in counts.dtypes)
    return counts.mapInPandas(add, f"{schema}, statistic double, p double, log10_p double")


def mcc_of(cells: np.ndarray) -> np.ndarray:
    """MCC of rows (tp, fp, fn, tn); 0 where a margin is empty."""
    tp, fp, fn, tn = cells.T.astype(float)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return np.divide(tp * tn - fp * fn, np.sqrt(product), out=np.zeros(len(cells)), where=product > 0)


def accuracy_difference(cells: np.ndarray) -> np.ndarray:
    """Difference of accuracy from rows (both right, only a, only b, both wrong)."""
    return (cells[:, 1] - cells[:, 2]) / cells.sum(axis=1)


def bootstrap(spark, groups: list[list[int]], value: Callable[[list[np.ndarray]], np.ndarray], replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """(replicate, value) from cell counts of one or more independent groups."""
    if any(sum(g) == 0 for g in groups):
        raise ValueError("a group is empty")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [np.empty((len(batch), len(g)), np.int64) for g in groups]
            for i, r in enumerate(batch["id"]):
                rng = np.random.Generator(np.random.PCG64([seed, int(r)]))
                for k, g in enumerate(groups):
                    cells[k][i] = rng.multinomial(sum(g), np.array(g) / sum(g))
            yield pd.DataFrame({"replicate": batch["id"], "value": value(cells)})

    return spark.range(replicates).mapInPandas(draw, "replicate long, value double")


def interval(draws: DataFrame, replicates: int, confidence: float = 0.95) -> DataFrame:
    """(low, high): order statistics of the replicates, without interpolation."""
    alpha = 1 - confidence
    low, high = max(0, int(alpha / 2 * replicates)), min(replicates - 1, int((1 - alpha / 2) * replicates) - 1)
    ranked = draws.withColumn("r", F.row_number().over(Window.orderBy("value", "replicate")) - 1)  # as many rows as replicates
    return ranked.agg(F.max(F.when(F.col("r") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("value"))).alias("high"))


def paired_accuracy_interval(pairs: DataFrame, replicates: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Difference of accuracy between two systems on the same items, with its interval."""
    a, b = F.col("a_right"), F.col("b_right")
    cells = [int(x) for x in pairs.agg(F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b), F.count_if(~a & ~b)).first()]
    draws = bootstrap(pairs.sparkSession, [cells], lambda g: accuracy_difference(g[0]), replicates, seed)
    return interval(draws, replicates, confidence).withColumn("difference", F.lit((cells[1] - cells[2]) / sum(cells)))


def mcc_difference_interval(spark, first: list[int], second: list[int] | None = None, replicates: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """MCC of one group, or the difference of two independent groups, from (tp, fp, fn, tn)."""
    groups = [first] if second is None else [first, second]
    diff = lambda g: mcc_of(g[0]) - (mcc_of(g[1]) if len(g) > 1 else 0)
    point = float(diff([np.array([x]) for x in groups])[0])
    out = interval(bootstrap(spark, groups, diff, replicates, seed), replicates, confidence)
    return out.withColumn("difference", F.lit(point)).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


PRIME = 2**31 - 1  #: of the weights' hashes
_AHEAD = 64  # replicates that a task weighs at once


def poisson_steps() -> list[int]:
    """Borders of a Poisson(1) weight on the range of hashes: the weight is how many lie at or below the hash."""
    below, term, out = 0.0, math.exp(-1), []
    for k in range(1, 12):
        below += term
        term /= k
        out.append(math.floor(below * PRIME))
    return out


def poisson_weights(h: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Weights (rows x replicates) from a row's hash below ``PRIME``, by two squarings between linear steps."""
    x = (h[:, None] + (replicates + 1) * 1_000_003) % PRIME
    x = (x * x + h[:, None]) % PRIME
    x = (x * 48_271 + replicates) % PRIME
    x = (x * x + h[:, None] * 3) % PRIME
    return np.searchsorted(poisson_steps(), (x * 16_807) % PRIME, side="right")


def row_hash(id_col: Column, seed: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(PRIME))


def poisson_bootstrap(rows: DataFrame, sums: dict[str, Column], value: Column, replicates: int = 200, seed: int = 0, id_col: str = "id") -> DataFrame:
    """(replicate, value) of any metric that is an expression over sums of row values.

    ``sums`` names what is summed up; ``value`` is an expression over those
    names and ``weight``, the total weight. Each row has a Poisson(1) weight in
    each replicate from a hash of id and seed, so the total varies between
    replicates. A task goes through its rows once and holds a vector of
    ``replicates`` sums for each name; what is shuffled is a row per task and
    replicate, however many rows there are. Null values count as 0.
    """
    names = list(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, len(names) + 1))
        for batch in batches:
            h = batch.column(0).to_numpy()
            x = np.column_stack([np.ones(len(h)), *(np.nan_to_num(batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float)) for k in range(len(names)))])
            for lo in range(0, replicates, _AHEAD):
                some = np.arange(lo, min(lo + _AHEAD, replicates), dtype=np.int64)
                total[some] += poisson_weights(h, some).T @ x
        columns = [pa.array(np.arange(replicates, dtype=np.int64)), *(pa.array(c) for c in total.T)]
        yield pa.RecordBatch.from_arrays(columns, names=["replicate", "weight", *names])

    given = rows.select(row_hash(F.col(id_col), seed).alias("h"), *[c.cast("double").alias(n) for n, c in sums.items()])
    parts = given.mapInArrow(add, "replicate long, weight double, " + ", ".join(f"`{n}` double" for n in names))
    return parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in ("weight", *names)]).select("replicate", value.alias("value"))


def verdict_on_difference(low: Column, high: Column) -> Column:
    """Whether an interval confirms a positive difference."""
    return F.when(low > 0, "CONFIRMED").when(high < 0, "REFUTED").otherwise("INCONCLUSIVE")
