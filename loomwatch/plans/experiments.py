"""Whole evaluations as functions that return DataFrames: scoring of a sample, and the comparison of context buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions.constants import POLICIES
from loomwatch.functions.expressions import context_bucket, draw_key
from loomwatch.operators import corpus, evaluation, sampling, scorers, significance
from loomwatch.sources.shared import written

SEED = 20260818
CONTEXT_SEED = 20260819
_COLUMNS = ["system", "id", "is_malicious", "event_code", "event_type", "attack_technique", "technique_unresolved", *[f"pred_{p}" for p in POLICIES], "score", "confidence", "parse_failed"]


def base_rate(rows: DataFrame) -> DataFrame:
    """Share of malicious rows."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_malicious").cast("double")).alias("rate"))


def take_per_class(rows: DataFrame, n: int, seed: int = SEED, label: str = "is_malicious", id_col: str = "id") -> DataFrame:
    """``n`` rows of each class, by hash."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("quota", F.least("n", F.lit(n)))
    return sampling.take_quota(rows, counts, [label], seed, id_col)


def first_rows(rows: DataFrame, n: int, seed: int = SEED, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows of a seeded order, for repeats."""
    return rows.orderBy(draw_key(F.col(id_col), seed), id_col).limit(n)


def with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", context_bucket(F.col("fields")))


def bucket_events(rows: DataFrame) -> DataFrame:
    """Counts of each event code in both buckets, 0 where a bucket has none."""
    sides = [F.count_if(F.col("bucket") == b).alias(short) for b, short in (("context_rich", "rich"), ("context_poor", "poor"))]
    return rows.groupBy("event_code").agg(*sides).orderBy(F.desc(F.col("rich") + F.col("poor")), "event_code")


def systems(sample: DataFrame, fit: DataFrame, verdicts: DataFrame, rate: float, seed: int = SEED, max_iter: int = 1000) -> DataFrame:
    """Predictions of the verdicts and of four baselines for the same items, in one long table."""
    out = evaluation.predictions_of_verdicts(sample, verdicts).withColumn("system", F.lit("verdicts")).select(*_COLUMNS)
    baselines = {
        "majority": scorers.majority(sample),
        "random": scorers.stratified_random(sample, rate, seed),
        "rules": scorers.rules(sample),
        "classical": scorers.classical(fit, sample, max_iter=max_iter),
    }
    for name, scored in baselines.items():
        out = out.unionByName(scorers.as_predictions(scored, name).select(*_COLUMNS))
    return out


def significance_report(predictions: DataFrame, headline: str = "conservative", reference: str = "verdicts") -> DataFrame:
    """McNemar's test of the reference system against each other one, on items where both commit."""
    rows = predictions.withColumn("pred", F.col(f"pred_{headline}"))
    mine = rows.filter(F.col("system") == reference)
    others = rows.filter(F.col("system") != reference).select("system", "id", "is_malicious", "pred")
    left = mine.filter("pred IS NOT NULL").select("id", (F.col("pred") == F.col("is_malicious")).alias("a_right"))
    right = others.filter("pred IS NOT NULL").select("system", "id", (F.col("pred") == F.col("is_malicious")).alias("b_right"))
    return significance.mcnemar(left.join(right, "id"), ["system"])


def technique_slice() -> Column:
    """The technique of a record as a slice: none for unresolved records, which are reported apart."""
    return F.when(F.col("technique_unresolved"), None).when(~F.col("is_malicious"), "benign").otherwise(F.coalesce("attack_technique", F.lit("unknown")))


def report(predictions: DataFrame) -> dict[str, DataFrame]:
    """The metric tables of all systems, keyed by name."""
    rows = evaluation.by_policy(predictions).withColumn("policy", F.concat_ws("/", "system", "policy"))
    committed = predictions.filter(F.col("pred_conservative").isNotNull())
    return {
        "slices": evaluation.full_slice_report(rows.withColumn("technique", technique_slice()), ["event_code", "event_type", "technique"]),
        "techniques": evaluation.technique_slices(rows),
        "ranking": evaluation.ranking(committed, ["system"]),
        "selective": evaluation.selective(rows, ["policy"]),
        "macro": evaluation.macro_weighted(rows, ["policy"]),
        "significance": significance_report(predictions),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each metric table."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def evaluate(rows: DataFrame, verdicts: DataFrame, size: int = 1925, fraction: float = 0.2, seed: int = SEED, pool: DataFrame | None = None, max_iter: int = 1000) -> dict[str, DataFrame]:
    """Sample (from ``pool``, if some captures are to be fitted on only), fit without leakage, score with all systems, and report."""
    sample = sampling.eval_sample(rows if pool is None else pool, "event_code", size, fraction, seed)
    sample = written(sample, "sample")
    fit, _ = corpus.leakage_safe_split(rows, sample)
    rate = base_rate(sample).first()["rate"]
    verdicts = verdicts.join(sample.select("id"), "id", "left_semi")  # before verdicts are grouped by item
    return report(written(systems(sample, fit, verdicts, rate, seed, max_iter), "predictions"))  # read by every table of the report


def context_cells(rows: DataFrame, verdicts: DataFrame, size: int = 1925, seed: int = CONTEXT_SEED, policy: str = "conservative") -> DataFrame:
    """(bucket, tp, fp, fn, tn, mcc): the confusion of each context bucket's own sample."""
    sample = sampling.eval_sample(with_bucket(rows), "event_code", size=size, seed=seed, by=["bucket"])
    scored = evaluation.predictions_of_verdicts(sample, verdicts).withColumn("pred", F.col(f"pred_{policy}"))
    return evaluation.metric_table(scored, ["bucket"]).select("bucket", "tp", "fp", "fn", "tn", "mcc")


def context_experiment(rows: DataFrame, verdicts: DataFrame, size: int = 1925, seed: int = CONTEXT_SEED, replicates: int = 10_000) -> DataFrame:
    """Confusion cells and MCC of each bucket's own sample, with the interval of their difference and the outcome."""
    spark = rows.sparkSession
    table = context_cells(rows, verdicts, size, seed)
    cells = {r["bucket"]: [r["tp"], r["fp"], r["fn"], r["tn"]] for r in table.collect()}  # two rows
    if missing := {"context_rich", "context_poor"} - cells.keys():
        raise ValueError(f"no rows in {', '.join(sorted(missing))}")
    gap = significance.mcc_difference_interval(spark, cells["context_rich"], cells["context_poor"], replicates, seed=seed)
    return table.join(F.broadcast(gap.withColumn("outcome", significance.verdict_on_difference(F.col("low"), F.col("high")))))  # one row

