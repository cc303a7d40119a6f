"""Published results of significance tests, the fitted baseline, and whole evaluations on small data."""

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import corpus, scorers, significance
from loomwatch.plans import experiments

#: Discordant counts of four published comparisons on 1,923 items, the differences of accuracy and their intervals.
PAIRED = [(268, 1045, -0.404, -0.436, -0.371), (317, 819, -0.261, -0.293, -0.228), (292, 930, -0.332, -0.364, -0.299), (323, 731, -0.212, -0.244, -0.180)]


@pytest.mark.parametrize(("b", "c", "difference", "low", "high"), PAIRED)
def test_paired_intervals_as_published(spark, b, c, difference, low, high):
    rest = 1923 - b - c
    cells = [rest // 2, b, c, rest - rest // 2]
    draws = significance.bootstrap(spark, [cells], lambda g: significance.accuracy_difference(g[0]), 10_000, 5)
    got = significance.interval(draws, 10_000).first()
    assert (b - c) / 1923 == pytest.approx(difference, abs=6e-4)
    assert (got["low"], got["high"]) == (pytest.approx(low, abs=4e-3), pytest.approx(high, abs=4e-3))


def test_paired_interval_of_rows(spark):
    rows = spark.range(1923).select((F.col("id") < 900).alias("a_right"), ((F.col("id") < 632) | (F.col("id") >= 900) & (F.col("id") < 1600)).alias("b_right"))
    got = significance.paired_accuracy_interval(rows, 2000, seed=3).first()
    assert got["difference"] == pytest.approx((268 - 700) / 1923) and got["low"] < got["difference"] < got["high"]


def test_one_sample_mcc_as_published(spark):
    got = significance.mcc_difference_interval(spark, [260, 722, 125, 818], replicates=10_000, seed=2).first()
    assert got["difference"] == pytest.approx(0.165, abs=1e-3) and got["excludes_zero"]
    assert (got["low"], got["high"]) == (pytest.approx(0.123, abs=4e-3), pytest.approx(0.209, abs=4e-3))


def test_two_sample_mcc(spark):
    same = significance.mcc_difference_interval(spark, [50, 50, 50, 50], [500, 500, 500, 500], 2000, seed=1).first()
    assert same["difference"] == 0 and same["low"] < 0 < same["high"] and not same["excludes_zero"]
    apart = significance.mcc_difference_interval(spark, [90, 10, 10, 90], [50, 50, 50, 50], 2000, seed=1)
    assert apart.select(significance.verdict_on_difference(F.col("low"), F.col("high"))).first()[0] == "CONFIRMED"
    back = significance.mcc_difference_interval(spark, [50, 50, 50, 50], [90, 10, 10, 90], 2000, seed=1)
    assert back.select(significance.verdict_on_difference(F.col("low"), F.col("high"))).first()[0] == "REFUTED"
    with pytest.raises(ValueError, match="empty"):
        significance.mcc_difference_interval(spark, [1, 1, 1, 1], [0, 0, 0, 0], 10)
    assert significance.mcc_of(significance.np.array([[5, 0, 0, 0]])).tolist() == [0.0]  # a margin is empty


def _alerts(spark, n):
    command = F.when(F.col("m"), F.concat(F.lit("powershell.exe -enc "), F.repeat(F.lit("QUJD"), (F.col("id") % 9 + 6).cast("int")))).otherwise("explorer.exe")
    rows = spark.range(n).withColumn("m", F.col("id") % 2 == 0)
    return rows.select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.col("m").alias("is_malicious"), (F.col("id") % 3).cast("int").alias("event_code"), F.lit("process").alias("event_type"),
        F.create_map(F.lit("EventID"), F.lit("1"), F.lit("CommandLine"), command, F.lit("User"), F.when(F.col("id") % 5 < 3, "bob")).alias("fields"),
        F.concat(F.when(F.col("m"), "cap").otherwise("base"), (F.col("id") % 20).cast("string")).alias("source_capture_id"), F.when(F.col("m"), "T1059").alias("attack_technique"), F.lit(False).alias("technique_unresolved"), F.lit("h").alias("source_host"),
    )


def test_classical_baseline(spark):
    rows = _alerts(spark, 200)
    fit, held = rows.filter("id < 'r5'"), rows.filter("id >= 'r5'").withColumn("event_type", F.when(F.col("id") == "r60", "never seen").otherwise(F.col("event_type")))
    out = scorers.classical(fit, held).collect()
    assert len(out) == held.count() and all(r["pred"] == r["is_malicious"] == (r["score"] >= 0.5) for r in out)
    with pytest.raises(ValueError, match="both classes"):
        scorers.classical(fit.filter("is_malicious"), held)


def test_classical_fits_distinct_vectors(spark, monkeypatch):
    """The fit sees a row for each distinct vector and class, and scores as a fit on all rows with centred vectors does."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = _alerts(spark, 1200).withColumn("is_malicious", F.expr("IF(crc32(id) % 5 = 0, NOT is_malicious, is_malicious)")).withColumn("event_type", F.expr("IF(crc32(id) % 3 = 0, 'file', event_type)"))
    fit, held = rows.filter("crc32(id) % 4 <> 1"), rows.filter("crc32(id) % 4 = 1")
    seen, plain = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: seen.append(df.count()) or plain(self, df))
    got = {r["id"]: r["score"] for r in scorers.classical(fit, held, max_iter=1000).collect()}
    assert 0 < seen[0] < 100 < fit.count()

    numbers = ["field_count", "command_line_length", "has_binary_name", "has_pattern", "has_parent_command_line", "has_target_object"]
    vector = lambda df: df.withColumn("f", scorers.features(F.col("fields"), F.col("event_type"))).select("id", "is_malicious", "f.event_type", "f.event_id", *[F.col(f"f.{x}").cast("double").alias(x) for x in numbers])
    m, n = fit.filter("is_malicious").count(), fit.count()
    learn = vector(fit).withColumns({"y": F.col("is_malicious").cast("double"), "w": F.when(F.col("is_malicious"), n / (2 * m)).otherwise(n / (2 * (n - m)))})
    stages = [
        StringIndexer(inputCols=["event_type", "event_id"], outputCols=["ti", "ei"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["ti", "ei"], outputCols=["tv", "ev"], dropLast=False),
        VectorAssembler(inputCols=["tv", "ev", *numbers], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=1000, regParam=1.0 / n, standardization=False),
    ]
    want = Pipeline(stages=stages).fit(learn).transform(vector(held)).select("id", vector_to_array("probability")[1]).collect()
    assert len(want) == len(got) > 100 and all(got[i] == pytest.approx(p, abs=1e-4) for i, p in want)


def test_majority_and_random(spark):
    rows = _alerts(spark, 50)
    assert {(r["pred"], r["score"]) for r in scorers.majority(rows).collect()} == {(False, 0.0)}
    drawn = scorers.stratified_random(rows, 0.3).collect()
    assert all(r["pred"] == (r["score"] < 0.3) for r in drawn) and 0 < sum(r["pred"] for r in drawn) < 50
    with pytest.raises(ValueError, match="rate"):
        scorers.stratified_random(rows, 1.5)
    long = scorers.as_predictions(scorers.majority(rows), "majority")
    assert {"pred_conservative", "pred_high_precision", "pred_abstention", "system", "confidence", "parse_failed"} <= set(long.columns)


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = _alerts(spark, 240)
    verdicts = rows.select("id", F.when(F.col("is_malicious"), "malicious").otherwise("benign").alias("verdict"), F.lit(0.9).alias("confidence"))
    pool = rows.filter("source_capture_id IN ('cap0', 'cap2', 'cap4', 'base1', 'base3', 'base5')")
    return experiments.evaluate(rows, verdicts, size=60, fraction=0.5, pool=pool)


def test_evaluation_end_to_end(spark, evaluated, tmp_path):
    slices = {(r["policy"], r["slice_kind"], r["slice_value"]): r for r in evaluated["slices"].collect()}
    assert {k for _, k, _ in slices} == {"pooled", "event_code", "event_type", "technique"}
    best = slices["verdicts/conservative", "pooled", "all"]
    assert (best["tp"], best["fp"], best["fn"], best["tn"], best["mcc"]) == (30, 0, 0, 30, 1.0) and best["roc_auc"] == 1.0 and best["coverage"] == 1.0
    none = slices["majority/conservative", "pooled", "all"]
    assert none["mcc"] is None and none["fn"] == 30
    tests = {r["system"]: r for r in evaluated["significance"].collect()}
    assert tests.keys() == {"majority", "random", "rules", "classical"}
    assert (tests["majority"]["b"], tests["majority"]["c"]) == (30, 0) and tests["majority"]["p"] < 1e-6
    experiments.write_report(evaluated, str(tmp_path / "report"))
    assert {p.name for p in (tmp_path / "report").iterdir()} == set(evaluated)
    assert spark.read.parquet(str(tmp_path / "report" / "slices")).count() == len(slices)


def test_context_experiment(spark):
    rows = _alerts(spark, 400)
    right = F.when(F.col("is_malicious"), "malicious").otherwise("benign")
    verdicts = rows.select("id", F.when(F.col("fields")["User"].isNotNull(), right).otherwise("malicious").alias("verdict"), F.lit(0.9).alias("confidence"))
    poor = rows.withColumn("fields", F.map_filter("fields", lambda k, v: k != "CommandLine"))
    out = {r["bucket"]: r for r in experiments.context_experiment(poor, verdicts, size=100, replicates=1000).collect()}
    assert out.keys() == {"context_rich", "context_poor"} and out["context_rich"]["mcc"] == 1.0 and out["context_poor"]["mcc"] is None
    assert out["context_rich"]["difference"] == 1.0 and out["context_rich"]["outcome"] == "CONFIRMED"
    with pytest.raises(ValueError, match="no rows in context_poor"):
        experiments.context_experiment(rows, verdicts, size=100, replicates=10)


def test_bundle_and_ordered_buckets(spark):
    events = experiments.bucket_events(experiments.with_bucket(_alerts(spark, 30))).collect()
    assert sum(r["rich"] + r["poor"] for r in events) == 30
    assert experiments.first_rows(_alerts(spark, 30), 5).count() == 5
    assert corpus.duplication(_alerts(spark, 30)).first()["n"] == 30


def test_only_verdicts_of_the_sample_are_grouped(spark, monkeypatch):
    rows = _alerts(spark, 400)
    verdicts = rows.select("id", F.when(F.col("is_malicious"), "malicious").otherwise("benign").alias("verdict"), F.lit(0.8).alias("confidence"))
    seen, plain = [], experiments.evaluation.predictions_of_verdicts
    monkeypatch.setattr(experiments.evaluation, "predictions_of_verdicts", lambda items, given: seen.append((items.count(), given.count())) or plain(items, given))
    pool = rows.filter("NOT is_malicious OR source_capture_id IN ('cap0', 'cap2')")
    assert experiments.evaluate(rows, verdicts, size=50, fraction=0.2, pool=pool, max_iter=20)["significance"].count() == 4
    assert seen == [(50, 50)]
