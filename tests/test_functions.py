import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomwatch.functions import expressions as X
from loomwatch.functions.constants import UNRESOLVED
from loomwatch.functions.measures import measures, wilson
from loomwatch.operators import audit, corpus, evaluation, leakage, sampling, scorers, significance


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def measure(spark, tp, fp, fn, tn, name):
    return one(spark, measures(F.lit(tp), F.lit(fp), F.lit(fn), F.lit(tn))[name])


def test_mcc_goldens(spark):
    assert measure(spark, 90, 4, 1, 5, "mcc") == pytest.approx(0.6562258828755642)
    assert measure(spark, 268, 1045, 117, 493, "mcc") == pytest.approx(0.014, abs=5e-4)
    assert measure(spark, 260, 722, 125, 818, "mcc") == pytest.approx(0.165, abs=5e-4)
    assert measure(spark, 0, 0, 5, 5, "mcc") is None
    assert measure(spark, 0, 0, 5, 5, "precision") is None


def test_wilson_goldens(spark):
    for s, n, low, high in ((50, 100, 0.4038, 0.5962), (90, 100, 0.8256, 0.9448), (268, 385, 0.648, 0.740)):
        w = one(spark, wilson(F.lit(s), F.lit(n)))
        assert (w["low"], w["high"]) == (pytest.approx(low, abs=5e-4), pytest.approx(high, abs=5e-4))
    with pytest.raises(Exception, match="successes"):
        one(spark, wilson(F.lit(3), F.lit(0)))


def test_mcnemar_goldens():
    for b, c, p in ((268, 1045, 9.569e-102), (317, 819, 5.608e-50), (292, 930, 3.432e-74), (323, 731, 4.717e-36)):
        assert significance.mcnemar_p(b, c)[1] == pytest.approx(p, rel=1e-3)
    assert significance.mcnemar_p(21, 9)[0] == pytest.approx(121 / 30)
    assert significance.mcnemar_p(0, 0) == (None, 1.0)
    assert significance.mcnemar_p(3, 15)[1] == pytest.approx(2 * sum(math.comb(18, k) for k in range(4)) / 2**18)


def test_calibration_golden(spark):
    rows = [Row(c=0.9, ok=k < 3) for k in range(5)] + [Row(c=0.2, ok=k < 1) for k in range(5)]
    out = evaluation.calibration_error(spark.createDataFrame(rows), F.col("c"), F.col("ok")).first()
    assert out["ece"] == pytest.approx(0.15)


def test_mcnemar_p_too_small_for_a_double(spark):
    """A p-value below 1e-308 keeps its logarithm; reference from erfc by its continued fraction."""

    def reference(z):
        f = z
        for k in range(400, 0, -1):
            f = z + (k / 2) / f
        return -z * z / math.log(10) - math.log10(math.sqrt(math.pi) * f)

    for z in (3.0, 9.99, 10.0, 26.9, 60.0):
        assert significance.log10_erfc(z) == pytest.approx(reference(z), abs=1e-8)
    pairs = spark.range(13_212).select((F.col("id") < 11_533).alias("a_right"), (F.col("id") >= 11_533).alias("b_right"))
    row = significance.mcnemar(pairs).first()
    assert row["p"] == 0.0 and row["log10_p"] == pytest.approx(-1597.62638, abs=1e-5)
    assert significance.mcnemar_log10_p(3, 15) == pytest.approx(math.log10(significance.mcnemar_p(3, 15)[1]))
    assert significance.mcnemar_log10_p(0, 0) == 0.0



def test_selective_golden(spark):
    rows = [Row(pred=(k < 4) if k < 6 else None, is_malicious=True) for k in range(10)]
    out = evaluation.selective(spark.createDataFrame(rows, "pred boolean, is_malicious boolean"), []).first()
    assert (out["coverage"], out["selective_accuracy"]) == (0.6, pytest.approx(4 / 6))


def test_ranking_extremes(spark):
    rows = [Row(is_malicious=k < 3, score=float(-k), up=float(k)) for k in range(6)]
    df = spark.createDataFrame(rows)
    assert evaluation.ranking(df, []).first()["roc_auc"] == 1.0
    assert evaluation.ranking(df, [], score="up").first()["roc_auc"] == 0.0
    assert evaluation.ranking(df.filter("is_malicious"), []).first()["pr_auc"] is None


def test_allocation_golden(spark):
    sizes = spark.createDataFrame([("a", 7), *[(f"s{k:02}", 1000 + k) for k in range(11)]], "stratum string, n long")
    quota = {r["stratum"]: r["quota"] for r in sampling.quotas(sizes, 385).collect()}
    assert quota["a"] == 7 and sorted(quota.values()) == [7] + [34] * 7 + [35] * 4
    assert sum(r["quota"] for r in sampling.quotas(sizes, 10**9).collect()) == sum(r["n"] for r in sizes.collect())


def test_canonical(spark):
    cases = {"-9223372036854775808": "9223372036854775808", " 0x8000000000000000": "9223372036854775808", "007": "7", "-1": "18446744073709551615", "1e3": "1e3", "12.5": "12.5", "AbC ": "AbC", "-0x1": "18446744073709551615", "0x1" + "0" * 20: str(16**20)}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.canonical(F.col("v")).alias("c")).collect()
    assert {r["v"]: r["c"] for r in rows} == cases


def test_context_and_pseudonym(spark):
    maps = [({"User": "-"}, False), ({"User": "bob"}, True), ({"DestinationIp": "1.1.1.1"}, True), ({"CommandLine": " "}, False), ({"TargetUserName": "-\\-"}, False), ({}, False)]
    rows = spark.createDataFrame([(m,) for m, _ in maps], "m map<string,string>").select(X.context_rich(F.col("m")).alias("r")).collect()
    assert [r["r"] for r in rows] == [want for _, want in maps]
    assert one(spark, X.pseudonym(F.lit("WS1.lab.local"))) == one(spark, X.pseudonym(F.lit("ws1")))


def test_rebase_text(spark):
    start = F.lit("2020-09-04 07:00:00").cast("timestamp_ntz")
    got = lambda v: one(spark, X.rebase_text(F.lit(v), start))
    assert got("2020-09-04T07:06:24.288Z") == "2000-01-01T00:06:24.288000Z"
    assert got("2020-09-04 07:06:22") == "2000-01-01 00:06:22"
    assert got("yesterday") == "yesterday"


def test_policies(spark):
    with pytest.raises(ValueError):
        X.collapse(F.lit("benign"), "other")
    assert one(spark, X.verdict_score(F.lit("malicious"), F.lit(0.9))) == pytest.approx(2.9 / 3)


def _records(spark, malicious, benign, code=1):
    rows = [(f"m{k}", True, code, {"CommandLine": "x"} if k % 2 else {"Only": "1", "CommandLine": "y"}, "2019-03-19 00:00:30", "c", "T1059", False, "captures", "h.lab", "process") for k in range(malicious)]
    rows += [(f"b{k}", False, code, {"CommandLine": "0x10", "Extra": "z"}, "2022-04-04 00:00:00", "base", None, False, "baseline", "w", "process") for k in range(benign)]
    schema = "id string, is_malicious boolean, event_code int, fields map<string,string>, ts string, source_capture_id string, attack_technique string, technique_unresolved boolean, source_dataset string, source_host string, event_type string"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_ratio_cap_and_shared_keys(spark):
    out = leakage.restrict_to_shared_support(_records(spark, 100, 10))
    counts = {r["is_malicious"]: r["count"] for r in out.groupBy("is_malicious").count().collect()}
    assert counts == {True: 15, False: 10}
    assert {tuple(r["k"]) for r in out.select(F.map_keys("fields").alias("k")).collect()} == {("CommandLine",)}


def test_assemble_ratio_and_determinism(spark):
    rows = _records(spark, 100, 1000)
    a = corpus.assemble_corpus(rows, mitigate=False)
    counts = {r["is_malicious"]: r["count"] for r in a.groupBy("is_malicious").count().collect()}
    assert counts == {True: 100, False: 400}
    again = corpus.assemble_corpus(rows.repartition(7), mitigate=False)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in again.collect()}
    few = corpus.assemble_corpus(_records(spark, 1000, 40), mitigate=False)
    assert few.count() == 50
    with pytest.raises(ValueError):
        corpus.assemble_corpus(_records(spark, 0, 10))
    years = corpus.assemble_corpus(rows).select(F.year("ts").alias("y")).distinct().collect()
    assert [r["y"] for r in years] == [2000]


def test_audit_flags_before_and_not_after(spark):
    rows = _records(spark, 100, 100)
    before = {r["check"]: r["flagged"] for r in audit.shortcut_audit(rows).filter("key = ''").collect()}
    assert before["year"] and before["field_count"]
    after = corpus.assemble_corpus(rows, ratio=1.0)
    flags = {r["check"]: r["flagged"] for r in audit.shortcut_audit(after).filter("key = ''").collect()}
    assert not flags["year"] and not flags["field_count"] and not flags["event"]


def test_labels(spark):
    rows = spark.createDataFrame([(True, None, False), (False, "T1", False), (True, "T1", True), (True, UNRESOLVED, False), (True, "T1", False)], "is_malicious boolean, attack_technique string, technique_unresolved boolean")
    assert corpus.label_violations(rows).count() == 4
    with pytest.raises(Exception, match="inconsistent"):
        corpus.require_labels(rows).count()


def test_split_falls_back_and_raises(spark):
    rows = _records(spark, 40, 40).withColumn("source_capture_id", F.when(F.col("is_malicious"), F.concat(F.lit("c"), F.length("id"))).otherwise("base"))
    held = rows.filter("id IN ('m1', 'b1')")
    fit, strategy = corpus.leakage_safe_split(rows, held)
    assert strategy == "id" and fit.join(held.select("id"), "id").isEmpty()
    with pytest.raises(ValueError):
        corpus.leakage_safe_split(held, held)


def test_prompt_reads_no_label(spark):
    rows = _records(spark, 2, 2)
    a = scorers.prompts(rows).select("id", "prompt")
    b = scorers.prompts(rows.withColumn("is_malicious", ~F.col("is_malicious")).withColumn("attack_technique", F.lit("T9999"))).select("id", "prompt")
    assert a.exceptAll(b).isEmpty()


def test_determinism_needs_repeats(spark):
    rows = spark.createDataFrame([("a", "benign"), ("a", "benign"), ("b", "benign"), ("b", None)], "id string, verdict string")
    assert evaluation.determinism(rows, ["verdict"]).first()["rate"] == 0.5
    with pytest.raises(Exception, match="repeats"):
        evaluation.determinism(rows.dropDuplicates(["id"]), ["verdict"]).first()


def test_poisson_bootstrap(spark):
    rows = spark.range(2000).withColumn("x", (F.col("id") % 2).cast("double"))
    out = significance.poisson_bootstrap(rows, {"x": F.col("x")}, F.col("x") / F.col("weight"), 20)
    assert out.agg(F.avg("value")).first()[0] == pytest.approx(0.5, abs=0.03)


def test_sums_before_distinct_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.rand(5) - 0.5).alias("s"), (F.col("id") % 2 == 0).alias("is_malicious"), F.lit(1).alias("v"))
    rows = rows.withColumn("g", F.when(F.col("g") > 0, F.col("g"))).cache()
    got = evaluation.before(rows, ["g"], "s", ["v"], cells=16).collect()
    by = {}
    for r in sorted(got, key=lambda r: -r["s"]):
        assert r["v_before"] == by.get(r["g"], 0)
        by[r["g"]] = r["v_before"] + 1
    assert sum(by.values()) == 5000


def test_bins_go_by_their_edges(spark):
    rows = spark.createDataFrame([(k / 100, True) for k in range(101)], "c double, ok boolean")
    out = {r["bin"]: r["n"] for r in evaluation.reliability_bins(rows, F.col("c"), F.col("ok"), 100).collect()}
    assert out == {**dict.fromkeys(range(99), 1), 99: 2}


def test_every_item_needs_one_verdict(spark):
    items = spark.createDataFrame([("a", True), ("b", False)], "id string, is_malicious boolean")
    verdicts = spark.createDataFrame([("a", "malicious", 0.9)], "id string, verdict string, confidence double")
    with pytest.raises(Exception, match="not one verdict for b"):
        evaluation.predictions_of_verdicts(items, verdicts).collect()
    assert evaluation.predictions_of_verdicts(items.filter("id = 'a'"), verdicts).count() == 1


def test_split_says_how_it_was_made(spark):
    rows = spark.createDataFrame([(str(k), k % 5 == 0, f"c{k % 10}", "process", {"EventID": str(k % 3)}) for k in range(100)], "id string, is_malicious boolean, source_capture_id string, event_type string, fields map<string,string>")
    held = rows.filter("source_capture_id IN ('c0', 'c1')")
    fit, strategy = corpus.leakage_safe_split(rows, held)
    said = corpus.split_disclosure(rows, fit, held, strategy).first()
    assert (said["fit_malicious"], said["fit_benign"], said["held_malicious"], said["held_benign"], said["benign_by"]) == (10, 70, 10, 10, "capture")
    assert corpus.overlap(fit, held).first().asDict() == {"ids": 0, "malicious_captures": 0, "benign_captures": 0}
    assert corpus.overlap(rows, held).first()["ids"] == 20


def test_canonical_of_any_width(spark):
    cases = {}
    for n in (1, 5, 6, 7, 15, 16, 17, 18, 31, 40, 64, 200):
        for digits in ("f" * n, "1" + "0" * (n - 1), "00" + "9a" * (n // 2 + 1), "0" * n):
            cases["0x" + digits] = str(int(digits, 16))
            value = -int(digits, 16)
            cases["-0X" + digits] = str(value + 2**64 if -(2**63) <= value < 0 else value)
        number = "9" * n
        cases["+00" + number] = str(int(number))
        cases["-" + number] = str(2**64 - int(number) if int(number) <= 2**63 else -int(number))
    cases |= {"-0": "0", "0x": "0x", "0xfg": "0xfg", "": "", " +7 ": "7", "--1": "--1"}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.canonical(F.col("v")).alias("c")).collect()
    assert {r["v"]: r["c"] for r in rows} == cases
    nulls = spark.createDataFrame([(None, "VOID"), ("0x10", "OBJECT<a: BIGINT>"), ("0x10", "STRING"), ("18446744073709551616", "DECIMAL(20,0)")], "v string, k string")
    assert [r[0] for r in nulls.select(X.canonical(F.col("v"), F.col("k"))).collect()] == [None, "0x10", "16", "18446744073709551616"]


@pytest.mark.parametrize("ids", [1, 5, 10, 20, 50, 200, 20_000])
def test_quota_of_repeated_ids(spark, ids):
    rows = spark.range(20_000).select((F.col("id") % ids).cast("string").alias("id"), F.lit("s").alias("stratum"), F.col("id").alias("row"))
    rows = rows.unionByName(rows.withColumn("stratum", F.when(F.col("row") % 7 == 0, F.lit(None).cast("string")).otherwise("t")))
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).withColumn("quota", F.when(F.col("stratum") == "t", 0).when(F.col("stratum") == "s", 100).otherwise(2000))
    out = sampling.take_quota(rows, sizes, ["stratum"], 3).collect()
    assert len({(r["stratum"], r["row"]) for r in out}) == len(out) == 2100
    assert sum(r["stratum"] == "s" for r in out) == 100


def test_cells_by_quantile(spark):
    """One far key doesn't push the others into one cell."""
    rows = spark.range(20_000).select(F.rand(3).alias("s"), F.lit(1).alias("v")).unionByName(spark.createDataFrame([(1e9, 1), (None, 1)], "s double, v int"))
    borders = rows.agg(F.percentile_approx("s", [k / 64 for k in range(1, 64)], 16 * 64).alias("b"))
    sizes = [r["count"] for r in rows.filter("s IS NOT NULL").crossJoin(borders).groupBy(evaluation.cell_of(F.col("s"), F.col("b"), 8)).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = sorted(((r["s"], r["v_before"]) for r in evaluation.before(rows, [], "s", ["v"], cells=64).collect()), key=lambda r: r[1])
    assert [n for _, n in got] == list(range(20_002)) and got[0][0] == 1e9 and got[-1][0] is None


def test_poisson_sums_and_intervals(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    a, b = ({r["replicate"]: r["value"] for r in significance.poisson_bootstrap(rows.repartition(n), {"x": F.col("x")}, F.col("x") / F.col("weight"), 300).collect()} for n in (1, 7))
    assert a.keys() == b.keys() == set(range(300)) and all(a[k] == pytest.approx(b[k]) for k in a)
    mean = sum(a.values()) / 300
    spread = math.sqrt(sum((v - mean) ** 2 for v in a.values()) / 299)
    assert mean == pytest.approx(4.5, abs=0.02) and spread == pytest.approx(math.sqrt(8.25 / 4000), rel=0.15)
    weights = significance.poisson_weights(rows.select(significance.row_hash(F.col("id"), 1).alias("h")).toPandas()["h"].to_numpy(), significance.np.arange(50))
    assert weights.mean() == pytest.approx(1, abs=0.02) and weights.var() == pytest.approx(1, abs=0.03)
    assert abs(significance.np.corrcoef(weights.T) - significance.np.eye(50)).max() < 0.08  # replicates don't repeat each other


def test_sketches_merge(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("day"), F.lit("process").alias("event_type"), F.create_map(F.lit("EventID"), F.lit("1"), F.lit("CommandLine"), F.expr("repeat('x', CAST(id % 9000 AS INT))")).alias("fields"))
    exact = corpus.duplication(rows).first()
    merged = corpus.merged_duplication(corpus.vector_sketch(rows, ["day"])).first()
    assert merged["n"] == exact["n"] and abs(merged["distinct"] - exact["distinct"]) <= 0.02 * exact["distinct"]


def test_types_tell_the_class(spark):
    """Text "5" and number 5 have the same text; only the type differs, and after canonicalisation nothing does."""
    rows = _records(spark, 50, 50).withColumn("fields", F.create_map(F.lit("Code"), F.lit("5"), F.lit("Gap"), F.lit(None).cast("string")))
    rows = rows.withColumn("field_types", F.create_map(F.lit("Code"), F.when(F.col("is_malicious"), "STRING").otherwise("BIGINT"), F.lit("Gap"), F.lit("VOID")))
    found = {r["key"]: r["accuracy"] for r in audit.shortcut_audit(rows).filter("check = 'value_type'").collect()}
    assert found["Code"] == 1.0 and "Gap" not in found
    text = {r["key"]: r["accuracy"] for r in audit.shortcut_audit(rows.drop("field_types")).filter("check = 'value_type'").collect()}
    assert text["Code"] == 0.5
    after = leakage.restrict_to_shared_support(rows)
    assert {r["key"]: r["accuracy"] for r in audit.type_accuracy(after).collect()}["Code"] == 0.5
    capped = {r["n"] for r in audit.shortcut_audit(rows, per_class=20).filter("check = 'year'").collect()}
    assert capped == {40}


def test_core_keys(spark):
    rows = _records(spark, 3, 3)
    core = {1: ["CommandLine", "Only", "Extra", "Image"], 2: ["Image"]}
    assert sorted(tuple(r) for r in leakage.missing_core_keys(rows, core).collect()) == [(1, "Extra", "malicious"), (1, "Image", "benign"), (1, "Image", "malicious"), (1, "Only", "benign")]


def test_calls_in_flight(spark, tmp_path):
    rows = _records(spark, 40, 40)
    mark = str(tmp_path)

    def call(prompts):
        import os
        import time

        time.sleep(0.05)
        if any("Only" in p for p in prompts):
            raise RuntimeError("server went away")
        path = os.path.join(mark, str(hash(tuple(prompts))))
        if not os.path.exists(path):  # the first attempt of every call fails
            open(path, "w").close()
            raise TimeoutError("slow")
        return ['{"verdict":"benign","confidence":0.8,"reasoning":"plain"}'] * len(prompts)

    out = scorers.score_batch(rows, call, in_flight=4, per_call=1, attempts=2, backoff=0.01).collect()
    failed = {r["id"] for r in out if r["response"] is None}
    assert failed == {f"m{k}" for k in range(0, 40, 2)} and len(out) == 80
    assert {r["call_error"] for r in out if r["id"] in failed} == {"RuntimeError: server went away"}
    assert all(r["verdict"] == "benign" and r["call_error"] is None for r in out if r["id"] not in failed)
    with pytest.raises(Exception, match="no verdict for .*slow|no verdict for .*went away"):
        scorers.score_batch(rows, call, attempts=1, stop_on_error=True).collect()


def test_ordered_table(spark, tmp_path):
    from loomwatch.operators import ordering

    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("g"))
    out = ordering.write_shuffled(rows, 7, str(tmp_path / "t"), parts=6)
    want = [r["id"] for r in rows.orderBy(X.draw_key(F.col("id"), 7), "id").collect()]
    assert [r["id"] for r in out.orderBy("ordinal").collect()] == want
    assert sorted(r["ordinal"] for r in out.collect()) == list(range(5000))
    assert [r["id"] for r in ordering.first_rows(out, 10).orderBy("ordinal").collect()] == want[:10]
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    import pyarrow.parquet as pq

    assert [x for f in files for x in pq.read_table(f).column("id").to_pylist()] == want  # the table is in order as it lies there
    assert ordering.write_shuffled(rows.limit(0), 7, str(tmp_path / "none")).count() == 0


@pytest.fixture
def small_broadcasts(spark):
    """Only tables of a few kilobytes count as small."""
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _many(spark):
    return spark.range(20_000).selectExpr(
        "concat('ev:', id) AS id", "id % 3 = 0 AS is_malicious", "CAST(IF(id % 10 = 0, 1, 2) AS INT) AS event_code", "IF(id % 10 = 0, 'cap-1', 'base') AS source_capture_id",
        "TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "map('EventID', '1', 'UtcTime', '2020-01-01 00:00:01.5') AS fields",
    )


def test_few_captures_move_no_row(spark, small_broadcasts):
    """The starts of captures are broadcast by their own size, so a capture with most rows isn't read by one task."""
    moved = leakage.neutralize_times(_many(spark))
    assert "SortMergeJoin" not in _plan(moved) and "Exchange hashpartitioning" not in _plan(moved)
    assert moved.agg(F.min("ts").cast("string")).first()[0] == "2000-01-01 00:00:00" and moved.count() == 20_000


def test_few_strata_move_no_row(spark, small_broadcasts):
    """Quotas and shared keys are broadcast by their own sizes; only the band of a stratum is ranked."""
    rows = _many(spark)
    sample = sampling.eval_sample(rows, "event_code", size=1000)
    assert "SortMergeJoin" not in _plan(sample) and sample.count() == 1000
    kept = leakage.restrict_to_shared_support(rows)
    assert "SortMergeJoin" not in _plan(kept)
    assert kept.filter("is_malicious").count() * 1.5 == pytest.approx(kept.filter("NOT is_malicious").count(), abs=2)


def test_bucket_counts_are_one_pass(spark):
    """Both buckets are counted by one scan and one aggregate."""
    from loomwatch.plans import experiments

    counts = experiments.bucket_events(experiments.with_bucket(_many(spark)))
    assert _plan(counts).count("Range (0, 20000") == 1
    assert [tuple(r) for r in counts.collect()] == [(2, 0, 18_000), (1, 0, 2_000)]
