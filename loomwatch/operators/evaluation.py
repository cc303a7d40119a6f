"""Evaluation of predictions: confusion, slices, ranking, calibration, selection.

Predictions are a long table, one row per (system, id). Everything is grouped
aggregation; windows that run over scores run over distinct scores after they
have been counted, so their input is bounded by the number of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.functions.constants import POLICIES, UNRESOLVED
from loomwatch.functions.expressions import collapse, verdict_score
from loomwatch.functions.measures import confusion, measures, ratio, wilson, wilson_or_null


def predictions_of_verdicts(items: DataFrame, verdicts: DataFrame, id_col: str = "id") -> DataFrame:
    """Items with the three decisions, score, confidence and parse_failed of their verdict.

    An item without a verdict is an error, as one of several for an item would be.
    """
    given = verdicts.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"))
    joined = items.join(given, id_col, "left")
    once = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("not one verdict for "), F.col(id_col).cast("string"))).cast("boolean"))
    joined = joined.filter(once).drop("__n")
    decided = {f"pred_{p}": collapse(F.col("verdict"), p) for p in POLICIES}
    return joined.withColumns({**decided, "score": verdict_score(F.col("verdict"), F.col("confidence")), "parse_failed": F.col("verdict").isNull()})


def by_policy(predictions: DataFrame) -> DataFrame:
    """One row per item and policy, with ``policy`` and ``pred``."""
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"pred_{p}").alias("pred")) for p in POLICIES])
    return predictions.withColumn("p", F.explode(rows)).select("*", "p.policy", "p.pred").drop("p")


def metric_table(rows: DataFrame, by: list[str], truth: str = "is_malicious", pred: str = "pred") -> DataFrame:
    """Confusion counts and all measures of each group, over committed rows."""
    counts = rows.filter(F.col(pred).isNotNull()).groupBy(*by).agg(*confusion(F.col(truth), F.col(pred)))
    return counts.withColumns(measures(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def metric_bundle(rows: DataFrame, by: list[str], truth: str = "is_malicious", pred: str = "pred") -> DataFrame:
    """``metric_table`` with ``n``, the committed rows: the whole bundle of 14 values."""
    return metric_table(rows, by, truth, pred).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def slice_report(rows: DataFrame, slices: list[str], truth: str = "is_malicious", pred: str = "pred") -> DataFrame:
    """Pooled and per-slice metrics of each policy in one pass of grouping sets.

    Rows: policy, slice_kind, slice_value, counts, measures, Wilson bounds of
    recall, precision and false-positive rate. A slice with nothing committed
    is absent. A null slice value leaves the row out of that kind of slice.
    """
    committed = rows.filter(F.col(pred).isNotNull())
    sets = [["policy"], *[["policy", s] for s in slices]]
    grouped = committed.groupingSets([[F.col(c) for c in s] for s in sets], "policy", *slices).agg(F.grouping_id().alias("gid"), *confusion(F.col(truth), F.col(pred)))
    width = len(slices)
    kind, value = F.lit("pooled"), F.lit("all")
    for k, s in enumerate(slices):
        gid = (1 << width) - 1 - (1 << (width - 1 - k))
        kind = F.when(F.col("gid") == gid, s).otherwise(kind)
        value = F.when(F.col("gid") == gid, F.col(s).cast("string")).otherwise(value)
    out = grouped.withColumns({"slice_kind": kind, "slice_value": value}).filter(F.col("slice_value").isNotNull())
    return with_measures(out).drop("gid", *slices)


def with_measures(out: DataFrame) -> DataFrame:
    """All measures of confusion counts, with Wilson bounds of recall, precision and false-positive rate."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns(measures(tp, fp, fn, tn))
    bounds = {"recall": (tp, tp + fn), "precision": (tp, tp + fp), "fpr": (fp, fp + tn)}
    for name, (s, n) in bounds.items():
        w = wilson_or_null(s, n)
        out = out.withColumns({f"{name}_low": w["low"], f"{name}_high": w["high"]})
    return out


def full_slice_report(rows: DataFrame, slices: list[str], truth: str = "is_malicious", pred: str = "pred") -> DataFrame:
    """``slice_report`` with class sizes, ranking areas of committed rows, coverage and selective accuracy of every slice.

    Rows are counted once, by policy, values of the slices and score; kinds of
    slices are spread over these counts, and everything else is sums of them.
    """
    held = F.col(pred).isNotNull()
    counted = rows.groupBy("policy", *slices, "score").agg(*confusion(F.col(truth), F.col(pred)), F.count_if(F.col(truth) & ~held).alias("m0"), F.count_if(~F.col(truth) & ~held).alias("b0"))
    kinds = F.array(F.struct(F.lit("pooled").alias("slice_kind"), F.lit("all").alias("slice_value")), *[F.struct(F.lit(s).alias("slice_kind"), F.col(s).cast("string").alias("slice_value")) for s in slices])
    by, cells = ["policy", "slice_kind", "slice_value"], ["tp", "fp", "fn", "tn", "m0", "b0"]
    spread = counted.withColumn("k", F.explode(kinds)).select("policy", "k.*", "score", *cells).filter("slice_value IS NOT NULL")
    scores = spread.groupBy(*by, "score").agg(*[F.sum(c).alias(c) for c in cells])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    committed = tp + fp + fn + tn
    sums = with_measures(scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cells]).filter(committed > 0))
    n = committed + F.col("m0") + F.col("b0")
    told = sums.withColumns({"n_malicious": tp + fn + F.col("m0"), "n_benign": fp + tn + F.col("b0"), "n": n, "committed": committed, "coverage": committed / n, "selective_accuracy": (tp + tn) / committed}).drop("m0", "b0")
    points = scores.select(*by, "score", (tp + fn).alias("p"), (fp + tn).alias("n")).filter("p + n > 0")
    return told.join(areas_of(points, by, "score"), by, "left")


def technique_slices(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """Metrics by technique, and those of unresolved records as a slice of their own."""
    technique = F.when(F.col("technique_unresolved"), UNRESOLVED).when(~F.col("is_malicious"), "benign").otherwise(F.coalesce("attack_technique", F.lit("unknown")))
    return metric_table(rows.withColumn("technique", technique), ["policy", "technique"], pred=pred)


def cell_of(key: Column, borders: Column, step: int = 32) -> Column:
    """How many of the sorted borders are at or below a key: every ``step``-th border is asked first, then those of one stretch."""
    coarse = F.filter(borders, lambda b, i: (i % step == step - 1) & (b <= key))
    fine = F.slice(borders, F.size(coarse) * step + 1, F.lit(step))
    return F.size(coarse) * step + F.size(F.filter(fine, lambda b: b <= key))


def before(rows: DataFrame, by: list[str], key: str, values: list[str], ties: list[str] | None = None, cells: int = 128) -> DataFrame:
    """``rows`` with ``<value>_before``: the sum of a value over the group's rows with larger keys, or equal ones that ``ties`` puts first.

    A group's keys are cut into cells of about as many rows each, at borders
    from a quantile sketch that tasks merge, so that a few far keys don't push
    the others into one cell. Cells are summed up first, and a window over at
    most ``cells`` sums shifts the sums inside each cell: no task sorts a group
    whose keys are as many as its rows. Null keys come last.
    """
    names = [f"__by{i}" for i in range(len(by))]
    shares = F.expr(f"array({', '.join(f'{k / cells!r}D' for k in range(1, cells))})")
    borders = F.percentile_approx(F.col(key).cast("double"), shares, 16 * cells).alias("__borders")
    span = rows.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)]).agg(borders)
    same = [rows[b].eqNullSafe(F.col(n)) for b, n in zip(by, names)]
    placed = (rows.join(span, same) if by else rows.crossJoin(F.broadcast(span))).drop(*names)  # one row
    placed = placed.withColumn("__cell", F.when(F.col(key).isNull(), -1).otherwise(cell_of(F.col(key).cast("double"), F.col("__borders")))).drop("__borders")
    order = Window.partitionBy(*by).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "__cell").orderBy(F.desc_nulls_last(key), *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "__cell").agg(*[F.sum(v).alias(v) for v in values])
    shifts = sums.select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col("__cell").alias("__c"), *[F.coalesce(F.sum(v).over(order), F.lit(0)).alias(f"__s_{v}") for v in values])
    joined = placed.withColumns({f"__i_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = joined.join(shifts, [*[joined[b].eqNullSafe(F.col(n)) for b, n in zip(by, names)], joined["__cell"] == shifts["__c"]])
    return joined.select(*rows.columns, *[(F.col(f"__i_{v}") + F.col(f"__s_{v}")).alias(f"{v}_before") for v in values])


def ranking(rows: DataFrame, by: list[str], truth: str = "is_malicious", score: str = "score") -> DataFrame:
    """Average precision and ROC area of each group; null where a group has one class only.

    Ties are one threshold. Rows are first counted by distinct score.
    """
    return areas_of(rows.groupBy(*by, score).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n")), by, score)


def areas_of(counted: DataFrame, by: list[str], score: str) -> DataFrame:
    """``ranking`` from the rows of each class (p, n) at each distinct score."""
    sums = before(counted, by, score, ["p", "n"]).withColumns({"tp": F.col("p_before") + F.col("p"), "fp": F.col("n_before") + F.col("n")})
    points = sums.groupBy(*by).agg(
        F.sum("p").alias("pos"),
        F.sum("n").alias("neg"),
        F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("weighted"),
        F.sum(F.col("n").cast("double") * (F.col("tp") - F.col("p") / 2)).alias("area"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return points.select(*by, F.when(both, ratio(F.col("weighted"), F.col("pos"))).alias("pr_auc"), F.when(both, ratio(F.col("area"), F.col("pos").cast("double") * F.col("neg"))).alias("roc_auc"))


def reliability_bins(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, low, high, n, mean_confidence, accuracy, total) of equal-width bins; the last is closed.

    Confidences outside [0, 1] are in no bin but count in ``total``.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    inside = (F.col("c") >= 0) & (F.col("c") <= 1)
    placed = rows.select(confidence.cast("double").alias("c"), correct.alias("ok")).filter("c IS NOT NULL AND ok IS NOT NULL")
    near = F.floor(F.col("c") * bins)  # rounding may put a value beside its bin, so the edges decide
    near = F.when(F.col("c") < near / bins, near - 1).when(F.col("c") >= (near + 1) / bins, near + 1).otherwise(near)
    placed = placed.withColumn("bin", F.when(inside, F.least(near, F.lit(bins - 1)).cast("int")))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_confidence"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
    total = counts.agg(F.sum("n").alias("total"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("low"), ((F.col("id") + 1) / bins).alias("high"))
    return grid.join(counts, "bin", "left").join(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    table = reliability_bins(rows, confidence, correct, bins)
    return table.agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("ece"), F.max("total").alias("n"))


def selective(rows: DataFrame, by: list[str], pred: str = "pred", truth: str = "is_malicious") -> DataFrame:
    """Coverage, and accuracy among committed rows."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(pred).alias("committed"),
        F.avg(F.col(pred).isNotNull().cast("double")).alias("coverage"),
        F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("selective_accuracy"),
    )


def risk_coverage(rows: DataFrame, position: str, pred: str = "pred", truth: str = "is_malicious", confidence: str = "confidence") -> DataFrame:
    """(k, coverage, risk) in order of falling confidence; ties by ``position``.

    Rows of one confidence are numbered within blocks of their position, which
    are shifted by prefix sums over blocks, so no task sorts the whole table.
    ``position`` is a number.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    kept = rows.filter(F.col(pred).isNotNull() & F.col(confidence).isNotNull()).select(
        F.col(confidence).alias("c"), F.floor(F.col(position) / 10_000).alias("block"), F.col(position).alias("at"), (F.col(pred) == F.col(truth)).cast("long").alias("ok")
    )
    inside = Window.partitionBy("c", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = kept.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("s"))
    shifts = before(blocks, [], "c", ["n", "s"], ["block"]).select("c", "block", F.col("n_before").alias("n0"), F.col("s_before").alias("s0"))
    run = kept.select("c", "block", F.row_number().over(inside).alias("k"), F.sum("ok").over(inside).alias("s")).join(shifts, ["c", "block"])
    k, s = F.col("k") + F.col("n0"), F.col("s") + F.col("s0")
    return run.join(F.broadcast(total)).select(k.cast("long").alias("k"), (k / F.col("total")).alias("coverage"), (1 - s / k).alias("risk"))


def area_under_risk(curve: DataFrame) -> DataFrame:
    """Trapezoid area of a risk-coverage curve, with a point at coverage 0 and the first risk.

    Coverage grows by one row's share at each step, so the trapezoids add up to
    the sum of risks with half of the first and without half of the last.
    """
    sums = curve.agg(F.sum("risk").alias("s"), F.min_by("risk", "k").alias("first"), F.max_by("risk", "k").alias("last"), F.min("coverage").alias("step"))
    return sums.select(((F.col("s") + (F.col("first") - F.col("last")) / 2) * F.col("step")).alias("aurc"))


def verdict_truth_table(verdicts: DataFrame) -> DataFrame:
    """Counts by verdict and truth."""
    return verdicts.groupBy("verdict").agg(F.count_if(F.col("is_malicious")).alias("malicious"), F.count_if(~F.col("is_malicious")).alias("benign"))


def macro_weighted(rows: DataFrame, by: list[str], truth: str = "is_malicious", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 of both classes, averaged plainly and by support."""
    counts = rows.filter(F.col(pred).isNotNull()).groupBy(*by).agg(*confusion(F.col(truth), F.col(pred)))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one, two = measures(tp, fp, fn, tn), measures(tn, fn, fp, tp)
    share = ratio(tp + fn, tp + fp + fn + tn)
    out = []
    for name in ("precision", "recall", "f1"):
        out += [((one[name] + two[name]) / 2).alias(f"macro_{name}"), (one[name] * share + two[name] * (1 - share)).alias(f"weighted_{name}")]
    return counts.select(*by, *out)


def parse_failures(predictions: DataFrame) -> DataFrame:
    """How many verdicts could not be parsed, with the interval of their share."""
    counts = predictions.agg(F.count(F.lit(1)).alias("n"), F.count_if("parse_failed").alias("failed"))
    w = wilson(F.col("failed"), F.col("n"))
    return counts.select("n", "failed", w["point"].alias("rate"), w["low"].alias("low"), w["high"].alias("high"))


def determinism(repeats: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """Share of records whose repeats agree in every field, with its interval."""
    whole = F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")).alias(f) for f in fields]))
    per = repeats.groupBy(id_col).agg(F.count_distinct(whole).alias("kinds"), F.count(F.lit(1)).alias("times"))
    counts = per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kinds") == 1).alias("agreeing"), F.min("times").alias("times"))
    w = wilson(F.col("agreeing"), F.col("n"))
    enough = F.when(F.col("times") < 2, F.raise_error(F.lit("at least two repeats are needed")))
    return counts.select("n", "agreeing", F.coalesce(enough.cast("double"), w["point"]).alias("rate"), w["low"].alias("low"), w["high"].alias("high"))
