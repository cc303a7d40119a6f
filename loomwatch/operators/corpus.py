"""Assembling a labelled corpus: label rules, composition, class ratio, train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.functions.constants import UNRESOLVED
from loomwatch.functions.expressions import features, pseudonym
from loomwatch.operators.leakage import neutralize_times, restrict_to_shared_support
from loomwatch.operators.sampling import stratified_sample, uniform_sample
from loomwatch.sources.shared import written


def label_violations(rows: DataFrame) -> DataFrame:
    """Rows that break a label rule, with the names of the rules."""
    t, bad = F.col("attack_technique"), F.col("is_malicious")
    rules = {
        "malicious_without_technique": bad & t.isNull(),
        "benign_with_technique": ~bad & t.isNotNull(),
        "unresolved_without_sentinel": F.col("technique_unresolved") & ~t.eqNullSafe(F.lit(UNRESOLVED)),
        "sentinel_not_unresolved": t.eqNullSafe(F.lit(UNRESOLVED)) & ~F.col("technique_unresolved"),
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.withColumn("violations", names).filter(F.size("violations") > 0)


def require_labels(rows: DataFrame) -> DataFrame:
    """The rows, with an error at the first one that breaks a label rule."""
    t = F.col("attack_technique")
    good = (F.col("is_malicious") == t.isNotNull()) & (F.col("technique_unresolved") == t.eqNullSafe(F.lit(UNRESOLVED)))
    return rows.filter(F.when(good, True).otherwise(F.raise_error(F.lit("inconsistent labels")).cast("boolean")))


def composition(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("is_malicious"), "malicious").otherwise("benign")
    return rows.groupBy(F.concat_ws(":", "source_dataset", label).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def _class_counts(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.count_if("is_malicious").alias("m"), F.count_if(~F.col("is_malicious")).alias("b")).first()
    if not r["m"] or not r["b"]:
        raise ValueError("both classes need rows")
    return r["m"], r["b"]


def assemble_corpus(rows: DataFrame, ratio: float = 4.0, seed: int = 20260818, mitigate: bool = True, event: str = "event_code") -> DataFrame:
    """A corpus with ``ratio`` benign rows for each malicious one, without collection artefacts.

    Enough benign rows: a uniform sample of them; too few: a sample of the
    malicious rows, stratified by event. Two counts come to the driver.
    """
    _class_counts(rows)
    if mitigate:
        rows = written(restrict_to_shared_support(rows, seed=seed, event=event), "shared-support")
    m, b = _class_counts(rows)
    if mitigate:
        rows = neutralize_times(rows.withColumn("__c", F.concat_ws(":", "is_malicious", "source_capture_id")), "__c").drop("__c")
    malicious, benign = rows.filter("is_malicious"), rows.filter(~F.col("is_malicious"))
    want = round(m * ratio)
    if want <= b:
        benign = uniform_sample(benign, want, b, seed)
    else:
        fewer = round(b / ratio)
        if fewer < 1:
            raise ValueError("too few benign rows for this ratio")
        malicious = stratified_sample(malicious, fewer, event, seed)
    out = malicious.unionByName(benign).withColumn("source_host", pseudonym(F.col("source_host")))
    if "fields" in rows.columns:
        out = out.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(k == "Hostname", pseudonym(v)).otherwise(v)))
    return out


def leakage_safe_split(rows: DataFrame, held: DataFrame, capture: str = "source_capture_id") -> tuple[DataFrame, str]:
    """Rows to fit on, disjoint from the held-out ones, and how the benign side was separated.

    Captures of held-out rows are left out on each side; if that leaves no
    benign row, held-out ids are left out there instead.
    """
    used = held.select("is_malicious", capture).distinct()
    by_capture = rows.join(used, [capture, "is_malicious"], "left_anti")
    left = by_capture.agg(F.count_if("is_malicious").alias("m"), F.count_if(~F.col("is_malicious")).alias("b")).first()
    strategy = "capture"
    benign = by_capture.filter(~F.col("is_malicious"))
    if not left["b"]:
        strategy = "id"
        benign = rows.filter(~F.col("is_malicious")).join(held.select("id"), "id", "left_anti")
    if not left["m"] or (not left["b"] and benign.isEmpty()):
        raise ValueError("nothing left to fit on")
    fit = by_capture.filter("is_malicious").unionByName(benign)
    return fit, strategy


def split_disclosure(rows: DataFrame, fit: DataFrame, held: DataFrame, strategy: str) -> DataFrame:
    """One row that says how a split was made: sizes by class, how each side was separated, repeated vectors in the fit."""
    both = fit.select("is_malicious", F.lit("fit").alias("side")).unionByName(held.select("is_malicious", F.lit("held").alias("side")))
    counts = both.agg(*[F.count_if((F.col("side") == s) & (F.col("is_malicious") == m)).alias(f"{s}_{n}") for s in ("fit", "held") for m, n in ((True, "malicious"), (False, "benign"))])
    return counts.crossJoin(duplication(fit).select(F.col("distinct").alias("fit_vectors"), F.col("rate").alias("fit_repeated"))).withColumns({"malicious_by": F.lit("capture"), "benign_by": F.lit(strategy)})  # one row each


def overlap(fit: DataFrame, held: DataFrame, capture: str = "source_capture_id") -> DataFrame:
    """What fit and held-out rows share: ids, and captures of each class. All are 0 for a split by capture."""
    ids = fit.select("id").join(held.select("id"), "id", "left_semi").agg(F.count_distinct("id").alias("ids"))
    shared = fit.select("is_malicious", capture).join(held.select("is_malicious", capture), ["is_malicious", capture], "left_semi").distinct()
    captures = shared.agg(F.count_if("is_malicious").alias("malicious_captures"), F.count_if(~F.col("is_malicious")).alias("benign_captures"))
    return ids.crossJoin(captures)  # one row each


def duplication(rows: DataFrame) -> DataFrame:
    """Share of rows whose feature vector repeats another's, and how many vectors there are."""
    vectors = rows.select(F.to_json(features(F.col("fields"), F.col("event_type"))).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    sums = vectors.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), "distinct", (1 - F.try_divide("distinct", "n")).alias("rate"))


def vector_sketch(rows: DataFrame, by: list[str] | None = None, precision: int = 14) -> DataFrame:
    """(n, sketch): how many rows, and a sketch of their distinct feature vectors, for ``merged_duplication``.

    The sketch has ``2 ** precision`` registers whatever the rows are, so batches
    can be sketched as they come and kept; its standard error is about 0.8 % at 14.
    """
    vector = F.to_json(features(F.col("fields"), F.col("event_type")))
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.xxhash64(vector), F.lit(precision)).alias("sketch"))


def merged_duplication(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``duplication`` from sketches of parts: n, an estimate of the distinct vectors, and the share that repeats."""
    merged = parts.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return merged.withColumn("rate", F.greatest(1 - F.try_divide("distinct", "n"), F.lit(0.0)))
