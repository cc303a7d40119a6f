"""Scorers with one interface: a DataFrame of records in, the same rows with ``pred`` and ``score`` out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions.constants import EVENT_TYPES, OTHER_MEANING, POLICIES
from loomwatch.functions.expressions import estimate_tokens, features, matches_command, names_binary, text_blob, uniform
from loomwatch.sources.shared import written


def majority(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"pred": F.lit(False), "score": F.lit(0.0)})


def stratified_random(rows: DataFrame, rate: float, seed: int = 20260818, id_col: str = "id") -> DataFrame:
    """Malicious where a hash-uniform number, which is also the score, is below ``rate``."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must be from 0 to 1")
    score = uniform(F.col(id_col), str(seed))
    return rows.withColumns({"score": score, "pred": score < rate})


def rules(rows: DataFrame) -> DataFrame:
    """Share of three rules that hit: binary with a pattern, pattern, process access."""
    blob = text_blob(F.col("fields"))
    pattern = matches_command(blob)
    hits = (names_binary(blob) & pattern).cast("int") + pattern.cast("int") + F.coalesce(F.col("fields")["EventID"] == "10", F.lit(False)).cast("int")
    return rows.withColumn("__hits", hits).withColumns({"score": F.col("__hits") / 3.0, "pred": F.col("__hits") > 0}).drop("__hits")


def classical(fit: DataFrame, rows: DataFrame, max_iter: int = 100) -> DataFrame:
    """Logistic regression over the engineered features, with balanced class weights.

    Rows to fit on that have the same class and features are one row whose
    weight is their number, which is written once: the fit reads the table once
    and each of its steps is as long as there are distinct vectors. Features are
    divided by the standard deviation over all rows and not centred, so vectors
    stay sparse; the intercept, which is not penalised, makes up for the means.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import Summarizer

    numbers = ["field_count", "command_line_length", "has_binary_name", "has_pattern", "has_parent_command_line", "has_target_object"]
    parts = ["__t", "__e", *[f"__{x}" for x in numbers]]

    def vector(df: DataFrame) -> DataFrame:
        f = features(F.col("fields"), F.col("event_type"))
        return df.withColumn("__f", f).withColumns({"__t": F.col("__f.event_type"), "__e": F.col("__f.event_id"), **{f"__{n}": F.col(f"__f.{n}").cast("double") for n in numbers}})

    alike = written(vector(fit).groupBy("is_malicious", *parts).agg(F.count(F.lit(1)).alias("__n")), "fit-vectors")
    size = F.col("__n").cast("double")
    counts = alike.agg(F.sum(F.when(F.col("is_malicious"), F.col("__n"))).alias("m"), F.sum(F.when(~F.col("is_malicious"), F.col("__n"))).alias("b"), F.sum(size * size).alias("squares")).first()
    if not counts["m"] or not counts["b"]:
        raise ValueError("both classes are needed to fit")
    n = counts["m"] + counts["b"]
    weight = F.when(F.col("is_malicious"), n / (2 * counts["m"])).otherwise(n / (2 * counts["b"]))
    learn = alike.withColumns({"__label": F.col("is_malicious").cast("double"), "__weight": weight * size})
    stages = [
        StringIndexer(inputCols=["__t", "__e"], outputCols=["__ti", "__ei"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["__ti", "__ei"], outputCols=["__tv", "__ev"], dropLast=False),
        VectorAssembler(inputCols=["__tv", "__ev", *[f"__{x}" for x in numbers]], outputCol="__raw"),
    ]
    encoder = Pipeline(stages=stages).fit(learn)
    spread = encoder.transform(learn).agg(Summarizer.variance(F.col("__raw"), size)).first()[0].toArray()
    # The summary takes weights for reliabilities; these are numbers of rows.
    spread = (spread * (n - counts["squares"] / n) / max(n - 1, 1)) ** 0.5
    scale = ElementwiseProduct(scalingVec=Vectors.dense([1 / s if s else 0.0 for s in spread]), inputCol="__raw", outputCol="__x")
    regression = LogisticRegression(featuresCol="__x", labelCol="__label", weightCol="__weight", maxIter=max_iter, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, predictionCol="__p", probabilityCol="__prob", rawPredictionCol="__rawp")
    model = regression.fit(scale.transform(encoder.transform(learn)))
    scored = PipelineModel([encoder, scale, model]).transform(vector(rows))
    score = vector_to_array("__prob")[1]
    return scored.select(*rows.columns, score.alias("score"), (score >= 0.5).alias("pred"))


def prompts(rows: DataFrame) -> DataFrame:
    """A prompt column from fields, event type and host alone, with its token estimate.

    Fields are in order of their names; empty ones are left out, and values of
    more than 500 characters are cut with a note of their length.
    """
    meanings = rows.sparkSession.createDataFrame(EVENT_TYPES, "__channel string, __event int, __type string, __meaning string").drop("__type")
    shown = F.transform_values(F.map_filter("fields", lambda k, v: v.isNotNull() & (v != "")), lambda k, v: F.when(F.length(v) > 500, F.concat(F.substring(v, 1, 500), F.lit("... [truncated, "), F.length(v).cast("string"), F.lit(" chars total]"))).otherwise(v))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    channel, event = F.lower(F.coalesce(F.col("fields")["Channel"], F.lit(""))), F.col("fields")["EventID"].try_cast("int")
    joined = rows.join(F.broadcast(meanings), (channel == F.col("__channel")) & (event == F.col("__event")), "left")  # 24 rows
    text = F.concat(
        F.lit("Judge one telemetry event: benign, suspicious or malicious.\nHost: "), F.col("source_host"),
        F.lit("\nType: "), F.col("event_type"), F.lit("\nMeaning: "), F.coalesce("__meaning", F.lit(OTHER_MEANING)), F.lit("\nFields:\n"), lines,
    )
    return joined.withColumn("prompt", text).withColumn("tokens", estimate_tokens(F.col("prompt"))).select(*rows.columns, "prompt", "tokens")


VERDICT_SCHEMA = "struct<verdict:string,confidence:double,attack_technique:string,reasoning:string,key_indicators:array<string>>"


def parse_verdicts(rows: DataFrame, response: str = "response") -> DataFrame:
    """Parsed verdict columns, parse_failed, and fail_kind: 'grammar' or 'semantic'."""
    parsed = rows.withColumn("__v", F.from_json(response, VERDICT_SCHEMA))
    v, c, t = F.col("__v.verdict"), F.col("__v.confidence"), F.col("__v.attack_technique")
    grammar = F.col("__v").isNotNull() & v.isNotNull() & c.isNotNull() & F.col("__v.reasoning").isNotNull()
    semantic = v.isin("benign", "suspicious", "malicious") & c.between(0.0, 1.0) & (t.isNull() | t.rlike(r"^T\d{4}(\.\d{3})?$")) & ~((v == "benign") & t.isNotNull())
    good = F.coalesce(grammar & semantic, F.lit(False))
    kept = {n: F.when(good, F.col(f"__v.{n}")) for n in ("verdict", "confidence", "attack_technique", "reasoning", "key_indicators")}
    kind = F.when(good, None).when(F.coalesce(grammar, F.lit(False)), "semantic").otherwise("grammar")
    return parsed.withColumns({**kept, "parse_failed": ~good, "fail_kind": kind}).drop("__v")


def _asked(call: Callable[[list[str]], list[str | None]], prompts: list[str], attempts: int, backoff: float) -> tuple[list[str | None], str | None]:
    """Responses of one call and the error of its last attempt, if all failed; waits double between attempts."""
    said = None
    for k in range(attempts):
        if k:
            time.sleep(backoff * 2 ** (k - 1))
        try:
            out = list(call(prompts))
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} responses to {len(prompts)} prompts")
            return out, None
        except Exception as e:  # a call may fail in any way; the row says how
            said = f"{type(e).__name__}: {e}"
    return [None] * len(prompts), said


def score_batch(rows: DataFrame, call: Callable[[list[str]], list[str | None]], id_col: str = "id", concurrency: int | None = None, stop_on_error: bool = False, in_flight: int = 1, per_call: int = 64, attempts: int = 3, backoff: float = 0.5) -> DataFrame:
    """Verdicts from a function of prompts to responses; a failure is a null response.

    ``concurrency`` is how many tasks may call at once, ``in_flight`` how many
    calls of ``per_call`` prompts each of them has open. A call that raises is
    tried ``attempts`` times with growing pauses; then its rows have a null
    response and the error in ``call_error``, so one bad call costs its own
    rows only. With ``stop_on_error`` a failure or an unreadable verdict ends
    the job.
    """
    asked = prompts(rows).select(id_col, "prompt")
    if concurrency:
        asked = asked.repartition(concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                texts = batch["prompt"].tolist()
                parts = [texts[k : k + per_call] for k in range(0, len(texts), per_call)]
                responses, errors = [], []
                for got, error in pool.map(lambda p: _asked(call, p, attempts, backoff), parts):
                    responses += got
                    errors += [error] * len(got)
                yield pd.DataFrame({id_col: batch[id_col], "response": pd.Series(responses, dtype=object, index=batch.index), "call_error": pd.Series(errors, dtype=object, index=batch.index)})

    kind = dict(asked.dtypes)[id_col]
    parsed = parse_verdicts(asked.mapInPandas(run, f"{id_col} {kind}, response string, call_error string"))
    if stop_on_error:
        good = F.when(~F.col("parse_failed"), True).otherwise(F.raise_error(F.concat(F.lit("no verdict for "), F.col(id_col).cast("string"), F.coalesce(F.concat(F.lit(": "), "call_error"), F.lit("")))).cast("boolean"))
        parsed = parsed.filter(good)
    return parsed


def as_predictions(rows: DataFrame, system: str) -> DataFrame:
    """The long predictions schema: a baseline decides alike under every policy and has no confidence."""
    decided = {f"pred_{p}": F.col("pred") for p in POLICIES}
    return rows.withColumns({**decided, "system": F.lit(system), "confidence": F.lit(None).cast("double"), "parse_failed": F.lit(False)}).drop("pred")
