"""Registered queries over the driver's tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions import constants as C
from loomwatch.functions import expressions as X
from loomwatch.functions.measures import wilson_or_null
from loomwatch.operators import audit, corpus, evaluation, leakage, ordering, sampling, scorers, significance
from loomwatch.plans import experiments, views
from loomwatch.sources import event_lines, ingest, shared
from loomwatch.streaming import incremental, numbering, verdict_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEED = 20260818
RATE = 0.2


def _quote(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


_KV = " UNION ALL ".join(f"SELECT id, is_malicious, event_code, '{k}' AS key, \"f_{k}\" AS val FROM alerts WHERE \"f_{k}\" IS NOT NULL" for k in views.KEYS)
_TYPES = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {e}, '{t}', '{m}')" for c, e, t, m in C.EVENT_TYPES) + ") AS t (channel, code, event_type, meaning)"
_CANON = r"""
    CASE WHEN regexp_matches(trim(val), '^[+-]?[0-9]{1,38}$') THEN
            CASE WHEN CAST(trim(val) AS HUGEINT) < 0 AND CAST(trim(val) AS HUGEINT) >= -9223372036854775808 THEN CAST(CAST(trim(val) AS HUGEINT) + 18446744073709551616 AS VARCHAR)
                 ELSE CAST(CAST(trim(val) AS HUGEINT) AS VARCHAR) END
         WHEN regexp_matches(trim(val), '^0[xX][0-9a-fA-F]{1,16}$') THEN CAST(CAST(lower(trim(val)) AS UBIGINT) AS VARCHAR)
         ELSE trim(val) END"""
_ALERTS = f"WITH alerts AS MATERIALIZED ({views.alerts_sql(False)})"
_WITH_KV = f"{_ALERTS}, kv AS MATERIALIZED ({_KV})"
_VERDICTS = f"""{_ALERTS}, v AS ({views.verdicts_sql(False)}),
    preds AS (SELECT a.*, v.verdict, v.confidence, v.verdict IS NULL AS parse_failed,
        CASE v.verdict WHEN 'malicious' THEN true WHEN 'benign' THEN false WHEN 'suspicious' THEN true END AS pred_conservative,
        CASE v.verdict WHEN 'malicious' THEN true WHEN 'benign' THEN false WHEN 'suspicious' THEN false END AS pred_high_precision,
        CASE v.verdict WHEN 'malicious' THEN true WHEN 'benign' THEN false END AS pred_abstention,
        coalesce((CASE v.verdict WHEN 'benign' THEN 0.0::DOUBLE WHEN 'suspicious' THEN 1.0 WHEN 'malicious' THEN 2.0 END + v.confidence) / 3.0, 0.0) AS score
        FROM alerts a JOIN v ON v.id = a.id AND v.repeat = 0),
    long AS (SELECT *, 'conservative' AS policy, pred_conservative AS pred FROM preds
        UNION ALL SELECT *, 'high_precision', pred_high_precision FROM preds UNION ALL SELECT *, 'abstention', pred_abstention FROM preds)"""
_COUNTS = """count(*) FILTER (is_malicious AND pred) AS tp, count(*) FILTER (NOT is_malicious AND pred) AS fp,
    count(*) FILTER (is_malicious AND NOT pred) AS fn, count(*) FILTER (NOT is_malicious AND NOT pred) AS tn"""
_MEASURES = """round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1,
    round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr, round(tn / nullif(tn + fp, 0), 6) AS specificity,
    round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
    round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc"""
_MEASURE_NAMES = ["precision", "recall", "f1", "fpr", "fnr", "specificity", "accuracy", "balanced_accuracy", "mcc"]


def _wilson_sql(s: str, n: str, name: str) -> str:
    z = 1.959963984540054
    p, d = f"({s})::DOUBLE / ({n})", f"(1 + {z * z} / ({n}))"
    spread = f"{z} * sqrt({p} * (1 - {p}) / ({n}) + {z * z} / (4.0 * ({n}) * ({n})))"
    low = f"greatest(0.0, ({p} + {z * z} / (2.0 * ({n})) - {spread}) / {d})"
    high = f"least(1.0, ({p} + {z * z} / (2.0 * ({n})) + {spread}) / {d})"
    return f"CASE WHEN ({n}) > 0 THEN round({low}, 6) END AS {name}_low, CASE WHEN ({n}) > 0 THEN round({high}, 6) END AS {name}_high"


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.predictions_of_verdicts(views.alerts(spark, sf), views.verdicts(spark, sf))


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.by_policy(_predictions(spark, sf))


# --- records ---------------------------------------------------------------

_TAMPERED = """CASE WHEN k = 5 AND is_malicious THEN NULL WHEN k = 6 AND NOT is_malicious THEN 'T1000' WHEN k = 26 AND is_malicious THEN 'T1001' ELSE attack_technique END"""


@_query(
    "label_violations",
    f"""{_ALERTS}, t AS (SELECT is_malicious AS bad, technique_unresolved AS un, {_TAMPERED} AS t FROM alerts)
    SELECT 'malicious_without_technique' AS rule, count(*) AS n FROM t WHERE bad AND t IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'benign_with_technique', count(*) FROM t WHERE NOT bad AND t IS NOT NULL HAVING count(*) > 0
    UNION ALL SELECT 'unresolved_without_sentinel', count(*) FROM t WHERE un AND t IS DISTINCT FROM '{C.UNRESOLVED}' HAVING count(*) > 0
    UNION ALL SELECT 'sentinel_not_unresolved', count(*) FROM t WHERE NOT un AND t = '{C.UNRESOLVED}' HAVING count(*) > 0""",
)
def label_violations(spark, sf):
    rows = views.alerts(spark, sf).withColumn("attack_technique", F.expr(_TAMPERED))
    return corpus.label_violations(rows).select(F.explode("violations").alias("rule")).groupBy("rule").count().withColumnRenamed("count", "n")


_EVENT = "CASE WHEN k % 5 = 0 THEN 'abc' WHEN user_id % 3 = 1 THEN CAST(4600 + k AS STRING) ELSE CAST(k % 25 AS STRING) END"


@_query(
    "event_type_classify",
    f"""{_ALERTS}, types AS ({_TYPES})
    SELECT coalesce(t.event_type, 'other') AS event_type, count(*) AS n FROM (SELECT "f_Channel" AS channel, {_EVENT} AS code FROM alerts) a
    LEFT JOIN types t ON lower(a.channel) = t.channel AND TRY_CAST(a.code AS INTEGER) = t.code GROUP BY 1""",
)
def event_type_classify(spark, sf):
    rows = views.alerts(spark, sf).withColumn("code", F.expr(_EVENT)).drop("event_type")
    return ingest.classify_events(rows, F.col("fields")["Channel"], F.col("code")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "channel_semi_filter",
    f"""{_ALERTS}, types AS ({_TYPES})
    SELECT a.channel, a.code, count(*) AS n FROM (SELECT "f_Channel" AS channel, {_EVENT} AS code FROM alerts) a
    SEMI JOIN types t ON lower(a.channel) = t.channel AND TRY_CAST(a.code AS INTEGER) = t.code GROUP BY 1, 2""",
)
def channel_semi_filter(spark, sf):
    rows = views.alerts(spark, sf).select(F.col("fields")["Channel"].alias("channel"), F.expr(_EVENT).alias("code"))
    return ingest.keep_known_events(rows, F.col("channel"), F.col("code")).groupBy("channel", "code").agg(F.count(F.lit(1)).alias("n"))


@_query("host_pseudonym", f"{_ALERTS} SELECT 'host-' || substr(sha256(lower(split_part(source_host, '.', 1))), 1, 12) AS host, count(*) AS n FROM alerts GROUP BY 1")
def host_pseudonym(spark, sf):
    return views.alerts(spark, sf).groupBy(X.pseudonym(F.col("source_host")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@_query("canonical_value", f"{_WITH_KV} SELECT key, {_CANON} AS value, count(*) AS n FROM kv GROUP BY 1, 2")
def canonical_value(spark, sf):
    pairs = views.alerts(spark, sf).select(F.explode("fields").alias("key", "v"))
    return pairs.groupBy("key", X.canonical(F.col("v")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "ts_neutralize",
    f"""{_ALERTS} SELECT id, source_capture_id, CAST(TIMESTAMP '2000-01-01' + (ts - min(ts) OVER (PARTITION BY source_capture_id)) AS VARCHAR)[1:19] AS moved FROM alerts""",
)
def ts_neutralize(spark, sf):
    rows = leakage.neutralize_times(views.alerts(spark, sf).drop("fields"))
    return rows.select("id", "source_capture_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moved"))


@_query(
    "ts_string_rebase",
    f"""{_ALERTS}, s AS (SELECT *, min(ts) OVER (PARTITION BY source_capture_id) AS start FROM alerts)
    SELECT id, strftime(CAST("f_UtcTime" AS TIMESTAMP) + (TIMESTAMP '2000-01-01' - start), '%Y-%m-%d %H:%M:%S.%f') AS utc_time FROM s""",
)
def ts_string_rebase(spark, sf):
    return leakage.neutralize_times(views.alerts(spark, sf)).select("id", F.col("fields")["UtcTime"].alias("utc_time"))


@_query(
    "context_bucket",
    f"""{_WITH_KV}, rich AS (SELECT DISTINCT id FROM kv WHERE key IN ({_quote(C.ACTOR_FIELDS + C.OBJECT_FIELDS)}) AND trim(val) NOT IN ({_quote(C.EMPTY_VALUES)}))
    SELECT CASE WHEN r.id IS NULL THEN 'context_poor' ELSE 'context_rich' END AS bucket, is_malicious, count(*) AS n FROM alerts a LEFT JOIN rich r ON r.id = a.id GROUP BY 1, 2""",
)
def context_bucket(spark, sf):
    return views.alerts(spark, sf).groupBy(X.context_bucket(F.col("fields")).alias("bucket"), "is_malicious").agg(F.count(F.lit(1)).alias("n"))


@_query("eventid_membership", f"{_ALERTS} SELECT event_code, count(*) AS n FROM alerts GROUP BY 1")
def eventid_membership(spark, sf):
    return views.alerts(spark, sf).groupBy("event_code").agg(F.count(F.lit(1)).alias("n"))


@_query("composition", f"{_ALERTS} SELECT source_dataset || ':' || CASE WHEN is_malicious THEN 'malicious' ELSE 'benign' END AS part, count(*) AS n FROM alerts GROUP BY 1")
def composition(spark, sf):
    return corpus.composition(views.alerts(spark, sf))


@_query(
    "duplication_stats",
    f"""{_ALERTS} SELECT count(*) AS n, count(DISTINCT (event_type, event_code, "f_Channel" IS NULL, "f_CommandLine" IS NULL, coalesce("f_CommandLine", ''), "f_ParentCommandLine", "f_User" IS NULL,
        "f_TargetObject", "f_DestinationIp" IS NULL)) AS ignored FROM alerts""".replace(", count(DISTINCT", ", approx_count_distinct("),
)
def duplication_stats(spark, sf):
    return corpus.duplication(views.alerts(spark, sf))


# --- event files -----------------------------------------------------------

_CHANNEL = "CASE user_id % 3 WHEN 0 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN 1 THEN 'Security' ELSE 'Application' END"
_MOMENT = "concat('2019-03-', lpad(CAST(1 + k % 28 AS STRING), 2, '0'), ' 10:00:', lpad(CAST(k % 60 AS STRING), 2, '0'))"
_RAW = f"""concat('{{"EventID":', CAST(event_code AS STRING), ',"Channel":"', {_CHANNEL}, '","Hostname":"', source_host, '","EventTime":"', {_MOMENT}, '","RecordNumber":', CAST(event_id AS STRING), '}}')"""
_COMPOUND = ["cap-5", "cap-6"]
_MAPPING = """array(named_struct('technique', concat('T101', substr(id, 5)), 'sub-technique', '001', 'tactics', array('TA0002'))) AS attack_mappings,
    array(named_struct('type', 'Host', 'link', concat('https://example.org/x/', id, '.json'))) AS files"""


@_query(
    "normalise_records",
    f"""{_ALERTS}, types AS ({_TYPES}),
    e AS (SELECT event_id, event_code, source_host, is_malicious, source_capture_id AS file, {_RAW} AS raw_json, {_CHANNEL} AS channel, {_MOMENT} AS moment,
        CASE WHEN NOT is_malicious THEN 'benign' WHEN source_capture_id IN ({_quote(_COMPOUND)}) THEN 'compound' ELSE 'single' END AS source_dataset FROM alerts),
    c AS (SELECT e.*, t.event_type, CASE source_dataset WHEN 'single' THEN file ELSE source_dataset END AS source_capture_id
        FROM e LEFT JOIN types t ON t.channel = lower(e.channel) AND t.code = e.event_code WHERE is_malicious OR t.code IS NOT NULL),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_dataset, source_capture_id ORDER BY file, event_id) - 1 AS VARCHAR) AS i FROM c)
    SELECT concat_ws(':', source_dataset, source_capture_id, i, substr(sha256(concat_ws(':', source_capture_id, i, raw_json)), 1, 16)) AS id, moment, source_host, coalesce(event_type, 'other') AS event_type,
        source_dataset, source_capture_id, is_malicious, CASE source_dataset WHEN 'single' THEN 'T101' || substr(source_capture_id, 5) WHEN 'compound' THEN '{C.UNRESOLVED}' END AS attack_technique,
        source_dataset = 'compound' AS technique_unresolved, CAST(event_id AS VARCHAR) AS record_number FROM n""",
)
def normalise_records(spark, sf):
    rows = views.alerts(spark, sf).withColumn("raw_json", F.expr(_RAW))
    raw = F.from_json("raw_json", "map<string,variant>", {"mode": "FAILFAST"})
    lines = [F.concat(F.lit("events/"), "source_capture_id", F.lit(".json")).alias("file"), F.floor(F.col("event_id") / 10_000).alias("block"), F.col("event_id").alias("line"), "raw_json", raw.alias("raw")]
    compound = F.col("source_capture_id").isin(_COMPOUND)
    metadata = rows.filter(F.col("is_malicious") & ~compound).select(F.col("source_capture_id").alias("id")).distinct().selectExpr("id", *_MAPPING.split(",\n"))
    events = rows.filter("is_malicious").select(*lines)
    parts = [
        ingest.normalise_single(events, metadata, "single"),
        ingest.normalise_compound(rows.filter(F.col("is_malicious") & compound).select(*lines), "compound", "compound"),
        ingest.normalise_benign(rows.filter(~F.col("is_malicious")).select(*lines), "benign", "benign"),
    ]
    kept = ["source_host", "event_type", "source_dataset", "source_capture_id", "is_malicious", "attack_technique", "technique_unresolved"]
    return ingest.load_corpus(*parts).select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("moment"), *kept, F.col("fields")["RecordNumber"].alias("record_number"))


# --- leakage ---------------------------------------------------------------

_SHARED = "events2 AS (SELECT event_code FROM alerts GROUP BY 1 HAVING bool_or(is_malicious) AND bool_or(NOT is_malicious))"
_SIDES = "sides AS (SELECT event_code, key, bool_or(is_malicious) AS m, bool_or(NOT is_malicious) AS b FROM kv GROUP BY 1, 2)"


@_query("shared_event_ids", f"{_ALERTS}, {_SHARED} SELECT event_code FROM events2")
def shared_event_ids(spark, sf):
    return leakage.shared_events(views.alerts(spark, sf))


@_query("shared_keys_by_event", f"{_WITH_KV}, {_SIDES} SELECT event_code, key FROM sides WHERE m AND b AND key NOT IN ({_quote(C.UNMAPPABLE_KEYS)})")
def shared_keys_by_event(spark, sf):
    return leakage.shared_keys(views.alerts(spark, sf))


@_query(
    "key_parity",
    f"{_WITH_KV}, {_SIDES} SELECT event_code, key, CASE WHEN m THEN 'malicious' ELSE 'benign' END AS side FROM sides WHERE m <> b AND key NOT IN ({_quote(C.COLLECTOR_KEYS + C.VERSION_KEYS)})",
)
def key_parity(spark, sf):
    return leakage.key_parity(views.alerts(spark, sf))


@_query(
    "key_parity_by_channel",
    f"""{_WITH_KV}, sides AS (SELECT a."f_Channel" AS channel, a.event_code AS event_code, kv.key AS key, bool_or(a.is_malicious) AS m, bool_or(NOT a.is_malicious) AS b FROM kv JOIN alerts a ON a.id = kv.id GROUP BY 1, 2, 3)
    SELECT channel, event_code, key, CASE WHEN m THEN 'malicious' ELSE 'benign' END AS side FROM sides WHERE m <> b AND key NOT IN ({_quote(C.COLLECTOR_KEYS + C.VERSION_KEYS)})""",
)
def key_parity_by_channel(spark, sf):
    return leakage.key_parity(views.alerts(spark, sf).withColumn("channel", F.col("fields")["Channel"]), ["channel", "event_code"])


_QUOTAS = f"""{_SHARED}, caps AS (SELECT event_code, CAST(floor(least(count(*) FILTER (is_malicious), count(*) FILTER (NOT is_malicious)) * 1.5) AS BIGINT) AS cap FROM alerts GROUP BY 1),
    kept AS (SELECT a.*, row_number() OVER (PARTITION BY a.event_code, is_malicious ORDER BY md5(id || ':{SEED}'), id) AS r, cap
             FROM alerts a JOIN events2 USING (event_code) JOIN caps USING (event_code)),
    capped AS (SELECT * FROM kept WHERE r <= cap)"""


@_query("class_ratio_cap", f"{_ALERTS}, {_QUOTAS} SELECT event_code, is_malicious, count(*) AS n FROM capped GROUP BY 1, 2")
def class_ratio_cap(spark, sf):
    rows = leakage.restrict_to_shared_support(views.alerts(spark, sf), seed=SEED)
    return rows.groupBy("event_code", "is_malicious").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "shared_support",
    f"""{_WITH_KV}, {_QUOTAS}, {_SIDES}, keys AS (SELECT event_code, key FROM sides WHERE m AND b AND key NOT IN ({_quote(C.UNMAPPABLE_KEYS)}))
    SELECT c.id, k.key, {_CANON} AS value FROM capped c JOIN keys k USING (event_code) LEFT JOIN kv ON kv.id = c.id AND kv.key = k.key""",
)
def shared_support(spark, sf):
    rows = leakage.restrict_to_shared_support(views.alerts(spark, sf), seed=SEED)
    return rows.select("id", F.explode("fields").alias("key", "value"))


# --- sampling --------------------------------------------------------------


def _quota_sql(target: str, by: str = "") -> str:
    part, comma = (f"PARTITION BY {by} " if by else ""), (f"{by}, " if by else "")
    return f"""ranked AS (SELECT *, least(CAST({target} AS BIGINT), CAST(sum(n) OVER ({part}) AS BIGINT)) AS t, row_number() OVER ({part}ORDER BY n, event_code) AS j, count(*) OVER ({part}) AS k,
            CAST(sum(n) OVER ({part}ORDER BY n, event_code ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM sizes),
        whole AS (SELECT *, p + (k - j) * n <= t AS w FROM ranked),
        taken AS (SELECT *, count(*) FILTER (w) OVER ({part}) AS m, CAST(coalesce(sum(n) FILTER (w) OVER ({part}), 0) AS BIGINT) AS used FROM whole),
        quota AS (SELECT {comma}event_code, n, CASE WHEN w THEN n WHEN j <= m + (t - used) - ((t - used) // greatest(k - m, 1)) * greatest(k - m, 1) THEN (t - used) // greatest(k - m, 1) + 1
            ELSE (t - used) // greatest(k - m, 1) END AS quota FROM taken)"""


@_query("stratified_quota", f"{_ALERTS}, sizes AS (SELECT event_code, count(*) AS n FROM alerts WHERE is_malicious GROUP BY 1), {_quota_sql('1200')} SELECT event_code, n, quota FROM quota")
def stratified_quota(spark, sf):
    sizes = views.alerts(spark, sf).filter("is_malicious").groupBy("event_code").agg(F.count(F.lit(1)).alias("n"))
    return sampling.quotas(sizes, 1200, "event_code")


@_query(
    "stratified_sample",
    f"""{_ALERTS}, sizes AS (SELECT event_code, count(*) AS n FROM alerts WHERE is_malicious GROUP BY 1), {_quota_sql('1200')},
    r AS (SELECT id, event_code, row_number() OVER (PARTITION BY event_code ORDER BY md5(id || ':{SEED}'), id) AS r FROM alerts WHERE is_malicious)
    SELECT id, r.event_code FROM r JOIN quota USING (event_code) WHERE r <= quota""",
)
def stratified_sample(spark, sf):
    rows = views.alerts(spark, sf).filter("is_malicious")
    return sampling.stratified_sample(rows, 1200, "event_code", SEED).select("id", "event_code")


_EVAL = f"""{_ALERTS}, sizes AS (SELECT is_malicious, event_code, count(*) AS n FROM alerts GROUP BY 1, 2), {_quota_sql('CASE WHEN is_malicious THEN 385 ELSE 1540 END', 'is_malicious')},
    r AS (SELECT *, row_number() OVER (PARTITION BY is_malicious, event_code ORDER BY md5(id || ':{SEED}'), id) AS r FROM alerts),
    sample AS (SELECT r.* FROM r JOIN quota q ON q.event_code = r.event_code AND q.is_malicious = r.is_malicious WHERE r.r <= q.quota)"""


@_query("eval_sample", f"{_EVAL} SELECT id, is_malicious, event_code FROM sample")
def eval_sample(spark, sf):
    return sampling.eval_sample(views.alerts(spark, sf), "event_code").select("id", "is_malicious", "event_code")


@_query(
    "sample_report",
    f"""{_EVAL} SELECT CAST(385 AS BIGINT) AS target_malicious, CAST(1540 AS BIGINT) AS target_benign, count(*) FILTER (is_malicious) AS malicious, count(*) FILTER (NOT is_malicious) AS benign,
    least(count(*) FILTER (is_malicious), count(*) FILTER (NOT is_malicious)) >= 385 AS floor_met FROM sample""",
)
def sample_report(spark, sf):
    return sampling.sample_report(sampling.eval_sample(views.alerts(spark, sf), "event_code"))


@_query(
    "assemble_corpus_counts",
    f"""{_ALERTS}, {_QUOTAS}, c AS (SELECT count(*) FILTER (is_malicious) AS m, count(*) FILTER (NOT is_malicious) AS b FROM capped)
    SELECT CASE WHEN round_even(m * 4.0, 0) <= b THEN m ELSE least(m, CAST(round_even(b / 4.0, 0) AS BIGINT)) END AS malicious,
           CASE WHEN round_even(m * 4.0, 0) <= b THEN CAST(round_even(m * 4.0, 0) AS BIGINT) ELSE b END AS benign FROM c""",
)
def assemble_corpus_counts(spark, sf):
    rows = corpus.assemble_corpus(views.alerts(spark, sf), seed=SEED)
    return rows.agg(F.count_if("is_malicious").alias("malicious"), F.count_if(~F.col("is_malicious")).alias("benign"))


@_query(
    "leakage_safe_split",
    f"""{_EVAL}, held AS (SELECT * FROM sample WHERE NOT is_malicious OR source_capture_id IN ('cap-0', 'cap-1'))
    SELECT is_malicious, count(*) AS n FROM alerts a WHERE CASE WHEN is_malicious THEN source_capture_id NOT IN (SELECT source_capture_id FROM held WHERE is_malicious)
        ELSE id NOT IN (SELECT id FROM held) END GROUP BY 1""",
)
def leakage_safe_split(spark, sf):
    rows = views.alerts(spark, sf)
    held = shared.written(sampling.eval_sample(rows, "event_code", size=1925).filter(~F.col("is_malicious") | F.col("source_capture_id").isin("cap-0", "cap-1")), "sample")
    fit, _ = corpus.leakage_safe_split(rows, held)
    return fit.groupBy("is_malicious").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "split_overlap",
    f"""{_ALERTS}, held AS (SELECT * FROM alerts WHERE source_capture_id IN ('cap-0', 'cap-1') OR (NOT is_malicious AND user_id % 10 = 0)),
    fit AS (SELECT * FROM alerts WHERE CASE WHEN is_malicious THEN source_capture_id NOT IN ('cap-0', 'cap-1') ELSE id NOT IN (SELECT id FROM held) END)
    SELECT (SELECT count(*) FROM fit SEMI JOIN held USING (id)) AS ids, (SELECT count(DISTINCT source_capture_id) FROM fit SEMI JOIN held USING (source_capture_id, is_malicious) WHERE is_malicious) AS malicious_captures,
        (SELECT count(DISTINCT source_capture_id) FROM fit SEMI JOIN held USING (source_capture_id, is_malicious) WHERE NOT is_malicious) AS benign_captures""",
)
def split_overlap(spark, sf):
    rows = views.alerts(spark, sf).drop("fields")
    held = rows.filter(F.col("source_capture_id").isin("cap-0", "cap-1") | (~F.col("is_malicious") & (F.col("user_id") % 10 == 0)))
    return corpus.overlap(corpus.leakage_safe_split(rows, held)[0], held)


# --- verdicts and scorers --------------------------------------------------


@_query("collapse_policies", f"{_VERDICTS} SELECT policy, verdict, pred, count(*) AS n FROM long GROUP BY 1, 2, 3")
def collapse_policies(spark, sf):
    return _long(spark, sf).groupBy("policy", "verdict", "pred").agg(F.count(F.lit(1)).alias("n"))


@_query("verdict_score", f"{_VERDICTS} SELECT id, round(score, 6) AS score FROM preds")
def verdict_score(spark, sf):
    return _predictions(spark, sf).select("id", F.round("score", 6).alias("score"))


_RESPONSE = """CASE k % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '{"verdict":"benign","confidence":0.5,"reasoning":"r","attack_technique":"T1059"}' WHEN 2 THEN '{"verdict":"malicious","confidence":1.5,"reasoning":"r"}'
    WHEN 3 THEN '{"verdict":"odd","confidence":0.5,"reasoning":"r"}' WHEN 4 THEN '{"verdict":"malicious","confidence":0.5}' WHEN 5 THEN '{"verdict":"malicious","confidence":0.9,"reasoning":"r","attack_technique":"T1059.001"}'
    ELSE '{"verdict":"suspicious","confidence":0.4,"reasoning":"r","attack_technique":"BAD"}' END"""


@_query(
    "verdict_validate",
    f"""{_ALERTS} SELECT CASE WHEN k % 7 IN (0, 4) THEN 'grammar' WHEN k % 7 IN (1, 2, 3, 6) THEN 'semantic' END AS fail_kind, CASE WHEN k % 7 = 5 THEN 'malicious' END AS verdict,
    k % 7 <> 5 AS parse_failed, count(*) AS n FROM alerts GROUP BY 1, 2, 3""",
)
def verdict_validate(spark, sf):
    rows = views.alerts(spark, sf).withColumn("response", F.expr(_RESPONSE)).drop("attack_technique")
    return scorers.parse_verdicts(rows).groupBy("fail_kind", "verdict", "parse_failed").agg(F.count(F.lit(1)).alias("n"))


_PROMPT = f"""{_WITH_KV}, types AS ({_TYPES}),
    lines AS (SELECT id, string_agg('- ' || key || ': ' || val, chr(10) ORDER BY key) AS lines FROM kv WHERE val <> '' GROUP BY 1),
    p AS (SELECT a.id, 'Judge one telemetry event: benign, suspicious or malicious.' || chr(10) || 'Host: ' || source_host || chr(10) || 'Type: ' || a.event_type || chr(10) || 'Meaning: '
        || coalesce(t.meaning, '{C.OTHER_MEANING}') || chr(10) || 'Fields:' || chr(10) || lines AS prompt
        FROM alerts a JOIN lines USING (id) LEFT JOIN types t ON t.channel = lower(a."f_Channel") AND t.code = a.event_code)"""


@_query("prompt_text", f"{_PROMPT} SELECT id, md5(prompt) AS prompt_md5 FROM p")
def prompt_text(spark, sf):
    return scorers.prompts(views.alerts(spark, sf)).select("id", F.md5("prompt").alias("prompt_md5"))


@_query("token_estimate", f"{_PROMPT} SELECT id, CAST(length(prompt) * 1101 // 1364 AS BIGINT) AS tokens FROM p")
def token_estimate(spark, sf):
    return scorers.prompts(views.alerts(spark, sf)).select("id", "tokens")


_BLOB = """concat_ws(' ', nullif("f_CommandLine", ''), nullif("f_ParentCommandLine", ''), nullif("f_TargetObject", ''))"""
_PATTERN = " OR ".join(f"regexp_matches(blob, '(?i){p}')" for p in C.COMMAND_PATTERNS)
_NAMES = " OR ".join(f"contains(lower(blob), '{n}')" for n in C.BINARY_NAMES)
_RULES = f"""{_ALERTS}, b AS (SELECT *, {_BLOB} AS blob FROM alerts), h AS (SELECT *, ({_PATTERN}) AS pat, ({_NAMES}) AS name FROM b)"""


@_query("rules_score", f"{_RULES} SELECT id, round((CAST(pat AND name AS INTEGER) + CAST(pat AS INTEGER) + CAST(event_code = 10 AS INTEGER)) / 3.0::DOUBLE, 6) AS score, pat OR event_code = 10 AS pred FROM h")
def rules_score(spark, sf):
    return scorers.rules(views.alerts(spark, sf)).select("id", F.round("score", 6).alias("score"), "pred")


_VECTOR = f"""SELECT id, event_type, CAST(event_code AS VARCHAR) AS event_id, CAST((SELECT count(*) FROM kv WHERE kv.id = h.id AND key NOT IN ({_quote(C.SUPPRESSED_KEYS)})) AS BIGINT) AS field_count,
    CAST(length(coalesce("f_CommandLine", '')) AS BIGINT) AS command_line_length, name AS has_binary_name, pat AS has_pattern,
    coalesce("f_ParentCommandLine" <> '', false) AS has_parent_command_line, coalesce("f_TargetObject" <> '', false) AS has_target_object FROM h"""


@_query("feature_vector", f"{_RULES}, kv AS ({_KV}) {_VECTOR}")
def feature_vector(spark, sf):
    return views.alerts(spark, sf).select("id", X.features(F.col("fields"), F.col("event_type")).alias("f")).select("id", "f.*")


ORACLES["duplication_stats"] = f"""{_RULES}, kv AS ({_KV}), vec AS ({_VECTOR}), d AS (SELECT DISTINCT event_type, event_id, field_count, command_line_length, has_binary_name, has_pattern, has_parent_command_line, has_target_object FROM vec)
    SELECT (SELECT count(*) FROM vec) AS n, (SELECT count(*) FROM d) AS "distinct", 1 - (SELECT count(*) FROM d) / (SELECT count(*) FROM vec)::DOUBLE AS rate"""


@_query("random_baseline", f"{_ALERTS}, u AS (SELECT id, {views.uniform_sql(f"id || ':{SEED}'", False)} AS score FROM alerts) SELECT id, round(score, 6) AS score, score < {RATE} AS pred FROM u")
def random_baseline(spark, sf):
    return scorers.stratified_random(views.alerts(spark, sf), RATE, SEED).select("id", F.round("score", 6).alias("score"), "pred")


# --- evaluation ------------------------------------------------------------


@_query("confusion", f"{_VERDICTS} SELECT policy, {_COUNTS} FROM long WHERE pred IS NOT NULL GROUP BY 1")
def confusion(spark, sf):
    return evaluation.metric_table(_long(spark, sf), ["policy"]).select("policy", "tp", "fp", "fn", "tn")


@_query("metric_set", f"{_VERDICTS}, c AS (SELECT policy, {_COUNTS} FROM long WHERE pred IS NOT NULL GROUP BY 1) SELECT policy, tp, fp, fn, tn, {_MEASURES} FROM c")
def metric_set(spark, sf):
    return _rounded(evaluation.metric_table(_long(spark, sf), ["policy"]))


@_query("wilson", f"{_VERDICTS}, c AS (SELECT event_code, count(*) FILTER (pred_conservative) AS s, count(*) AS n FROM preds GROUP BY 1) SELECT event_code, s, n, {_wilson_sql('s', 'n', 'share')} FROM c")
def wilson(spark, sf):
    c = _predictions(spark, sf).groupBy("event_code").agg(F.count_if("pred_conservative").alias("s"), F.count(F.lit(1)).alias("n"))
    w = wilson_or_null(F.col("s"), F.col("n"))
    return _rounded(c.select("event_code", "s", "n", w["low"].alias("share_low"), w["high"].alias("share_high")))


def _lines_sql(select: str) -> str:
    return f"""WITH c AS (SELECT l_suppkey AS event_code, l_discount AS score, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1, 2),
        s AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM c WINDOW w AS (PARTITION BY event_code ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
        g AS (SELECT event_code, sum(p) AS pos, sum(n) AS neg, sum(p * tp / (tp + fp)::DOUBLE) AS w, sum(n::DOUBLE * (tp - p / 2.0::DOUBLE)) AS a FROM s GROUP BY 1)
        SELECT event_code, CASE WHEN pos > 0 AND neg > 0 THEN {select} FROM g"""


@_query("pr_auc", _lines_sql("round(w / pos, 6) END AS pr_auc"))
def pr_auc(spark, sf):
    return _rounded(evaluation.ranking(views.line_items(spark, sf), ["event_code"]).select("event_code", "pr_auc"))


@_query("roc_auc", _lines_sql("round(a / (pos::DOUBLE * neg), 6) END AS roc_auc"))
def roc_auc(spark, sf):
    return _rounded(evaluation.ranking(views.line_items(spark, sf), ["event_code"]).select("event_code", "roc_auc"))


_BINS = f"""{_VERDICTS}, x AS (SELECT confidence AS c, pred_conservative = is_malicious AS ok FROM preds WHERE confidence IS NOT NULL AND pred_conservative IS NOT NULL),
    b AS (SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(c) AS mean_confidence, avg(ok::INTEGER) AS accuracy FROM x GROUP BY 1)"""


def _ok() -> Column:
    return F.col("pred_conservative") == F.col("is_malicious")


@_query("ece_bins", f"{_BINS} SELECT g.range::INTEGER AS bin, coalesce(n, 0) AS n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM range(10) g LEFT JOIN b ON b.bin = g.range")
def ece_bins(spark, sf):
    return _rounded(evaluation.reliability_bins(_predictions(spark, sf), F.col("confidence"), _ok()).select("bin", "n", "mean_confidence", "accuracy"))


@_query("ece", f"{_BINS} SELECT round(sum(n / (SELECT count(*) FROM x)::DOUBLE * abs(accuracy - mean_confidence)), 6) AS ece, (SELECT count(*) FROM x) AS n FROM b")
def ece(spark, sf):
    return _rounded(evaluation.calibration_error(_predictions(spark, sf), F.col("confidence"), _ok()))


@_query("selective", f"{_VERDICTS} SELECT policy, count(*) AS n, count(pred) AS committed, round(count(pred) / count(*), 6) AS coverage, round(avg((pred = is_malicious)::INTEGER), 6) AS selective_accuracy FROM long GROUP BY 1")
def selective(spark, sf):
    return _rounded(evaluation.selective(_long(spark, sf), ["policy"]))


_CURVE = f"""{_VERDICTS}, o AS (SELECT row_number() OVER w AS k, sum((pred_abstention = is_malicious)::INTEGER) OVER w AS s FROM preds WHERE pred_abstention IS NOT NULL AND confidence IS NOT NULL
        WINDOW w AS (ORDER BY confidence DESC, event_id ROWS UNBOUNDED PRECEDING)),
    curve AS (SELECT k, k / (SELECT count(*) FROM preds)::DOUBLE AS coverage, 1 - s / k::DOUBLE AS risk FROM o)"""


@_query("risk_coverage_curve", f"{_CURVE} SELECT k, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve")
def risk_coverage_curve(spark, sf):
    return _rounded(evaluation.risk_coverage(_predictions(spark, sf), "event_id", "pred_abstention"))


@_query("aurc", f"{_CURVE} SELECT round(sum((coverage - c0) * (risk + r0) / 2), 6) AS aurc FROM (SELECT *, lag(coverage, 1, 0.0) OVER (ORDER BY k) AS c0, lag(risk, 1, risk) OVER (ORDER BY k) AS r0 FROM curve)")
def aurc(spark, sf):
    return _rounded(evaluation.area_under_risk(evaluation.risk_coverage(_predictions(spark, sf), "event_id", "pred_abstention")))


@_query(
    "slice_report_grouping_sets",
    f"""{_VERDICTS}, g AS (
        SELECT policy, 'pooled' AS slice_kind, 'all' AS slice_value, {_COUNTS} FROM long WHERE pred IS NOT NULL GROUP BY 1
        UNION ALL SELECT policy, 'event_code', CAST(event_code AS VARCHAR), {_COUNTS} FROM long WHERE pred IS NOT NULL GROUP BY policy, event_code
        UNION ALL SELECT policy, 'event_type', event_type, {_COUNTS} FROM long WHERE pred IS NOT NULL GROUP BY policy, event_type)
    SELECT policy, slice_kind, slice_value, tp, fp, fn, tn, {_MEASURES}, {_wilson_sql('tp', 'tp + fn', 'recall')}, {_wilson_sql('tp', 'tp + fp', 'precision')}, {_wilson_sql('fp', 'fp + tn', 'fpr')} FROM g""",
)
def slice_report_grouping_sets(spark, sf):
    return _rounded(evaluation.slice_report(_long(spark, sf), ["event_code", "event_type"]))


_KINDS = """kinds AS (SELECT policy, 'pooled' AS slice_kind, 'all' AS slice_value, is_malicious, pred, score FROM long
        UNION ALL SELECT policy, 'event_type', event_type, is_malicious, pred, score FROM long)"""


@_query(
    "full_slice_report",
    f"""{_VERDICTS}, {_KINDS},
    c AS (SELECT policy, slice_kind, slice_value, {_COUNTS} FROM kinds WHERE pred IS NOT NULL GROUP BY 1, 2, 3),
    sizes AS (SELECT policy, slice_kind, slice_value, count(*) FILTER (is_malicious) AS n_malicious, count(*) FILTER (NOT is_malicious) AS n_benign, count(*) AS n, count(pred) AS committed,
        round(count(pred) / count(*), 6) AS coverage, round(avg((pred = is_malicious)::INTEGER), 6) AS selective_accuracy FROM kinds GROUP BY 1, 2, 3),
    d AS (SELECT policy, slice_kind, slice_value, score, count(*) FILTER (is_malicious) AS p, count(*) FILTER (NOT is_malicious) AS q FROM kinds WHERE pred IS NOT NULL GROUP BY 1, 2, 3, 4),
    s AS (SELECT *, sum(p) OVER w AS tps, sum(q) OVER w AS fps FROM d WINDOW w AS (PARTITION BY policy, slice_kind, slice_value ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    areas AS (SELECT policy, slice_kind, slice_value, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(p * tps / (tps + fps)::DOUBLE) / sum(p), 6) END AS pr_auc,
        CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(q::DOUBLE * (tps - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)), 6) END AS roc_auc FROM s GROUP BY 1, 2, 3)
    SELECT policy, slice_kind, slice_value, tp, fp, fn, tn, {_MEASURES}, {_wilson_sql('tp', 'tp + fn', 'recall')}, {_wilson_sql('tp', 'tp + fp', 'precision')}, {_wilson_sql('fp', 'fp + tn', 'fpr')},
        n_malicious, n_benign, pr_auc, roc_auc, n, committed, coverage, selective_accuracy
    FROM c JOIN sizes USING (policy, slice_kind, slice_value) JOIN areas USING (policy, slice_kind, slice_value)""",
)
def full_slice_report(spark, sf):
    return _rounded(evaluation.full_slice_report(_long(spark, sf), ["event_type"]))


@_query(
    "technique_and_sentinel",
    f"""{_VERDICTS}, c AS (SELECT policy, CASE WHEN technique_unresolved THEN '{C.UNRESOLVED}' WHEN NOT is_malicious THEN 'benign' ELSE coalesce(attack_technique, 'unknown') END AS technique, {_COUNTS}
        FROM long WHERE pred IS NOT NULL GROUP BY 1, 2) SELECT policy, technique, tp, fp, fn, tn, {_MEASURES} FROM c""",
)
def technique_and_sentinel(spark, sf):
    return _rounded(evaluation.technique_slices(_long(spark, sf)))


@_query("verdict_truth_3x2", f"{_VERDICTS} SELECT verdict, count(*) FILTER (is_malicious) AS malicious, count(*) FILTER (NOT is_malicious) AS benign FROM preds GROUP BY 1")
def verdict_truth_3x2(spark, sf):
    return evaluation.verdict_truth_table(_predictions(spark, sf))


_F = {"precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)", "f1": "2.0 * tp / nullif(2 * tp + fp + fn, 0)"}
_G = {"precision": "tn / nullif(tn + fn, 0)", "recall": "tn / nullif(tn + fp, 0)", "f1": "2.0 * tn / nullif(2 * tn + fp + fn, 0)"}


@_query(
    "macro_weighted",
    f"{_VERDICTS}, c AS (SELECT policy, {_COUNTS} FROM long WHERE pred IS NOT NULL GROUP BY 1) SELECT policy, "
    + ", ".join(f"round(({_F[m]} + {_G[m]}) / 2, 6) AS macro_{m}, round({_F[m]} * (tp + fn) / (tp + fp + fn + tn) + {_G[m]} * (fp + tn) / (tp + fp + fn + tn), 6) AS weighted_{m}" for m in _F)
    + " FROM c",
)
def macro_weighted(spark, sf):
    return _rounded(evaluation.macro_weighted(_long(spark, sf), ["policy"]))


@_query("parse_failure", f"{_VERDICTS}, c AS (SELECT count(*) AS n, count(*) FILTER (parse_failed) AS failed FROM preds) SELECT n, failed, round(failed / n, 6) AS rate, {_wilson_sql('failed', 'n', 'x')} FROM c".replace("x_low", "low").replace("x_high", "high"))
def parse_failure(spark, sf):
    return _rounded(evaluation.parse_failures(_predictions(spark, sf)))


@_query(
    "determinism",
    f"""{_ALERTS}, v AS ({views.verdicts_sql(False)}), p AS (SELECT id, count(DISTINCT coalesce(verdict, '-') || coalesce(CAST(confidence AS VARCHAR), '-')) AS kinds FROM v GROUP BY 1),
    c AS (SELECT count(*) AS n, count(*) FILTER (kinds = 1) AS agreeing FROM p) SELECT n, agreeing, round(agreeing / n, 6) AS rate, {_wilson_sql('agreeing', 'n', 'x')} FROM c""".replace("x_low", "low").replace("x_high", "high"),
)
def determinism(spark, sf):
    return _rounded(evaluation.determinism(views.verdicts(spark, sf, repeats=True), ["verdict", "confidence"]))


# --- audit and significance ------------------------------------------------


@_query("single_feature_accuracy", f"{_ALERTS}, c AS (SELECT event_code, count(*) FILTER (is_malicious) AS m, count(*) FILTER (NOT is_malicious) AS b FROM alerts GROUP BY 1) SELECT CAST(sum(m + b) AS BIGINT) AS n, round(sum(greatest(m, b)) / sum(m + b), 6) AS accuracy FROM c")
def single_feature_accuracy(spark, sf):
    return _rounded(audit.single_feature_accuracy(views.alerts(spark, sf), F.col("event_code"), "event").select("n", "accuracy"))


@_query(
    "shortcut_audit_keys",
    f"""{_WITH_KV}, c AS (SELECT key, substr(val, 1, 4) AS f, count(*) FILTER (is_malicious) AS m, count(*) FILTER (NOT is_malicious) AS b FROM kv GROUP BY 1, 2),
    k AS (SELECT key, sum(m) AS m, sum(b) AS b, sum(greatest(m, b)) AS best FROM c GROUP BY 1), t AS (SELECT count(*) FILTER (is_malicious) AS tm, count(*) FILTER (NOT is_malicious) AS tb FROM alerts)
    SELECT key, round((best + greatest(tm - m, tb - b)) / (tm + tb), 6) AS accuracy, (best + greatest(tm - m, tb - b)) / (tm + tb) >= 0.65 AS flagged FROM k, t""",
)
def shortcut_audit_keys(spark, sf):
    rows = audit.key_feature_accuracy(views.alerts(spark, sf), "substr(v, 1, 4)", "prefix")
    return rows.select("key", F.round("accuracy", 6).alias("accuracy"), (F.col("accuracy") >= audit.THRESHOLD).alias("flagged"))


@_query(
    "shortcut_audit",
    f"""{_WITH_KV}, {_SHARED}, sizes AS (SELECT id, count(*) AS fields FROM kv GROUP BY 1), a AS (SELECT x.*, coalesce(fields, 0) AS fields FROM alerts x LEFT JOIN sizes USING (id)),
    whole AS (SELECT 'year' AS name, CAST(year(ts) AS VARCHAR) AS f, is_malicious FROM a UNION ALL SELECT 'field_count', CAST(fields AS VARCHAR), is_malicious FROM a
        UNION ALL SELECT 'event', CAST(event_code AS VARCHAR), is_malicious FROM a UNION ALL SELECT 'event_field_count', concat_ws('/', event_code, fields), is_malicious FROM a SEMI JOIN events2 USING (event_code)),
    single AS (SELECT name, f, count(*) FILTER (is_malicious) AS m, count(*) FILTER (NOT is_malicious) AS b FROM whole GROUP BY 1, 2),
    valued AS (SELECT 'time_prefix' AS name, key, substr(val, 1, 4) AS f, is_malicious FROM kv WHERE key IN ({_quote(C.TIME_KEYS)})
        UNION ALL SELECT 'value_type', key, CASE WHEN regexp_full_match(val, '[+-]?[0-9]+') THEN 'number' WHEN regexp_full_match(val, '0[xX][0-9a-fA-F]+') THEN 'hex' ELSE 'text' END, is_malicious FROM kv),
    c AS (SELECT name, key, f, count(*) FILTER (is_malicious) AS m, count(*) FILTER (NOT is_malicious) AS b FROM valued GROUP BY 1, 2, 3),
    k AS (SELECT name, key, sum(m) AS m, sum(b) AS b, sum(greatest(m, b)) AS best FROM c GROUP BY 1, 2), t AS (SELECT count(*) FILTER (is_malicious) AS tm, count(*) FILTER (NOT is_malicious) AS tb FROM alerts),
    o AS (SELECT name, '' AS key, CAST(sum(m + b) AS BIGINT) AS n, sum(greatest(m, b)) / sum(m + b) AS accuracy FROM single GROUP BY 1
        UNION ALL SELECT name, key, tm + tb, (best + greatest(tm - m, tb - b)) / (tm + tb) FROM k, t)
    SELECT name AS "check", key, n, round(accuracy, 6) AS accuracy, accuracy >= {audit.THRESHOLD} AS flagged FROM o""",
)
def shortcut_audit(spark, sf):
    return _rounded(audit.shortcut_audit(views.alerts(spark, sf)))


def _pairs(spark, sf) -> DataFrame:
    llm = _predictions(spark, sf).withColumn("pred", F.col("pred_conservative"))
    return significance.paired(llm, scorers.rules(views.alerts(spark, sf)))


@_query(
    "mcnemar_counts",
    f"""{_VERDICTS}, b AS (SELECT id, event_code, {_BLOB} AS blob FROM alerts), r AS (SELECT id, ({_PATTERN}) OR event_code = 10 AS rule FROM b),
    j AS (SELECT pred_conservative = is_malicious AS a, rule = is_malicious AS b FROM preds JOIN r USING (id) WHERE pred_conservative IS NOT NULL)
    SELECT count(*) AS n, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM j""",
)
def mcnemar_counts(spark, sf):
    return significance.mcnemar_counts(_pairs(spark, sf))


@_query("mcnemar_p")
def mcnemar_p(spark, sf):
    return significance.mcnemar(_pairs(spark, sf))


@_query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    return significance.paired_accuracy_interval(_pairs(spark, sf), seed=SEED)


@_query("unpaired_bootstrap")
def unpaired_bootstrap(spark, sf):
    rows = _predictions(spark, sf).withColumn("pred", F.col("pred_conservative")).withColumn("bucket", X.context_bucket(F.col("fields")))
    cells = {r["bucket"]: [r["tp"], r["fp"], r["fn"], r["tn"]] for r in evaluation.metric_table(rows, ["bucket"]).collect()}  # two rows, of one pass
    out = significance.mcc_difference_interval(spark, *(cells.get(b, [0] * 4) for b in ("context_rich", "context_poor")), seed=SEED)
    return out.withColumn("outcome", significance.verdict_on_difference(F.col("low"), F.col("high")))


@_query("classical_ml")
def classical_ml(spark, sf):
    rows = views.alerts(spark, sf)
    held = shared.written(sampling.eval_sample(rows, "event_code", size=1925).filter(~F.col("is_malicious") | F.col("source_capture_id").isin("cap-0", "cap-1")), "sample")
    fit, _ = corpus.leakage_safe_split(rows, held)
    scored = scorers.classical(fit, held, max_iter=1000)
    return evaluation.metric_table(scored, [])


@_query(
    "score_batch",
    f"""{_PROMPT} SELECT CASE WHEN contains(prompt, '-enc') THEN 'malicious' WHEN length(prompt) % 50 <> 0 THEN 'benign' END AS verdict,
    NOT contains(prompt, '-enc') AND length(prompt) % 50 = 0 AS parse_failed, count(*) AS n FROM p GROUP BY 1, 2""",
)
def score_batch(spark, sf):
    def call(prompts: list[str]) -> list[str | None]:
        return ['{"verdict":"malicious","confidence":0.9,"reasoning":"encoded"}' if "-enc" in p else '{"verdict":"benign","confidence":0.8,"reasoning":"plain"}' if len(p) % 50 else None for p in prompts]

    return scorers.score_batch(views.alerts(spark, sf), call).groupBy("verdict", "parse_failed").agg(F.count(F.lit(1)).alias("n"))


# --- incremental -----------------------------------------------------------

_CONV_LOG = "SELECT concat(CAST(conv_id AS STRING), ':', role) AS record_id, turn AS log_pos, text AS verdict FROM"


@_query("log_last_wins", f"WITH log AS ({_CONV_LOG} conversations), m AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY log_pos DESC, verdict DESC) AS r FROM log) SELECT record_id, log_pos, md5(verdict) AS verdict FROM m WHERE r = 1")
def log_last_wins(spark, sf):
    log = spark.sql(_CONV_LOG + " {c}", c=spark.read.parquet(f"{sf}/conversations.parquet"))
    return incremental.last_verdicts(log).select("record_id", "log_pos", F.md5("verdict").alias("verdict"))


@_query("resume_pending", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.role = 'assistant')")
def resume_pending(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    log = turns.filter("role = 'assistant'").select(F.col("id").alias("record_id"))
    return incremental.pending(turns, log).select("conv_id", "turn")


# --- whole evaluations -----------------------------------------------------

_RICH = f"""{_WITH_KV}, rich AS (SELECT DISTINCT id FROM kv WHERE key IN ({_quote(C.ACTOR_FIELDS + C.OBJECT_FIELDS)}) AND trim(val) NOT IN ({_quote(C.EMPTY_VALUES)})),
    bucketed AS (SELECT a.*, CASE WHEN r.id IS NULL THEN 'context_poor' ELSE 'context_rich' END AS bucket FROM alerts a LEFT JOIN rich r ON r.id = a.id)"""


@_query("base_rate", f"{_ALERTS} SELECT count(*) AS n, round(avg(is_malicious::INTEGER), 6) AS rate FROM alerts")
def base_rate(spark, sf):
    return _rounded(experiments.base_rate(views.alerts(spark, sf)))


@_query("bucket_events", f"{_RICH} SELECT event_code, count(*) FILTER (bucket = 'context_rich') AS rich, count(*) FILTER (bucket = 'context_poor') AS poor FROM bucketed GROUP BY 1")
def bucket_events(spark, sf):
    return experiments.bucket_events(experiments.with_bucket(views.alerts(spark, sf)))


@_query(
    "bucket_sample",
    f"""{_RICH}, sizes AS (SELECT bucket, is_malicious, event_code, count(*) AS n FROM bucketed GROUP BY 1, 2, 3),
    {_quota_sql('CASE WHEN is_malicious THEN 385 ELSE 1540 END', 'bucket, is_malicious')},
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket, is_malicious, event_code ORDER BY md5(id || ':{experiments.CONTEXT_SEED}'), id) AS r FROM bucketed)
    SELECT id, r.bucket, r.is_malicious FROM r JOIN quota q ON q.bucket = r.bucket AND q.event_code = r.event_code AND q.is_malicious = r.is_malicious WHERE r.r <= q.quota""",
)
def bucket_sample(spark, sf):
    rows = experiments.with_bucket(views.alerts(spark, sf))
    return sampling.eval_sample(rows, "event_code", seed=experiments.CONTEXT_SEED, by=["bucket"]).select("id", "bucket", "is_malicious")


@_query(
    "take_per_class",
    f"{_ALERTS}, r AS (SELECT id, is_malicious, row_number() OVER (PARTITION BY is_malicious ORDER BY md5(id || ':{SEED}'), id) AS r FROM alerts) SELECT id, is_malicious FROM r WHERE r <= 150",
)
def take_per_class(spark, sf):
    return experiments.take_per_class(views.alerts(spark, sf), 150).select("id", "is_malicious")


@_query(
    "text_rules",
    "WITH t AS (SELECT d.lang AS stratum, l.toxic = 1 AS is_malicious, ("
    + _PATTERN.replace("blob", "d.text")
    + f") AS pred FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT stratum, {_COUNTS} FROM t WHERE stratum IS NOT NULL GROUP BY 1) SELECT stratum, tp, fp, fn, tn, {_MEASURES} FROM c",
)
def text_rules(spark, sf):
    return _rounded(evaluation.metric_table(scorers.rules(views.text_items(spark, sf)), ["stratum"]))


def _evaluated(spark, sf) -> dict[str, DataFrame]:
    rows = views.alerts(spark, sf)
    pool = rows.filter(~F.col("is_malicious") | F.col("source_capture_id").isin("cap-0", "cap-1"))
    return experiments.evaluate(rows, views.verdicts(spark, sf), pool=pool)


@_query("evaluation_report")
def evaluation_report(spark, sf):
    return _evaluated(spark, sf)["slices"]


@_query("significance_report")
def significance_report(spark, sf):
    return _evaluated(spark, sf)["significance"]


@_query(
    "context_cells",
    f"""{_RICH}, {_VERDICTS[len(_ALERTS) + 1:]}, sizes AS (SELECT bucket, is_malicious, event_code, count(*) AS n FROM bucketed GROUP BY 1, 2, 3),
    {_quota_sql('CASE WHEN is_malicious THEN 385 ELSE 1540 END', 'bucket, is_malicious')},
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket, is_malicious, event_code ORDER BY md5(id || ':{experiments.CONTEXT_SEED}'), id) AS r FROM bucketed),
    drawn AS (SELECT r.id, r.bucket FROM r JOIN quota q ON q.bucket = r.bucket AND q.event_code = r.event_code AND q.is_malicious = r.is_malicious WHERE r.r <= q.quota),
    s AS (SELECT d.bucket, p.is_malicious, p.pred_conservative AS pred FROM drawn d JOIN preds p USING (id) WHERE p.pred_conservative IS NOT NULL),
    c AS (SELECT bucket, {_COUNTS} FROM s GROUP BY 1), m AS (SELECT bucket, tp, fp, fn, tn, {_MEASURES} FROM c) SELECT bucket, tp, fp, fn, tn, mcc FROM m""",
)
def context_cells(spark, sf):
    """The part of the context experiment that draws nothing at random."""
    return _rounded(experiments.context_cells(views.alerts(spark, sf), views.verdicts(spark, sf)))


@_query("context_experiment")
def context_experiment(spark, sf):
    return experiments.context_experiment(views.alerts(spark, sf), views.verdicts(spark, sf))


# --- files, streams and stores that Spark derives from the tables ------------


def _write_lines(rows: DataFrame, name: str, parts: int = 4) -> str:
    """Text files of (capture, event_id, value) rows: a folder for each capture, lines in the order of events across its files.

    ``parts`` ranges for each partition of the rows, so that writing tasks grow in number with the input.
    """
    path = shared.new_path(rows.sparkSession, name)
    dealt = rows.repartitionByRange(parts * max(1, rows.rdd.getNumPartitions()), "capture", "event_id").sortWithinPartitions("capture", "event_id")
    dealt.select("capture", "value").write.partitionBy("capture").text(path)
    return path


def _capture_of(file: Column) -> Column:
    return F.regexp_extract(file, "/capture=([^/]*)/", 1)


_PLACED = f"""{_ALERTS}, raw AS (SELECT source_capture_id AS capture, event_id, is_malicious, source_host, {_RAW} AS raw_json FROM alerts),
    placed AS (SELECT *, CAST(sum(strlen(raw_json) + 1) OVER (PARTITION BY capture ORDER BY event_id) - strlen(raw_json) - 1 AS BIGINT) AS place FROM raw)"""


@_query("event_file_scan", f"{_PLACED} SELECT capture, place, event_id, md5(raw_json) AS line FROM placed")
def event_file_scan(spark, sf):
    rows = views.alerts(spark, sf).select(F.col("source_capture_id").alias("capture"), "event_id", F.expr(_RAW).alias("value"))
    lines = event_lines.read_lines(spark, _write_lines(rows, "event-files"), split_bytes=100_000)
    events = ingest.with_place(ingest.events_of(lines), _capture_of(F.col("file")))
    return events.select(F.col("capture_id").alias("capture"), F.col("index").alias("place"), ingest.text_of(F.col("raw"), "RecordNumber").cast("long").alias("event_id"), F.md5("raw_json").alias("line"))


@_query(
    "capture_files",
    f"""{_PLACED} SELECT concat_ws(':', 'single', capture, place, substr(sha256(concat_ws(':', capture, place, raw_json)), 1, 16)) AS id, source_host, capture AS source_capture_id,
    'T101' || substr(capture, 5) AS attack_technique, '001' AS attack_subtechnique FROM placed WHERE is_malicious AND capture NOT IN ({_quote(_COMPOUND)})""",
)
def capture_files(spark, sf):
    """Single-technique captures from files, paired with metadata documents, ids by place."""
    rows = views.alerts(spark, sf).filter("is_malicious").select(F.col("source_capture_id").alias("capture"), "event_id", F.expr(_RAW).alias("value"))
    path = shared.new_path(spark, "capture-metadata")
    known = rows.filter(~F.col("capture").isin(_COMPOUND)).select(F.col("capture").alias("id")).distinct()
    known.selectExpr("id", "id AS document", *_MAPPING.split(",\n")).write.partitionBy("document").json(path)  # a file for each capture
    lines = event_lines.read_lines(spark, _write_lines(rows, "captures"), split_bytes=100_000)
    events = ingest.with_place(ingest.events_of(lines), _capture_of(F.col("file"))).withColumn("file", F.concat("capture_id", F.lit(".json")))
    found = ingest.normalise_single(events, ingest.read_metadata(spark, path).drop("document"), "single")
    return found.select("id", "source_host", "source_capture_id", "attack_technique", "attack_subtechnique")


_NESTED = """to_json(named_struct('Event', named_struct('System', named_struct('EventID', named_struct('#text', event_code), 'Channel', channel, 'Computer', source_host,
    'TimeCreated', named_struct('#attributes', named_struct('SystemTime', moment)), 'EventRecordID', event_id, 'Level', k % 5),
    'EventData', named_struct('CommandLine', concat('run ', k), 'Channel', 'of the data'))))"""


@_query(
    "nested_event_scan",
    f"""{_ALERTS} SELECT CAST(event_id AS VARCHAR) AS "RecordNumber", CAST(event_code AS VARCHAR) AS "EventID", {_CHANNEL} AS "Channel", source_host AS "Hostname",
    {_MOMENT} AS "EventTime", {_MOMENT} AS "@timestamp", CAST(k % 5 AS VARCHAR) AS "Level", 'run ' || k AS "CommandLine", CAST(8 AS BIGINT) AS keys FROM alerts WHERE NOT is_malicious""",
)
def nested_event_scan(spark, sf):
    """Nested event logs in a folder tree, read as one source and flattened."""
    rows = views.alerts(spark, sf).filter("NOT is_malicious").withColumns({"channel": F.expr(_CHANNEL), "moment": F.expr(_MOMENT)})
    rows = rows.select(F.concat(F.lit("log-"), (F.col("event_id") % 3).cast("string")).alias("capture"), "event_id", F.expr(_NESTED).alias("value"))
    lines = event_lines.read_lines(spark, _write_lines(rows, "nested-logs"), split_bytes=100_000)
    flat = ingest.flatten_nested(lines, "line")
    keys = ["RecordNumber", "EventID", "Channel", "Hostname", "EventTime", "@timestamp", "Level", "CommandLine"]
    return flat.select(*[ingest.text_of(F.col("raw"), k).alias(k) for k in keys], F.size(F.map_keys("raw")).cast("long").alias("keys"))


@_query("stream_numbering", f"{_ALERTS} SELECT source_capture_id AS capture_id, event_id, row_number() OVER (PARTITION BY source_capture_id ORDER BY event_id) - 1 AS index FROM alerts WHERE is_malicious")
def stream_numbering(spark, sf):
    """Events of captures that arrive as files in two turns, numbered by a stream that is stopped in between."""
    rows = views.alerts(spark, sf).filter("is_malicious").select(F.col("source_capture_id").alias("capture_id"), "event_id")
    half = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    arriving, out, mark = (shared.new_path(spark, n) for n in ("arriving", "numbered", "numbered-mark"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    known = spark.conf.get(setting)
    spark.conf.set(setting, numbering.STORE)
    try:
        for part in (rows.filter(F.col("event_id") <= half), rows.filter(F.col("event_id") > half)):
            part.write.mode("append").parquet(arriving)
            stream = numbering.numbered(spark.readStream.schema(rows.schema).parquet(arriving), ["event_id"])
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, known)
    return spark.read.parquet(out).select("capture_id", "event_id", "index")


_STORED = "id AS record_id, verdict, confidence, CASE WHEN verdict = 'malicious' THEN 'T1059' END AS attack_technique"


@_query(
    "verdict_checkpoint",
    f"""{_RICH}, {_VERDICTS[len(_ALERTS) + 1:]} SELECT p.id, p.is_malicious, p.event_code, p.attack_technique, b.bucket = 'context_rich' AS context_rich, p.verdict, p.confidence,
    CASE WHEN p.verdict = 'malicious' THEN 'T1059' END AS predicted_technique FROM preds p JOIN bucketed b USING (id)""",
)
def verdict_checkpoint(spark, sf):
    """Verdicts written to a committed store in two batches, one of them twice, and joined with their records."""
    path, rows = shared.new_path(spark, "verdict-store"), views.verdicts(spark, sf).selectExpr(*_STORED.split(", "))
    for k in (0, 1, 0):
        verdict_store.append_batch(rows.filter(F.pmod(F.xxhash64("record_id"), F.lit(2)) == k), path, f"half-{k}")
    return incremental.checkpoint_table(views.alerts(spark, sf), verdict_store.read_store(spark, path, rows.schema))


# --- values, order and resampling at any size --------------------------------

_WIDE = """CASE k % 6 WHEN 0 THEN concat('0x', substr(sha2(id, 256), 1, 40)) WHEN 1 THEN concat('-0X00', substr(sha2(id, 256), 1, 17 + k % 40)) WHEN 2 THEN concat('+000', translate(sha2(id, 256), 'abcdef', '123456'))
    WHEN 3 THEN concat(' -', substr(translate(sha2(id, 256), 'abcdef', '987654'), 1, 1 + k % 50)) WHEN 4 THEN concat('0x', substr(sha2(id, 256), 1, 1 + k % 20)) ELSE concat(sha2(id, 256), 'x') END"""
_BIG = "list_reduce(list_prepend(0::BIGNUM, list_transform(string_split(d, ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGNUM)), lambda a, c: list_sum([" + ", ".join(["a"] * 16) + ", c])::BIGNUM)"


@_query(
    "canonical_wide",
    f"""{_ALERTS}, v AS (SELECT id, trim({_WIDE.replace('sha2(id, 256)', 'sha256(id)')}) AS t FROM alerts),
    p AS (SELECT id, t, starts_with(t, '-') AS minus, lower(regexp_extract(t, '^-?0[xX]0*([0-9a-fA-F]+)$', 1)) AS d, regexp_extract(t, '^[+-]?0*([0-9]+)$', 1) AS n FROM v),
    m AS (SELECT *, CASE WHEN n <> '' THEN n WHEN d <> '' THEN ({_BIG})::VARCHAR END AS size FROM p)
    SELECT id, CASE WHEN size IS NULL THEN t WHEN NOT minus OR size = '0' THEN size WHEN length(size) < 19 OR (length(size) = 19 AND size::HUGEINT <= 9223372036854775808) THEN (18446744073709551616 - size::HUGEINT)::VARCHAR
        ELSE '-' || size END AS value FROM m""",
)
def canonical_wide(spark, sf):
    return views.alerts(spark, sf).select("id", X.canonical(F.expr(_WIDE)).alias("value"))


_TYPED = """concat('{"Code":', CASE WHEN is_malicious THEN '"5"' ELSE '5' END, ',"Same":"', k, '","Mixed":', CASE WHEN k % 3 = 0 THEN 'null' WHEN k % 3 = 1 THEN '1.5' ELSE '{"a":1}' END, ',"Wide":', CASE WHEN k % 2 = 0 THEN '123456789012345678901' ELSE '7' END, CASE WHEN k % 4 = 0 THEN ',"Seldom":true' ELSE '' END, '}')"""


@_query(
    "value_type_audit",
    f"""{_ALERTS}, j AS (SELECT is_malicious, {_TYPED} AS raw FROM alerts), keys AS (SELECT unnest(['Code', 'Same', 'Mixed', 'Wide', 'Seldom']) AS key),
    typed AS (SELECT key, is_malicious, CASE json_type(raw, '$.' || key) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'HUGEINT' THEN 'int' ELSE json_type(raw, '$.' || key) END AS type, json_extract_string(raw, '$.' || key) AS v FROM j, keys),
    f AS (SELECT key, is_malicious, CASE WHEN v IS NULL OR type = 'NULL' THEN 'none' WHEN key = 'Wide' THEN 'int' ELSE type END AS type FROM typed),
    c AS (SELECT key, type, count(*) FILTER (is_malicious) AS m, count(*) FILTER (NOT is_malicious) AS b FROM f GROUP BY 1, 2)
    SELECT key, CAST(sum(m + b) AS BIGINT) AS n, round(sum(greatest(m, b)) / sum(m + b), 6) AS accuracy FROM c GROUP BY 1""",
)
def value_type_audit(spark, sf):
    raw = F.from_json(F.expr(_TYPED), "map<string,variant>", {"mode": "FAILFAST"})
    rows = views.alerts(spark, sf).select("is_malicious", F.transform_values(raw, lambda k, v: F.schema_of_variant(v)).alias("field_types"))
    return _rounded(audit.type_accuracy(rows).select("key", "n", "accuracy"))


@_query(
    "core_key_parity",
    f"""{_WITH_KV}, {_SHARED}, core AS (SELECT * FROM (VALUES (1, 'EventID'), (1, 'CaptureOnly'), (2, 'BaselineOnly'), (2, 'User'), (3, 'Image'), (4658, 'EventID')) AS t (event_code, key)),
    {_SIDES}, need AS (SELECT core.* FROM core JOIN events2 USING (event_code)), s AS (SELECT need.*, coalesce(m, false) AS m, coalesce(b, false) AS b FROM need LEFT JOIN sides USING (event_code, key))
    SELECT event_code, key, 'malicious' AS side FROM s WHERE NOT m UNION ALL SELECT event_code, key, 'benign' FROM s WHERE NOT b""",
)
def core_key_parity(spark, sf):
    core = {1: ["EventID", "CaptureOnly"], 2: ["BaselineOnly", "User"], 3: ["Image"], 4658: ["EventID"]}
    return leakage.missing_core_keys(views.alerts(spark, sf), core)


@_query("metric_bundle", f"{_VERDICTS}, c AS (SELECT policy, {_COUNTS} FROM long WHERE pred IS NOT NULL GROUP BY 1) SELECT policy, tp + fp + fn + tn AS n, tp, fp, fn, tn, {_MEASURES} FROM c")
def metric_bundle(spark, sf):
    return _rounded(evaluation.metric_bundle(_long(spark, sf), ["policy"]))


@_query("seeded_shuffle", f"{_ALERTS} SELECT row_number() OVER (ORDER BY md5(id || ':{SEED}'), id) - 1 AS ordinal, id FROM alerts")
def seeded_shuffle(spark, sf):
    return ordering.write_shuffled(views.alerts(spark, sf).select("id"), SEED, shared.new_path(spark, "shuffled"))


@_query("ordered_strata", f"{_ALERTS}, s AS (SELECT CAST(event_code AS VARCHAR) AS stratum, count(*) AS n FROM alerts GROUP BY 1) SELECT row_number() OVER (ORDER BY stratum) - 1 AS ordinal, stratum, n FROM s")
def ordered_strata(spark, sf):
    strata = views.alerts(spark, sf).groupBy(F.col("event_code").cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return ordering.write_ordered(strata, ["stratum"], shared.new_path(spark, "strata"))


@_query("first_for_repeats", f"{_ALERTS}, o AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':{SEED}'), id) AS r FROM alerts) SELECT id FROM o WHERE r <= 25")
def first_for_repeats(spark, sf):
    return experiments.first_rows(views.alerts(spark, sf).select("id"), 25, SEED)


_REPLICATES = 40
_POISSON = " + ".join(f"(u >= {b})::INTEGER" for b in significance.poisson_steps())


@_query(
    "poisson_bootstrap",
    f"""{_VERDICTS}, h AS (SELECT is_malicious, pred_conservative AS pred, CAST('0x' || substr(md5(id || ':{SEED}'), 1, 8) AS BIGINT) % {significance.PRIME} AS h FROM preds WHERE pred_conservative IS NOT NULL),
    a AS (SELECT *, (h + (r + 1) * 1000003) % {significance.PRIME} AS x FROM h, range({_REPLICATES}) AS t (r)), b AS (SELECT *, (x * x + h) % {significance.PRIME} AS y FROM a),
    c AS (SELECT *, (y * 48271 + r) % {significance.PRIME} AS z FROM b), d AS (SELECT *, ((z * z + h * 3) % {significance.PRIME}) * 16807 % {significance.PRIME} AS u FROM c), w AS (SELECT *, {_POISSON} AS w FROM d)
    SELECT r AS replicate, round(sum(w) FILTER (pred AND is_malicious) / sum(w) FILTER (pred), 6) AS value FROM w GROUP BY 1""",
)
def poisson_bootstrap(spark, sf):
    """Precision under resampled rows."""
    rows = _predictions(spark, sf).filter("pred_conservative IS NOT NULL")
    pred, hit = F.col("pred_conservative").cast("int"), (F.col("pred_conservative") & F.col("is_malicious")).cast("int")
    return _rounded(significance.poisson_bootstrap(rows, {"hits": hit, "preds": pred}, F.col("hits") / F.col("preds"), _REPLICATES, SEED))


@_query(
    "duplication_sketch",
    f"""{_RULES}, kv AS ({_KV}), f AS ({_VECTOR}), days AS (SELECT f.* EXCLUDE (id), a.user_id % 5 AS part FROM f JOIN alerts a ON a.id = f.id) SELECT count(*) AS n, true AS within_2_percent FROM days""",
)
def duplication_sketch(spark, sf):
    """Sketches of five parts, merged, against the exact number of distinct vectors."""
    rows = views.alerts(spark, sf)
    merged = corpus.merged_duplication(corpus.vector_sketch(rows.withColumn("part", F.col("user_id") % 5), ["part"]))
    exact = corpus.duplication(rows).select(F.col("distinct").alias("exact"))
    return merged.crossJoin(F.broadcast(exact)).select("n", (F.abs(F.col("distinct") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_2_percent"))  # one row each


@_query(
    "quota_repeated_ids",
    f"{_ALERTS}, s AS (SELECT event_code, count(*) AS n FROM alerts WHERE is_malicious GROUP BY 1), u AS (SELECT count(DISTINCT user_id % 7) AS ids FROM alerts WHERE is_malicious) SELECT event_code, least(n, 60) AS n FROM s",
)
def quota_repeated_ids(spark, sf):
    """Quotas hold where seven ids stand for all rows."""
    rows = views.alerts(spark, sf).filter("is_malicious").withColumn("few", (F.col("user_id") % 7).cast("string"))
    sizes = rows.groupBy("event_code").agg(F.count(F.lit(1)).alias("n")).withColumn("quota", F.least("n", F.lit(60)))
    return sampling.take_quota(rows, sizes, ["event_code"], SEED, "few").groupBy("event_code").agg(F.count(F.lit(1)).alias("n"))


@_query("resume_in_buckets", f"{_ALERTS} SELECT id FROM alerts WHERE CAST(event_id AS BIGINT) % 3 <> 0")
def resume_in_buckets(spark, sf):
    """What a log in buckets of ids has no verdict for."""
    rows = views.alerts(spark, sf)
    path = shared.new_path(spark, "verdict-log")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    scored = rows.filter("event_id % 3 = 0").select("id", F.lit("benign").alias("verdict"), F.lit(0.5).alias("confidence"), *[F.lit(None).cast(t).alias(n) for n, t in (("attack_technique", "string"), ("reasoning", "string"), ("key_indicators", "array<string>"))])
    incremental.create_log(spark, table, 8, path)
    incremental.append_to_log(scored, table, 8)
    return incremental.pending_in_log(rows.select("id"), table)


# --- significance and whole corpora, row by row -----------------------------

@_query(
    "mcnemar_by_event",
    f"""{_VERDICTS}, b AS (SELECT id, {_BLOB} AS blob FROM alerts), r AS (SELECT b.id, ({_PATTERN}) OR a.event_code = 10 AS rule FROM b JOIN alerts a ON a.id = b.id),
    j AS (SELECT event_code, pred_conservative = is_malicious AS a, rule = is_malicious AS b FROM preds JOIN r USING (id) WHERE pred_conservative IS NOT NULL),
    c AS (SELECT event_code, count(*) AS n, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM j GROUP BY 1),
    t AS (SELECT *, CASE WHEN b + c >= 25 THEN (abs(b - c) - 1.0) * (abs(b - c) - 1.0) / (b + c) END AS statistic FROM c),
    z AS (SELECT *, sqrt(statistic / 2) AS z FROM t),
    e AS (SELECT *, -- erfc by its series for small z and its continued fraction for large z
        CASE WHEN z < 2 THEN log10(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: power(-1, k) * power(z, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))))
             ELSE -z * z / ln(10) - log10(sqrt(pi())) - log10(list_reduce(list_prepend(z, list_reverse(range(1, 200))::DOUBLE[]), lambda f, k: z + (k / 2) / f)) END AS tail,
        least(0.0, log10(2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))))) AS exact FROM z)
    SELECT event_code, n, b, c, round(statistic, 6) AS statistic, round(CASE WHEN statistic IS NOT NULL THEN tail WHEN b + c = 0 THEN 0.0 ELSE exact END, 5) AS log10_p FROM e""",
)
def mcnemar_by_event(spark, sf):
    llm = _predictions(spark, sf).withColumn("pred", F.col("pred_conservative"))
    pairs = significance.paired(llm, scorers.rules(views.alerts(spark, sf)), by=["event_code"])
    tests = significance.mcnemar(pairs, ["event_code"])
    return tests.select("event_code", "n", "b", "c", F.round("statistic", 6).alias("statistic"), F.round("log10_p", 5).alias("log10_p"))


_ASSEMBLED = f"""{_ALERTS}, {_QUOTAS}, c AS (SELECT count(*) FILTER (is_malicious) AS m, count(*) FILTER (NOT is_malicious) AS b FROM capped),
    drawn AS (SELECT capped.*, row_number() OVER (PARTITION BY is_malicious ORDER BY md5(id || ':{SEED}'), id) AS place FROM capped)"""


@_query(
    "assemble_corpus_rows",
    f"""{_ASSEMBLED} SELECT d.id, d.is_malicious, 'host-' || substr(sha256(lower(split_part(source_host, '.', 1))), 1, 12) AS source_host,
    CAST(TIMESTAMP '2000-01-01' + (d.ts - min(d.ts) OVER (PARTITION BY d.is_malicious, d.source_capture_id)) AS VARCHAR)[1:19] AS moved
    FROM drawn d, c QUALIFY d.is_malicious OR d.place <= round_even(c.m * 0.25, 0)""",
)
def assemble_corpus_rows(spark, sf):
    """A corpus with a quarter as many benign rows, row by row."""
    rows = corpus.assemble_corpus(views.alerts(spark, sf), ratio=0.25, seed=SEED)
    return rows.select("id", "is_malicious", "source_host", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moved"))


_SYSTEMS = f"""{_EVAL}, {_VERDICTS[len(_ALERTS) + 1:]}, bl AS (SELECT s.*, {_BLOB} AS blob FROM sample s),
    systems AS (SELECT 'verdicts' AS system, p.id, p.is_malicious, p.event_type, p.pred_conservative AS pred FROM preds p SEMI JOIN sample USING (id)
        UNION ALL SELECT 'majority', id, is_malicious, event_type, false FROM sample
        UNION ALL SELECT 'random', id, is_malicious, event_type, {views.uniform_sql(f"id || ':{SEED}'", False)} < {RATE} FROM sample
        UNION ALL SELECT 'rules', id, is_malicious, event_type, ({_PATTERN}) OR event_code = 10 FROM bl)"""


def _systems(spark, sf) -> DataFrame:
    sample = sampling.eval_sample(views.alerts(spark, sf), "event_code")
    columns = ["system", "id", "is_malicious", "event_type", "pred_conservative"]
    out = evaluation.predictions_of_verdicts(sample, views.verdicts(spark, sf)).withColumn("system", F.lit("verdicts")).select(*columns)
    for name, scored in (("majority", scorers.majority(sample)), ("random", scorers.stratified_random(sample, RATE, SEED)), ("rules", scorers.rules(sample))):
        out = out.unionByName(scorers.as_predictions(scored, name).select(*columns))
    return out


@_query(
    "baseline_systems",
    f"""{_SYSTEMS}, c AS (SELECT system, event_type, {_COUNTS} FROM systems WHERE pred IS NOT NULL GROUP BY 1, 2) SELECT system, event_type, tp, fp, fn, tn, {_MEASURES} FROM c""",
)
def baseline_systems(spark, sf):
    """The verdicts and three baselines on one sample, by event type."""
    return _rounded(evaluation.metric_table(_systems(spark, sf), ["system", "event_type"], pred="pred_conservative"))


@_query(
    "significance_of_baselines",
    f"""{_SYSTEMS}, j AS (SELECT o.system, v.pred = v.is_malicious AS a, o.pred = o.is_malicious AS b FROM systems v JOIN systems o USING (id)
        WHERE v.system = 'verdicts' AND o.system <> 'verdicts' AND v.pred IS NOT NULL AND o.pred IS NOT NULL),
    c AS (SELECT system, count(*) AS n, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM j GROUP BY 1)
    SELECT *, round(CASE WHEN b + c >= 25 THEN (abs(b - c) - 1.0) * (abs(b - c) - 1.0) / (b + c) END, 6) AS statistic FROM c""",
)
def significance_of_baselines(spark, sf):
    """McNemar's test of the verdicts against each baseline that isn't fitted; ``mcnemar_by_event`` compares p-values too."""
    tests = experiments.significance_report(_systems(spark, sf))
    return tests.select("system", "n", "b", "c", F.round("statistic", 6).alias("statistic"))
