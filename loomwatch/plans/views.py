"""Alert-shaped views of the driver's tables, from SQL that Spark and DuckDB share but for two functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["EventID", "Channel", "CommandLine", "ParentCommandLine", "User", "TargetObject", "DestinationIp", "Keywords", "Opcode", "RecordNumber", "UtcTime", "CaptureOnly", "BaselineOnly", "Severity"]


def uniform_sql(text: str, spark: bool) -> str:
    return f"(conv(substr(md5({text}), 1, 8), 16, 10) / 4294967296D)" if spark else f"(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE)"


def alerts_sql(spark: bool, source: str = "events") -> str:
    k = "CAST(get_json_object(props, '$.k') AS INT)" if spark else "CAST(json_extract_string(props, '$.k') AS INT)"
    return f"""
    SELECT *,
        CAST(event_code AS STRING) AS "f_EventID",
        CASE WHEN user_id % 3 = 0 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN user_id % 3 = 1 THEN 'Security' END AS "f_Channel",
        CASE k % 6 WHEN 0 THEN 'powershell.exe -nop -enc AAAA' WHEN 1 THEN 'cmd.exe /c whoami /all' WHEN 2 THEN 'explorer.exe' WHEN 3 THEN '' WHEN 5 THEN 'svchost.exe -k netsvcs' END AS "f_CommandLine",
        CASE WHEN user_id % 4 = 0 THEN 'services.exe' END AS "f_ParentCommandLine",
        CASE user_id % 5 WHEN 0 THEN '-' WHEN 1 THEN 'alice' WHEN 2 THEN ' ' END AS "f_User",
        CASE WHEN k % 7 = 0 THEN 'HKLM/Run' END AS "f_TargetObject",
        CASE WHEN k % 9 = 0 THEN '10.0.0.1' END AS "f_DestinationIp",
        CASE WHEN is_malicious THEN '-9223372036854775808' ELSE ' 0x8000000000000000' END AS "f_Keywords",
        '0' AS "f_Opcode", CAST(event_id AS STRING) AS "f_RecordNumber",
        concat(CAST(CAST(ts AS DATE) AS STRING), ' 10:00:', lpad(CAST(k % 60 AS STRING), 2, '0'), '.288') AS "f_UtcTime",
        CASE WHEN is_malicious THEN '1' END AS "f_CaptureOnly",
        CASE WHEN NOT is_malicious THEN 'x' END AS "f_BaselineOnly",
        CASE WHEN is_malicious THEN 'INFO' END AS "f_Severity"
    FROM (
        SELECT event_id, concat('ev:', CAST(event_id AS STRING)) AS id, ts, event_type, user_id, value, k, value >= 80 AS is_malicious,
            CASE WHEN value >= 80 AND k % 10 = 0 THEN 4658 WHEN value < 80 AND k % 10 = 1 THEN 5447 ELSE CAST(floor(k * k / 1000.0) AS INT) END AS event_code,
            CASE WHEN value >= 80 THEN concat('cap-', CAST(user_id % 7 AS STRING)) ELSE 'base' END AS source_capture_id,
            CASE WHEN value >= 80 THEN 'captures' ELSE 'baseline' END AS source_dataset,
            CASE WHEN user_id % 2 = 0 THEN concat('WS', CAST(user_id % 5 AS STRING), '.lab.local') ELSE concat('WIN-', CAST(user_id % 3 AS STRING)) END AS source_host,
            CASE WHEN value >= 80 THEN CASE WHEN k % 13 = 0 THEN 'MULTI_TECHNIQUE_UNRESOLVED' ELSE concat('T10', CAST(10 + k % 10 AS STRING)) END END AS attack_technique,
            value >= 80 AND k % 13 = 0 AS technique_unresolved
        FROM (SELECT *, {k} AS k FROM {source}) AS e) AS a
    """


def verdicts_sql(spark: bool, source: str = "alerts") -> str:
    """Verdicts for alerts: three repeats, about one in a thousand unreadable; confidence of three values."""
    u = uniform_sql("concat(id, ':v')", spark)
    w = uniform_sql("concat(id, ':', CAST(r AS STRING))", spark)
    return f"""
    SELECT id, r AS repeat,
        CASE WHEN u < 0.001 THEN NULL
             WHEN w < 0.05 THEN 'suspicious'
             WHEN is_malicious THEN CASE WHEN u < 0.5 THEN 'malicious' WHEN u < 0.8 THEN 'suspicious' ELSE 'benign' END
             ELSE CASE WHEN u < 0.2 THEN 'malicious' WHEN u < 0.4 THEN 'suspicious' ELSE 'benign' END END AS verdict,
        CASE WHEN u < 0.001 THEN NULL ELSE CAST(0.75 + 0.1 * (CAST(floor(u * 1000) AS INT) % 3) AS DOUBLE) END AS confidence
    FROM (SELECT id, is_malicious, r, {u} AS u, {w} AS w
          FROM {source} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) AS n) AS x
    """


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: alert records with a map of fields."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    wide = spark.sql(alerts_sql(True, "{events}").replace('"', "`"), events=events)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"f_{k}").alias("value")) for k in KEYS])
    fields = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    return wide.withColumn("fields", fields).drop(*[f"f_{k}" for k in KEYS])


def verdicts(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """V3: a verdict for each alert, or three."""
    out = spark.sql(verdicts_sql(True, "{alerts}"), alerts=alerts(spark, sf_dir).select("id", "is_malicious"))
    return out if repeats else out.filter("repeat = 0").drop("repeat")


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: documents with their toxicity label as truth, and the text as a field."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("is_malicious"), F.col("lang").alias("stratum"), F.col("source").alias("source_capture_id"),
        F.lit("document").alias("event_type"), F.create_map(F.lit("CommandLine"), "text").alias("fields"),
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: order lines as scored records, for scale."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_returnflag") == "R").alias("is_malicious"), F.col("l_suppkey").alias("event_code"),
        F.col("l_discount").cast("double").alias("score"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("cap-"), (F.col("l_orderkey") % 50).cast("string")).alias("source_capture_id"),
    )
