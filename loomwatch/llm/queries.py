"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.conversations import repair_report
from loomwatch.llm.decontaminate import decontamination_report
from loomwatch.llm.exact_dedup import exact_duplicates
from loomwatch.llm.langid import identify
from loomwatch.llm.licenses import license_report
from loomwatch.llm.lm_score import lm_scores
from loomwatch.llm.ngram_join import ngram_components
from loomwatch.llm.packing import pack_documents
from loomwatch.llm.pii import pii_report
from loomwatch.llm.quality import quality_scores
from loomwatch.llm.runs import run_report
from loomwatch.llm.secrets import secret_report
from loomwatch.llm.shared import documents
from loomwatch.llm.url_filters import evaluate_captures, host_of

#: Fixed list changes of op5: domain, path, category, day, action.
LIST_CHANGES = [
    ("spam-farm.example.org", "/", "spam", 0, "add"),
    ("cheap-pills.example.com", "/", "spam", 30, "add"),
    ("example.net", "/fr/", "region", 100, "add"),
    ("example.net", "/fr/", "region", 300, "remove"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a dated list derived from their hosts; a page's day of fetching comes from its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") % 365).cast("int"))
    mark = F.conv(F.substring(F.md5("domain"), 1, 4), 16, 10).cast("int")
    hosts = pages.select(host_of(F.col("url")).alias("domain")).filter("domain <> ''").distinct().withColumn("h", mark).filter("h % 10 < 3")
    entry = lambda day, action: F.struct((F.col("h") % 200 + day).alias("at"), F.lit(action).alias("action"))
    steps = F.array(
        entry(0, "add"),
        F.when(F.col("h") % 2 == 0, entry(60, "remove")),
        F.when(F.col("h") % 6 == 0, entry(120, "add")),
    )
    derived = hosts.select("domain", F.lit("/").alias("path"), F.lit("listed").alias("category"), F.explode(F.array_compact(steps)).alias("c")).select("domain", "path", "category", "c.at", "c.action")
    fixed = spark.createDataFrame(LIST_CHANGES, "domain string, path string, category string, at int, action string")
    found = evaluate_captures(captures, derived.unionByName(fixed), "url", "day")
    return found.select("capture.page_id", "host", "matches", "rule", "category", (F.col("matches") > 0).alias("blocked"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two snapshots that share a ledger: the second scans what the first hasn't seen."""
    return secret_report(documents(spark, sf_dir), batches=2)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(documents(spark, sf_dir))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_language_id": op4_language_id,
    "op5_url_filters": op5_url_filters,
    "op6_lm_score": op6_lm_score,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_secrets": op9_secrets,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality": op12_quality,
    "op13_conversation_repair": op13_conversation_repair,
}


def _over(*ways: tuple[str, str, str, str]) -> str:
    """SQL for the least (cost, edits) of some ways: state so far, cost, edit, what the repaired text gets."""
    return "list_min([" + ", ".join(f"{{'c': {s}.c + {c}, 'a': {s}.a || '{e}', 't': {s}.t || {t}}}" for s, c, e, t in ways) + "])"


def _row_step() -> str:
    """SQL that takes the four states ``i0`` to ``i3``, with insertions, over a row."""
    kept, role = "chr(10) || r.role || ':' || r.text", "chr(10) || '{}:' || r.text"
    never = "CASE WHEN r.gone OR r.initial <> '{}' THEN 1000000000 ELSE 0 END + 3 * r.cut::INT"
    forced = "CASE WHEN r.gone THEN 1000000000 ELSE 3 END + 3 * r.cut::INT"
    delete = lambda k: (f"i{k}", "4", "D", "''")
    keep = lambda k, initial: (f"i{k}", never.format(initial), "K", kept)
    rerole = lambda k, name: (f"i{k}", forced, "R", role.format(name))
    ways = [
        [delete(0)],
        [delete(1), keep(0, "s")],
        [delete(2), *(keep(k, "u") for k in (0, 1, 3)), *(rerole(k, "user") for k in (0, 1, 3))],
        [delete(3), keep(2, "a"), rerole(2, "assistant")],
    ]
    return ", ".join(f"{_over(*w)} AS s{k}" for k, w in enumerate(ways))


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

ORACLES: dict[str, str] = {
    "op5_url_filters": r"""
        WITH captures AS (
            SELECT page_id, url, CAST(page_id % 365 AS INTEGER) AS day,
                   regexp_replace(lower(regexp_replace(regexp_replace(
                       regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.$', '') AS host,
                   regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS raw_path
            FROM pages),
        hosts AS (
            SELECT host AS domain, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS h
            FROM (SELECT DISTINCT host FROM captures WHERE host <> '')),
        changes AS (
            SELECT domain, '/' AS path, 'listed' AS category, h % 200 AS since, 'add' AS action FROM hosts WHERE h % 10 < 3
            UNION ALL SELECT domain, '/', 'listed', h % 200 + 60, 'remove' FROM hosts WHERE h % 10 < 3 AND h % 2 = 0
            UNION ALL SELECT domain, '/', 'listed', h % 200 + 120, 'add' FROM hosts WHERE h % 10 < 3 AND h % 6 = 0
            UNION ALL SELECT * FROM (VALUES ('spam-farm.example.org', '/', 'spam', 0, 'add'),
                ('cheap-pills.example.com', '/', 'spam', 30, 'add'),
                ('example.net', '/fr/', 'region', 100, 'add'), ('example.net', '/fr/', 'region', 300, 'remove')) AS f (domain, path, category, since, action)),
        once AS (SELECT domain, path, category, since, max(action) AS action FROM changes GROUP BY ALL),
        spans AS (
            SELECT *, lead(since) OVER (PARTITION BY domain, path, category ORDER BY since) AS until FROM once),
        hits AS (
            SELECT c.page_id, s.domain || s.path AS rule, s.category,
                   row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC, length(s.path) DESC, s.category, s.domain, s.path) AS rank,
                   count(*) OVER (PARTITION BY c.page_id) AS matches
            FROM captures c JOIN spans s
              ON s.action = 'add' AND (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
             AND starts_with(CASE WHEN c.raw_path = '' THEN '/' ELSE c.raw_path END, s.path)
             AND c.day >= s.since AND (s.until IS NULL OR c.day < s.until))
        SELECT c.page_id, c.host, coalesce(h.matches, 0) AS matches, h.rule, h.category, h.matches IS NOT NULL AS blocked
        FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.rank = 1
    """,
    "op10_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
                     max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
              FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))
    """,
    "op13_conversation_repair": rf"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
            FROM conversations),
        faulty AS (  -- crc32 of the key, bit by bit
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT)),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 20 AS fault
            FROM keyed),
        damaged AS (
            SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM faulty, (VALUES (0), (1)) AS copies (copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
        marked AS (
            SELECT *, substr(role, 1, 1) AS initial, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare,
                   row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
        judged AS (
            SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS duplicate,
                   lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM marked),
        rows AS (
            SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM judged),
        counts AS (
            SELECT conv, max(i) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
                   count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
            FROM rows GROUP BY conv),
        walk AS (
            SELECT conv, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 1000000000, 'a': '', 't': ''}} AS s1,
                   {{'c': 1000000000, 'a': '', 't': ''}} AS s2, {{'c': 1000000000, 'a': '', 't': ''}} AS s3 FROM counts
            UNION ALL
            SELECT w.conv, r.i, {_row_step()}
            FROM (SELECT *, s0 AS i0, s1 AS i1, {_over(("s3", "0", "", "''"), ("i2", "3", "I", _ASSISTANT))} AS i3
                  FROM (SELECT *, {_over(("s2", "0", "", "''"), *((f"s{k}", "3", "I", _USER) for k in (0, 1, 3)))} AS i2 FROM walk)) w
            JOIN rows r USING (conv) WHERE r.i = w.i + 1),
        ended AS (
            SELECT conv, {_over(("s0", "0", "", "''"), ("s3", "0", "", "''"), ("s2", "3", "I", _ASSISTANT), ("s1", "6", "II", f"{_USER} || {_ASSISTANT}"))} AS best
            FROM walk JOIN counts USING (conv) WHERE i = n)
        SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, conv FROM keyed) k LEFT JOIN counts USING (conv) LEFT JOIN ended USING (conv)
    """,
}
