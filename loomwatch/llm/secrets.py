"""Secret scanning over an incremental blob ledger.

Every version of a file is content-addressed by the SHA-256 of its text. The
ledger, a table in the shared folder, has a row for each (blob, rule version)
that was scanned, with its findings; a run scans only pairs that the ledger
lacks, appends them, and joins findings back to every path (document) of a blob.
A new rule version scans every blob anew and leaves older findings in place.

How it runs: built-in functions only. Distinct texts are found by grouping on
the text, which folds copies before the shuffle; the ledger and the join back
carry digests and findings, not texts. A hot blob is a skewed key of that join
alone, which adaptive execution splits.

Spans are code-point offsets, end exclusive. They come from two built-ins that
agree on leftmost non-overlapping matches: the pieces that ``split`` leaves and
the matches of ``regexp_extract_all``.

Nulls and ties: null text is the empty blob, which has no findings. Rows that
repeat an id or a text each get a row with their blob's findings. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.shared import new_path
from loomwatch.llm.spans import count_kind, digest, joined, spans_of

#: Fixed rules of the base, in the order in which kinds are listed: kind, pattern, group and least length of it.
BASE_RULES = [
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, r"(?i)password|passwd|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, None),
]

#: Further rules: kind, pattern, group and least length of it, cheap test.
MORE_RULES = [
    ("bearer", r"(?i)\bbearer\x20+([A-Za-z0-9._~+/=-]{16,})", 1, 16, "(?i)bearer"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, "eyJ"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, "PRIVATE KEY"),
    ("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 15, "gh[pousr]_|xox[abprs]-|sk_live_|AIza"),
    ("url", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s:/@]{3,128})@", 1, 3, "://"),
]

RULES_VERSION = 1
_FIELDS = "array<struct<kind:int,start:int,end:int>>"
_LEDGER = f"blob string, rules int, base {_FIELDS}, more {_FIELDS}"


def findings(text: Column, rules: list, first_kind: int = 0) -> Column:
    """An array of (kind, start, end), kind being the place of a rule in the list."""
    parts = [spans_of(text, pattern, first_kind + k, group, least, None, test) for k, (_, pattern, group, least, test) in enumerate(rules)]
    return F.concat(*parts)


def _scan(blobs: DataFrame) -> DataFrame:
    base = F.array_sort(findings(F.col("t"), BASE_RULES), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    more = findings(F.col("t"), MORE_RULES, len(BASE_RULES))
    return blobs.select(
        "blob",
        F.lit(RULES_VERSION).alias("rules"),
        base.cast(_FIELDS).alias("base"),
        more.cast(_FIELDS).alias("more"),
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, batches: int = 1) -> DataFrame:
    """One row per document: blob, and the findings of that blob (``base``, ``more``).

    ``ledger`` is the path of a ledger that this run appends to; it is made if
    it isn't there, and None starts a new one in the shared folder. With several
    ``batches`` the documents go through the ledger one part after another, as
    successive snapshots would: a lost run repeats the part that it was in.
    """
    spark = docs.sparkSession
    path = ledger or new_path(spark, "secret-ledger")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spark.createDataFrame([], _LEDGER).write.mode("ignore").parquet(path)

    def entries() -> DataFrame:  # an entry that two runs or a retry have appended counts once
        return spark.read.schema(_LEDGER).parquet(path).filter(F.col("rules") == RULES_VERSION).dropDuplicates(["blob"])

    for k in range(batches):
        mine = docs.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(batches)) == k) if batches > 1 else docs
        blobs = mine.select(text.alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        blobs = blobs.withColumn("blob", F.sha2("t", 256)).join(entries().select("blob"), "blob", "left_anti")
        _scan(blobs).write.mode("append").parquet(path)
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob"))
    return paths.join(entries().drop("rules"), "blob")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, batches: int = 1) -> DataFrame:
    """One row per document: doc_id, counts of base kinds, base_sha256, spans."""
    kinds = [r[0] for r in BASE_RULES]
    names = F.array(*[F.lit(r[0]) for r in BASE_RULES + MORE_RULES])
    found = scan_secrets(docs, id_col, text_col, ledger, batches)
    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    everything = F.array_sort(F.concat("base", "more"), by_start)
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(kinds)],
        digest(joined(F.col("base"), names)).alias("base_sha256"),
        joined(everything, names).alias("spans"),
    )
