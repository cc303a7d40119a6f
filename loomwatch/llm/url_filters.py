"""URL filtering against dated lists: a temporal list join.

A list is a table of dated changes: an entry (a host or a parent domain, with a
path prefix) is added to a category or removed from it. Changes of an entry
become validity intervals, from a change to the next one. A capture of a page
is joined with the entries of its host and of every parent domain, as of the
time it was fetched: only intervals that hold that time count.

How it runs: built-in functions only. The join is on equality of the domain,
with the interval and the path as further conditions, so no pair of captures is
ever made and a change of the list costs one row. Each domain of the list
appears once per interval; a distinct (URL, time) makes as many rows as its host
has parent domains that are no deeper than the deepest of the list. If the list is small, Spark broadcasts it by
its own size check; if not, both sides are dealt by domain, and a host with a
third of all captures is a skewed key of that join, which adaptive execution
splits. The join back to captures is on URL and time.

Semantics: intervals are closed at the start and open at the end. Of changes of
an entry at the same time the removal wins. Repeated changes are one. A host is
compared in lower case without port, user and a trailing dot. Null or empty
URLs have no host and match nothing; a capture without a fetch time matches
nothing; list rows without domain, time or action are ignored. Repeated
captures each get a row. Other columns of the captures are kept by
``filter_captures``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.coalesce(F.regexp_replace(F.lower(bare), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a URL, '/' if it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)


def validity_intervals(changes: DataFrame) -> DataFrame:
    """(domain, path, category, valid_from, valid_to) from changes (domain, path, category, at, action)."""
    entry = ["domain", "path", "category"]
    known = changes.filter(F.col("domain").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    known = known.select(F.lower("domain").alias("domain"), F.coalesce("path", F.lit("/")).alias("path"), F.coalesce("category", F.lit("")).alias("category"), "at", "action")
    once = known.groupBy(*entry, "at").agg(F.max("action").alias("action"))  # 'remove' comes after 'add'
    later = Window.partitionBy(*entry).orderBy("at")
    spans = once.withColumn("valid_to", F.lead("at").over(later)).withColumnRenamed("at", "valid_from")
    return spans.filter(F.col("action") == "add").select(*entry, "valid_from", "valid_to")


def _domains(host: Column, levels: int) -> Column:
    """The host and its parent domains that have at most ``levels`` labels, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(n - levels, F.lit(0)), n - 1), lambda i: F.array_join(F.slice(labels, i + 1, n - i), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes)


def evaluate_captures(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(capture, host, matches, rule, category) for every capture; ``capture`` holds its columns.

    Whether a URL at a time is matched is found once for all captures that
    share both. ``rule`` is the longest matching domain with its path; the
    longer path and then the first category decide among entries of a domain.
    """
    intervals = validity_intervals(changes)
    levels = intervals.agg(F.max(F.size(F.split("domain", r"\."))).alias("n")).first()["n"] or 1
    rows = captures.select(F.struct("*").alias("capture"), F.col(url_col).alias("u"), F.col(time_col).alias("at"))
    asked = rows.select("u", "at").filter(F.col("u").isNotNull() & F.col("at").isNotNull()).distinct()
    keys = asked.withColumn("p", path_of(F.col("u"))).withColumn("domain", F.explode(_domains(host_of(F.col("u")), levels)))
    hits = (
        keys.join(intervals, "domain")
        .filter(F.col("p").startswith(F.col("path")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
        .select("u", "at", F.struct((-F.length("domain")).alias("d"), (-F.length("path")).alias("l"), "category", "domain", "path").alias("m"))
    )
    best = hits.groupBy("u", "at").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n"))
    return rows.join(best, ["u", "at"], "left").select(
        "capture",
        host_of(F.col("u")).alias("host"),
        F.coalesce("n", F.lit(0)).cast("long").alias("matches"),
        F.concat(F.col("m.domain"), F.col("m.path")).alias("rule"),
        F.col("m.category").alias("category"),
    )


def filter_captures(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures that no active entry matched, with all their columns."""
    return evaluate_captures(captures, changes, url_col, time_col).filter("matches = 0").select("capture.*")
