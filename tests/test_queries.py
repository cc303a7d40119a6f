import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwatch.plans import queries as base
from loomwatch.plans import views

SF = "/root/testdata/sf0.001"
#: a held-out sample of full size takes every benign row of the smallest tables
LARGER = {"leakage_safe_split": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_same_rows_as_sql(spark, compare, name):
    sf = LARGER.get(name, SF)
    compare(base.QUERIES[name](spark, sf), base.ORACLES[name], sf)


def test_nothing_left_to_fit_on(spark):
    with pytest.raises(ValueError, match="nothing left to fit on"):
        base.QUERIES["leakage_safe_split"](spark, SF)


@pytest.mark.parametrize("name", ["mcnemar_p", "paired_bootstrap", "unpaired_bootstrap", "score_batch"])
def test_rows_only(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_mcnemar_by_event_pairs_all_events(spark):
    """Every event with a readable verdict is in a group, in the query and in its SQL."""
    readable = views.verdicts(spark, SF).filter("verdict IS NOT NULL").count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert con.sql(f"SELECT sum(n) FROM ({base.ORACLES['mcnemar_by_event']})").fetchall()[0][0] == readable
    assert base.QUERIES["mcnemar_by_event"](spark, SF).agg(F.sum("n")).first()[0] == readable


def test_mcnemar_by_event_without_user_or_code(spark, tmp_path):
    """Events without a user are paired too, and those without a code are a group."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    user, props = F.when(F.col("event_id") % 7 != 0, F.col("user_id")), F.when(F.col("event_id") % 13 != 0, F.col("props"))
    events.withColumns({"user_id": user, "props": props}).write.parquet(f"{tmp_path}/events.parquet")
    n = {r["event_code"]: r["n"] for r in base.QUERIES["mcnemar_by_event"](spark, str(tmp_path)).collect()}
    readable = views.verdicts(spark, str(tmp_path)).filter("verdict IS NOT NULL")
    assert n[None] == readable.filter("CAST(substr(id, 4) AS BIGINT) % 13 = 0").count()
    assert sum(n.values()) == readable.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(base.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
