import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Run SQL in DuckDB on the tables of a folder and compare its rows with a DataFrame's."""
    import duckdb

    def rows(pdf, columns):
        return sorted(map(tuple, pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()), key=repr)

    def check(df, sql, sf=SF):
        con = duckdb.connect()
        for path in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        ours, theirs = df.toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert rows(ours, columns) == rows(theirs, columns)

    return check
