import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from support import DATA, TABLES, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    path = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = path + os.pathsep + os.environ.get("PYTHONPATH", "")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query and its oracle agree at the smallest size."""

    def run(query, sql):
        mine = query(spark, DATA)
        other = duck.sql(sql)
        assert sorted(mine.columns) == sorted(other.columns)
        assert rows_of(mine.columns, mine.collect()) == rows_of(other.columns, other.fetchall())

    return run
