import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs DuckDB SQL over the tables of a folder and returns (columns, rows)."""
    import os

    import duckdb

    def run(sf_dir, sql):
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
        got = con.execute(sql)
        return [c[0] for c in got.description], got.fetchall()

    return run
