import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


def duck(sf_dir: str = SF):
    import duckdb

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def rows_of(frame):
    """Rows of a pandas frame as sortable text, columns by name."""
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    return sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


def same_as_sql(df, sql, sf_dir: str = SF):
    got, want = df.toPandas(), duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
