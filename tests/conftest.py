import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def agree(duck):
    """Checks a Spark result against SQL: the same columns and rows, in any order."""

    def run(df, sql):
        a, b = df.toPandas(), duck.sql(sql).df()
        names = sorted(a.columns)
        assert names == sorted(b.columns)
        rows = lambda x: sorted(map(tuple, x[names].astype(object).where(x[names].notna(), None).values.tolist()), key=repr)
        assert rows(a) == rows(b)

    return run
