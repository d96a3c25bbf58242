import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a DataFrame and a SQL text give the same columns and rows."""

    def check(df, sql):
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        expected = result.fetchall()
        assert sorted(df.columns) == sorted(names)
        mine, theirs = sorted(range(len(names)), key=lambda i: df.columns[i]), sorted(range(len(names)), key=lambda i: names[i])
        assert sorted("|".join(cell(r[i]) for i in mine) for r in df.collect()) == sorted("|".join(cell(r[i]) for i in theirs) for r in expected)

    return check
