import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{root / 'checkpoints'}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet' if_dir)".replace("/*.parquet' if_dir", "/*.parquet'" if os.path.isdir(p) else "'"))
    return db


def canonical(rows):
    """Rows as a sorted list, floats to nine digits."""

    def one(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int | float):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture
def same(spark, sf, duck):
    def check(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        got = canonical(df.select(*[f"`{c}`" for c in names]).collect())
        rel = duck.sql(sql)
        assert sorted(rel.columns) == names
        order = [rel.columns.index(c) for c in names]
        assert got == canonical([tuple(r[i] for i in order) for r in rel.fetchall()])

    return check
