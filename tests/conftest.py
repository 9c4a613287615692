import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture
def same(spark, duck):
    """Holds a query against its SQL."""

    def run(query, sql):
        a, b = query(spark, SF).toPandas(), duck.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)

        def rows(d):
            return sorted(tuple("" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))

        x, y = rows(a), rows(b)
        assert len(x) == len(y)
        for p, q in zip(x, y):
            assert all(abs(u - v) < 2e-5 * max(1, abs(v)) if isinstance(u, float) and isinstance(v, float) else u == v for u, v in zip(p, q)), (p, q)

    return run
