import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from relevance_spark.session import local_session, ship_package

    s = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("OFF")
    return ship_package(s)


@pytest.fixture(scope="session")
def data():
    return DATA


def rows_of(frame):
    """Rows as sorted tuples, columns by name, floats at six decimals."""
    cols = sorted(frame.columns)

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return ""
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return f"{float(x):.5f}"
        return str(x).removesuffix(" 00:00:00")

    return cols, sorted(tuple(plain(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def compare(spark, data):
    """Runs a query and its SQL on the same tables."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")

    def run(query, sql):
        got = query(spark, data).toPandas()
        if sql is None:
            assert len(got)
            return
        assert rows_of(got) == rows_of(con.sql(sql).df())

    return run
