import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        p = f"{data}/{f}"
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows_of(frame, columns):
    """Rows as comparable tuples, in any order."""
    out = []
    for r in frame[columns].itertuples(index=False):
        out.append(tuple("~" if v is None or v != v else (round(float(v), 6) if isinstance(v, float) else str(v)) for v in r))
    return sorted(out, key=str)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(fn, sql):
        a, b = fn(spark, data).toPandas(), duck.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        assert rows_of(a, cols) == rows_of(b, cols)

    return check
