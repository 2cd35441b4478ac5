import datetime
import glob
import os

import duckdb
import pandas as pd
import pytest

from cairnlake.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else str(round(v, 6))
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(v))
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str(v.tolist())
    return str(v)


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_plain(v) for v in row) for row in pdf.itertuples(index=False, name=None))


@pytest.fixture
def same_rows():
    def check(df, frame):
        a = df.toPandas()
        assert sorted(a.columns) == sorted(frame.columns)
        assert rows_of(a) == rows_of(frame)

    return check
