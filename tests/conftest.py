import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foliarc.session import build_session

    s = build_session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def same_rows(left, right):
    """Whether two pandas frames hold the same rows, whatever their order."""
    import pandas as pd

    def norm(x):
        if x is None or pd.isna(x):
            return "null"
        return repr(float(x) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    assert sorted(left.columns) == sorted(right.columns)
    cols = sorted(left.columns)
    rows = [sorted(tuple(map(norm, r)) for r in d[cols].astype(object).itertuples(index=False, name=None)) for d in (left, right)]
    return rows[0] == rows[1]


@pytest.fixture
def same():
    return same_rows
