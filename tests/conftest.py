import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from taskspace.session import session

    s = session("tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture
def same_as_sql(spark, sf):
    """Holds a registered query against its SQL on the smallest tables."""
    import duckdb
    import pandas as pd

    from taskspace.plans import registry

    def check(name):
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.execute(registry.ORACLES[name]).df()
        got = registry.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        plain = lambda v: [plain(x) for x in v] if hasattr(v, "tolist") and getattr(v, "ndim", 0) or isinstance(v, list) else "" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v == v // 1 else str(v)
        rows = lambda f: sorted(repr([plain(v) for v in r]) for r in f.itertuples(index=False))
        assert len(got) and rows(got) == rows(want)

    return check
