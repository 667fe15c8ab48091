import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallygrid.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    """A value that compares across engines."""
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    ours = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
