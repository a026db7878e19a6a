import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from vecstrand.session import session

    s = session(cpus=4, shuffle=4, app="tests", memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _text(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(map(_text, v)) + "]"
    if v is None:
        return "null"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v):.6g}"
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(_text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Whether a query's rows are those of its SQL."""

    def check(query, sql):
        df = query(spark, data)
        cur = duck.execute(sql)
        names, rows = [c[0] for c in cur.description], cur.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(names, rows)

    return check
