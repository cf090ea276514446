"""Every registered query of the core runs, and gives what its SQL gives."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillstone.plans import registered
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, duck, name):
    df = registered.QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    assert df.columns
    if name not in registered.SQL:
        return
    found = duck.execute(registered.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in rows)
    assert got == want


def test_entry_runs_without_the_optional_part(spark):
    import __spark_entry__

    assert set(registered.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["tag", "n"]


def test_no_module_of_the_core_names_the_optional_part():
    root = Path(os.path.dirname(registered.__file__)).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillstone.llm" not in p.read_text()
