"""Every registered query against its oracle in DuckDB, on the smallest tables."""

import glob
import importlib
import math
import os
import sys

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name not in registry.oracle_sql():
        assert got
        return
    rows = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert [names[k] for k in order] == cols
    assert sorted((tuple(plain(r[k]) for k in order) for r in rows.fetchall()), key=repr) == got


def test_entry_works_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__ as entry

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("millrace.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(name=name)

    saved = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith(("millrace.llm", "corpus_pipeline"))}
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    try:
        importlib.reload(entry)
        assert set(entry.queries()) == set(registry.queries())
        assert entry.entry(spark).count() > 0
    finally:
        sys.modules.update(saved)
