"""Every named query with a DuckDB text gives the same rows on the smallest driver tables."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import pytest

from karst.plans import named

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    import pandas as pd

    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@needs_data
@pytest.mark.parametrize("name", sorted(named.ORACLE))
def test_same_rows(spark, duck, name):
    got = named.QUERIES[name](spark, str(DATA)).toPandas()
    spark.catalog.clearCache()
    want = duck.execute(named.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    rows = lambda df: Counter(zip(*([plain(v) for v in df[c].tolist()] for c in columns), strict=True))
    assert rows(got) == rows(want)


@needs_data
def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(DATA)


@needs_data
def test_missing_packages_cost_only_the_llm_queries(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.split(".")[:2] == ["karst", "llm"] or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("karst.llm", raising=False)
    monkeypatch.setitem(sys.modules, "karst.llm.registry", None)
    with pytest.warns(UserWarning, match="no llm queries"):
        assert set(e.queries()) == set(named.QUERIES)
