"""Every registered query of the stylometry operators against its DuckDB twin, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomtext.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)[:10] if hasattr(v, "year") else str(v)


def bag(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name not in catalogue.oracle_sql():
        return
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lexicon_cover_reads_texts_once(spark):
    plan = catalogue.queries()["lexicon_cover"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
