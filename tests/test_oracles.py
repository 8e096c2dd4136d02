"""Every query that SQL can express, against DuckDB on the same tables."""

import math

import pandas as pd
import pytest

from scriptorium.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def value(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(value(x) if not hasattr(x, "item") else value(x.item()) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
