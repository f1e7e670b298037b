"""Every registered query with a SQL twin must give the same rows as DuckDB."""

import numpy as np
import pandas as pd
import pytest

from dayweave.plans import registry

REWRITTEN = sorted(registry.ORACLES)


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 6) + 0.0)
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(zip(*[[text(v) for v in df[c]] for c in df.columns])) if len(df) else []


@pytest.mark.parametrize("name", REWRITTEN)
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_names_its_operators():
    assert all(registry.COVERS[n] for n in registry.QUERIES)
