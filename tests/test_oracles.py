"""Every registered graph query against its DuckDB text on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from noema.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.isna(x):
            return None
        return f"{x:.6g}" if isinstance(x, float) else str(int(x)) if not isinstance(x, str) and not hasattr(x, "year") else str(x)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
