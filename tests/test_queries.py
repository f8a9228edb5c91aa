"""Every query that has SQL, against DuckDB on the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def data():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted([tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)], key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, data, name):
    got, want = entry.queries()[name](spark, data).toPandas(), duck.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_a_session():
    """The entry can be imported before Spark is started."""
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(entry.__file__).parent, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
