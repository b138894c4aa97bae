"""Every query with an oracle against DuckDB, on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from granary.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def cells(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else repr(float(x)) if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        pd.testing.assert_frame_equal(cells(got), cells(duck.sql(ORACLES[name]).df()))
    assert len(got) or name == "lineage_downstream"


def test_entry_without_the_llm_folder(tmp_path):
    """A copy without the subpackage still imports, with the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/granary", tmp_path / "granary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metric_by_area' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
