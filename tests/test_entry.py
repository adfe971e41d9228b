"""Registry, and every query that has SQL against DuckDB on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def cells(rows, names):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 4) + 0.0
        return v

    return sorted([tuple(one(r[n]) for n in names) for r in rows], key=str)


from weftline.plans.queries import ORACLES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(ORACLES[name])
    names = sorted(want.columns)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    table = want.to_arrow_table().to_pylist() if hasattr(want, "to_arrow_table") else want.df().to_dict("records")
    assert cells([r.asDict() for r in df.collect()], names) == cells(table, names)


def test_stands_without_the_llm_package(tmp_path):
    """As the repository is after both folders and the pipeline are deleted."""
    import shutil

    here = os.path.dirname(entry.__file__)
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'top_degree' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.oracle_sql())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=False, env={**os.environ, "PYTHONPATH": ""}).returncode == 0
