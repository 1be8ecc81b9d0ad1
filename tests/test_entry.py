"""The registered queries against DuckDB, the plans they make, and the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from loomfed.plans import catalogue
from loomfed.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    cell = lambda v: f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    cols = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert normal(got) == normal(want.project(cols).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 64


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["event_source"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in text
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0]


def test_element_wise_queries_need_no_exchange(spark):
    for name in catalogue.ELEMENTWISE:
        text = plan(catalogue.QUERIES[name](spark, SF))
        assert "Exchange" not in text and "Python" not in text, name


def test_the_library_does_without_the_optional_subpackage(tmp_path):
    """A copy without the folders of the optional part imports and lists its queries."""
    code = "import __spark_entry__ as e; n = e.queries(); assert 'fedavg' in n and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in n); e.oracle_sql()"
    skip = {".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"}
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in skip])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
    # one that is there but cannot be imported takes no other query with it
    (tmp_path / "r/loomfed/llm").mkdir()
    (tmp_path / "r/loomfed/llm/__init__.py").write_text("")
    (tmp_path / "r/loomfed/llm/queries.py").write_text("import a_module_that_is_not_there")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
