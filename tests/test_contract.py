import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from inkwell.plans import ink, tables, vision

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
NAMES = [*ink.catalogue.queries, *tables.catalogue.queries, *vision.catalogue.queries]


def test_every_sql_has_its_query():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and set(NAMES) <= set(queries)


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    modules = [".".join(p.relative_to(ROOT).with_suffix("").parts) for p in (ROOT / "inkwell").rglob("*.py") if "llm" not in p.parts and p.stem != "__init__"]
    code = f"import sys, importlib\nfor m in {modules}: importlib.import_module(m)\nassert not any(m.startswith('inkwell.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return "null"
    return repr(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else str(v)


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry_point.oracle_sql()])
def test_queries_match_sql(spark, database, name):
    a = entry_point.queries()[name](spark, DATA).toPandas()
    b = database.execute(entry_point.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[columns].itertuples(index=False))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in entry_point.oracle_sql()])
def test_other_queries_run(spark, name):
    assert entry_point.queries()[name](spark, DATA).count() > 0
