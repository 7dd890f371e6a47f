"""Every core query with SQL gives the same rows in Spark and DuckDB on the smallest tables; the entry works without the text subpackage."""

import glob
import math
import os
import subprocess
import sys

import pytest

from lodestone import plans

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    wanted = oracle.sql(plans.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in wanted.fetchall()), key=str)


def test_entry_without_the_text_subpackage():
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('lodestone.llm'):\n"
        "            raise ModuleNotFoundError(name, name='lodestone.llm')\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'undercut' in e.queries() and 'p4_found' in e.queries() and 'p8_ids' not in e.queries()\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_but_the_subpackage_imports_it():
    for path in glob.glob(f"{ROOT}/lodestone/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "lodestone.llm" not in open(path).read(), path
