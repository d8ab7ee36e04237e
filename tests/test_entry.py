import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_core_does_not_import_llm():
    code = "import sys, clausework.plans, clausework.streaming.journal, clausework.sources.files; sys.exit(any('clausework.llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


@pytest.mark.skipif(not DATA.exists() or importlib.util.find_spec("duckdb") is None, reason="no test tables here")
@pytest.mark.parametrize("name", ["r03_bm25_topk", "a08_status_pivot", "j12_iou_dedup", "p3_found", "star_revenue"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = entry.queries()[name](spark, str(DATA))
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=key)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
