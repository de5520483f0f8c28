"""Every registered query against its SQL on the smallest supplied tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return db


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables are absent")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        out = compare(df, con.execute(SQL[name]))
        assert out.startswith("ok"), out
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert 0 <= row["accuracy"] <= 1
    # The families of the supplied vectors are fewer than five.
    assert row["num_classes_in_train"] < 5 and row["top5_accuracy"] is None
