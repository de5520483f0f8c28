"""The registered corpus queries: against SQL where there is some, and the pipeline stage by stage."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import corpus_pipeline as pipeline  # noqa: E402
from check import TABLES, compare  # noqa: E402
from specgrade.llm import pii  # noqa: E402
from specgrade.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from specgrade.session import materialise  # noqa: E402
from test_similar import brute  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    out = compare(QUERIES[name](spark, FOLDER), db.execute(ORACLE_SQL[name]))
    assert out.startswith("ok"), out


def test_pipeline(spark):
    from fractions import Fraction

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 3").select(F.col("doc_id") + 10**6, "text", "lang", "source", "n_chars"))
    docs = docs.union(spark.createDataFrame([(10**7, None, None, None, None), (10**7 + 1, "12 34", "en", "src1", 5)], docs.schema))
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], FOLDER), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    before, named, single, clean, mixed, packed = [k.collect() for k in kept]
    assert {r.doc_id for r in before} - {r.doc_id for r in named} == {10**7, 10**7 + 1}
    groups = brute([(r.doc_id, r.text) for r in named], 5, Fraction(4, 5))
    assert sorted(r.doc_id for r in single) == sorted({c for _, c in groups.values()})
    assert {r.doc_id for r in clean} == {r.doc_id for r in single}
    assert kept[3].where(F.length("text") != F.col("n_chars")).count() == 0
    left = pii.summary(kept[3]).agg(F.sum("n_email"), F.sum("n_ip"), F.sum("n_phone"), F.sum("n_card")).first()
    assert tuple(left) == (0, 0, 0, 0)
    assert {r.doc_id for r in mixed} == {r.doc_id for r in clean} and len(mixed) > len(clean)
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    assert sum(r.piece == 0 for r in packed) == len(mixed)
