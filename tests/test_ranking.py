import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from specgrade.functions.columns import seeded_hash
from specgrade.operators.ranking import exact_percentile, hash_rank, ordered_rank, top_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; one group key is null."""
    return spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 1000).alias("v"),
    )


def plain(df, order):
    group = W.partitionBy("g").orderBy(*order)
    return df.withColumn("r", F.row_number().over(group).cast("long")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("g")))


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_rank_equals_one_window(skewed, digits):
    got = hash_rank(skewed, "g", "id", 5, "r", "n", digits)
    hashed = skewed.withColumn("h", seeded_hash(5, F.col("id")))
    assert plain(hashed, ["h", "id"]).drop("h").exceptAll(got.select("id", "g", "v", "r", "n")).count() == 0
    assert got.count() == 3000


@pytest.mark.parametrize("lead", ["v", "cast(v as string)", "if(v % 3 = 0, null, v)", "date_add(date'2020-01-01', cast(v as int))"])
def test_ordered_rank_equals_one_window(skewed, lead):
    df = skewed.select("id", "g", F.expr(lead).alias("v"))
    got = ordered_rank(df, "g", "v", [F.col("id")], "r", "n", parts=9)
    assert got.count() == 3000
    assert plain(df, ["v", "id"]).exceptAll(got.select("id", "g", "v", "r", "n")).count() == 0


def test_rank_over_the_whole_table_and_constant_lead(spark):
    df = spark.range(500).withColumn("v", F.lit(1))
    out = ordered_rank(df, [], "v", [F.col("id")], "r", parts=20)
    assert out.count() == 500 and out.where(F.col("r") != F.col("id") + 1).count() == 0
    assert ordered_rank(df.limit(0), [], "v", [F.col("id")], "r").collect() == []


def test_percentiles_match_numpy(skewed):
    spec = {"a": ("v", 0.5), "b": ("v", 0.95)}
    values = {}
    for g, v in skewed.select("g", "v").collect():
        values.setdefault(g, []).append(v)
    got = {r["g"]: r for r in exact_percentile(skewed, "g", spec, parts=7).collect()}
    assert set(got) == set(values) and None in got
    for g, v in values.items():
        assert (got[g]["a"], got[g]["b"]) == (pytest.approx(np.percentile(v, 50)), pytest.approx(np.percentile(v, 95)))
    (row,) = exact_percentile(skewed, [], spec).collect()
    everything = sum(values.values(), [])
    assert (row["a"], row["b"]) == (pytest.approx(np.percentile(everything, 50)), pytest.approx(np.percentile(everything, 95)))


def test_top_per_group_limits_before_the_shuffle(skewed):
    top = top_per_group(skewed, "g", [F.col("v").desc(), F.col("id")], 2)
    plain = skewed.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.col("v").desc(), "id"))).where("rank <= 2")
    assert top.exceptAll(plain).count() == 0
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
