"""Test statistics as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Two-sided 95% quantiles of Student's t for 1 to 30 degrees of freedom.
T_QUANTILE_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
NORMAL_975 = 1.959964


def t_quantile_975(df: Column) -> Column:
    """97.5% quantile of Student's t; beyond the table by the Cornish-Fisher series."""
    table = F.array(*[F.lit(q) for q in T_QUANTILE_975])
    z = NORMAL_975
    n = df.cast("double")
    tail = F.lit(z) + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n * n)
    return F.when(df <= len(T_QUANTILE_975), F.try_element_at(table, df.cast("int"))).otherwise(tail)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided sign test p-value for counts b and c."""
    n = (b + c).cast("double")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    low = F.least(b, c)
    steps = F.when(low > 0, F.sequence(F.lit(1), low.cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda acc: acc["total"])
    return F.least(F.lit(1.0), 2.0 * total * F.pow(F.lit(0.5), n))


def corrected_chi_square(b: Column, c: Column) -> Column:
    """McNemar statistic with continuity correction; null without discordant pairs."""
    n = b + c
    return F.when(n > 0, F.pow(F.abs(b - c) - 1, F.lit(2)).cast("double") / n)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(stat: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom. Runs on aggregated rows only."""
    return stat.map(lambda x: None if x is None or math.isnan(x) else math.erfc(math.sqrt(x / 2.0)))
