"""Correlations: tests per group, matrices on complete cases, and the table behind a pairs plot."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nulls import safe_corr
from quadrat.functions.tails import Z_95, t_p_col
from quadrat.operators.joins import left_join_on

ALL = "all"


def _tested(df: DataFrame) -> DataFrame:
    """t and the Fisher interval for columns r and n; NULL where they are not defined.

    Points on a line give |r| = 1 up to rounding, so anything within 1e-12 of 1 counts as 1.
    """
    r, n = F.col("r"), F.col("n").cast("double")
    some, sure = n > 2, F.abs(r) < 1 - 1e-12
    t = F.when(some & sure, r * F.sqrt((n - 2) / (F.lit(1.0) - r * r)))
    wide = F.when((n > 3) & sure, F.lit(Z_95) / F.sqrt(n - 3))
    return df.withColumns({
        "t": t, "df": F.when(some, F.col("n") - 2),
        "lower": F.tanh(F.when(sure, F.atanh(r)) - wide), "upper": F.tanh(F.when(sure, F.atanh(r)) + wide),
    })


def with_p(df: DataFrame) -> DataFrame:
    """Add the Student t p-value to a result table; one value per result row."""
    return df.withColumn("p_value", t_p_col(F.col("t"), F.col("df")))


def cor_test(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation over complete pairs, with t, degrees of freedom and 95 % interval, per group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return _tested(both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias("r")))


def _pair_rows(df: DataFrame, by: Sequence[str], aggs: list[Column], pairs: list[tuple[str, str]]) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    one = df.groupBy(*by).agg(*aggs)
    return one.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")


def cor_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All pairwise correlations on the rows complete in every column; one aggregate, one row per pair."""
    pairs = list(combinations(cols, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.count(F.lit(1)).alias(f"n{i}"), safe_corr(a, b).alias(f"r{i}")]
    return _tested(_pair_rows(df.dropna(subset=list(cols)), by, aggs, pairs))


def pairs_table(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Pairwise complete correlations per group and overall (group ``all``), as one grouping-sets aggregate."""
    pairs = list(combinations(cols, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.count_if(both).alias(f"n{i}"), safe_corr(a, b).alias(f"r{i}")]
    group = F.when(F.grouping(by) == 1, F.lit(ALL)).otherwise(F.col(by).cast("string"))
    one = df.select(by, *cols).rollup(by).agg(group.alias("__group"), *aggs)
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    out = one.select(F.col("__group").alias(by), F.explode(F.array(*cells)).alias("c")).select(by, "c.*")
    return _tested(out)


def histogram(df: DataFrame, cols: Sequence[str], by: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of each column per group; the bounds are those of the column over all rows."""
    bounds = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in cols], *[F.max(c).cast("double").alias(f"hi_{c}") for c in cols]
    )
    ends = bounds.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in cols
    ])).alias("e")).select("e.*")
    long = df.select(by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("v")).select(by, "v.*").where(F.col("value").isNotNull())
    # Collapse equal values before the join with the one-row-per-column table of bounds.
    counted = long.groupBy(by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    joined = left_join_on(counted, ends, ["variable"], salts=16)
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * bins), F.lit(bins - 1)) + 1).otherwise(F.lit(1))
    return joined.groupBy(by, "variable", slot.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
