"""The statistics behind the figures: box tables, straight-line fits with bands, and binned point layers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.tails import t_quantile_col
from quadrat.operators.joins import left_join_on
from quadrat.operators.quantiles import MAX_DISTINCT, exact_quantiles, value_counts

ALL = "all"


def _boxed(hist: DataFrame, by: Sequence[str], max_distinct: int) -> DataFrame:
    boxes = exact_quantiles(hist, by, [0.25, 0.5, 0.75], max_distinct)
    reach = (F.col("q2") - F.col("q0")) * 1.5
    return boxes.withColumns({"fence_lo": F.col("q0") - reach, "fence_hi": F.col("q2") + reach})


def _by_or_all(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("__all", F.lit(0)), ["__all"])


def box_stats(df: DataFrame, y: str, by: Sequence[str] = (), max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """Quartiles (type 7), whiskers to the most extreme value within 1.5 IQR, and the number beyond them.

    Rows are collapsed to distinct values first, so the second look at the data reads those counts only.
    """
    df, keys = _by_or_all(df, by)
    hist = value_counts(df, keys, y)
    joined = left_join_on(hist, _boxed(hist, keys, max_distinct), keys, salts=16)
    inside = F.col("y").between(F.col("fence_lo"), F.col("fence_hi"))
    return joined.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("q0").alias("q1"), F.max("q1").alias("median"), F.max("q2").alias("q3"),
        F.min(F.when(inside, F.col("y"))).alias("whisker_lo"), F.max(F.when(inside, F.col("y"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).alias("n_outliers"),
    ).drop("__all")


def box_outliers(df: DataFrame, y: str, by: Sequence[str] = (), max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """Values beyond the whiskers with their counts."""
    df, keys = _by_or_all(df, by)
    hist = value_counts(df, keys, y)
    joined = left_join_on(hist, _boxed(hist, keys, max_distinct), keys, salts=16)
    out = joined.where(~F.col("y").between(F.col("fence_lo"), F.col("fence_hi")))
    return out.select(*keys, F.col("y").alias("value"), F.col("cnt").alias("n")).drop("__all")


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line for every combination of the grouping columns, the rolled-up ones as ``all``.

    One aggregate with grouping sets serves all slices. Pairs with a missing value are left out; a group with
    constant x has no slope.
    """
    by = list(by)
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in by], F.col(x).cast("double").alias("x"),
                     F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    aggs = [
        F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
        F.regr_avgx("y", "x").alias("mean_x"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
    ]
    if not by:
        out = rows.agg(*aggs)
    else:
        sets = [[F.col(c) for c in combo] for r in range(len(by) + 1) for combo in combinations(by, r)]
        labels = [F.when(F.grouping(c) == 1, F.lit(ALL)).otherwise(F.col(c)).alias(f"__{c}") for c in by]
        out = rows.groupingSets(sets, *[F.col(c) for c in by]).agg(*labels, *aggs)
        out = out.select(*[F.col(f"__{c}").alias(c) for c in by], *[c for c in out.columns if c not in by and c[:2] != "__"])
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    sigma = F.when(F.col("n") > 2, F.sqrt(rss / F.nullif(F.col("n") - 2, F.lit(0))))
    return out.withColumn("sigma", sigma).withColumn("se_slope", F.try_divide("sigma", F.sqrt("sxx")))


def trend_band(trend: DataFrame, points: int = 80, level: float = 0.95) -> DataFrame:
    """Fitted line and its confidence band on an even grid over each group's x range."""
    keys = [c for c in trend.columns if c not in (
        "n", "slope", "intercept", "r2", "mean_x", "sxx", "syy", "sxy", "min_x", "max_x", "sigma", "se_slope")]
    lines = trend.where((F.col("n") > 2) & F.col("slope").isNotNull())
    lines = lines.withColumn("tq", t_quantile_col(0.5 + level / 2, F.col("n") - 2))
    grid = lines.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("min_x") + F.col("step") * (F.col("max_x") - F.col("min_x")) / F.lit(points - 1)
    grid = grid.withColumn("x", at).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    off = F.col("x") - F.col("mean_x")
    grid = grid.withColumn("se", F.col("sigma") * F.sqrt(F.lit(1.0) / F.col("n") + off * off / F.col("sxx")))
    return grid.select(
        *keys, "step", "x", "fit", "se", (F.col("fit") - F.col("tq") * F.col("se")).alias("lower"),
        (F.col("fit") + F.col("tq") * F.col("se")).alias("upper"),
    )


def point_layer(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Points of a scatter layer, equal points collapsed with their number."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        *by, F.col(x).alias("x"), F.col(y).alias("y")
    ).agg(F.count(F.lit(1)).alias("n"))
