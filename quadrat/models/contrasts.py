"""Rates by cell, their ratios within a stratum, and marginal means of a fitted model."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.tails import Z_95, normal_p_col
from quadrat.models.glmm import Fit
from quadrat.models.spec import INTERCEPT


def adjusted_rates(df: DataFrame, count: str, exposure: str, by: Sequence[str]) -> DataFrame:
    """Rate per unit of exposure and cell with a Wald interval on the log scale.

    These are the fitted rates of the Poisson model that has one parameter per cell. A cell without a
    single count has rate 0 and no interval.
    """
    rows = df.select(*by, count, exposure).dropna()
    cells = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(count).cast("double").alias("total"),
        F.sum(F.col(exposure).cast("double")).alias("exposure"),
    )
    some = F.col("total") > 0
    cells = cells.withColumn("rate", F.col("total") / F.col("exposure"))
    cells = cells.withColumn("se_log", F.when(some, F.lit(1.0) / F.sqrt(F.col("total"))))
    return cells.withColumns({
        "lower": F.col("rate") * F.exp(F.lit(-Z_95) * F.col("se_log")),
        "upper": F.col("rate") * F.exp(F.lit(Z_95) * F.col("se_log")),
    })


def rate_ratios(rates: DataFrame, within: Sequence[str], level: str) -> DataFrame:
    """Ratio of the rates of two levels in the same stratum, with standard error of its log, z and p.

    A stratum with a cell without counts stays: its ratio is 0 or NULL, and error, z and p are NULL.
    """
    a, b = rates.alias("a"), rates.alias("b")
    on = [F.col(f"a.{w}") == F.col(f"b.{w}") for w in within] + [F.col(f"a.{level}") < F.col(f"b.{level}")]
    usable = (F.col("a.total") > 0) & (F.col("b.total") > 0)
    out = a.join(b, on).select(
        *[F.col(f"a.{w}").alias(w) for w in within], F.col(f"a.{level}").alias("level_a"), F.col(f"b.{level}").alias("level_b"),
        F.try_divide("a.rate", "b.rate").alias("ratio"),
        F.when(usable, F.sqrt(F.lit(1.0) / F.col("a.total") + F.lit(1.0) / F.col("b.total"))).alias("se_log"),
    )
    out = out.withColumn("z", F.when(F.col("ratio") > 0, F.ln("ratio")) / F.col("se_log"))
    return out.withColumn("p_value", normal_p_col(F.col("z")))


def _rows_of(model: Fit, by: Sequence[str], cell: Sequence) -> np.ndarray:
    """Design row of a cell: listed factors at their level, other factors averaged with equal weight.

    Numeric predictors must be centred, so that 0 is their mean.
    """
    factors = {c: list(v) for c, v in model.spec.factors.items() if v and c in model.spec.predictors()}
    fixed = dict(zip(by, cell))
    others = [c for c in factors if c not in fixed]
    rows = []
    for combo in product(*[factors[c] for c in others]):
        at = {**fixed, **dict(zip(others, combo))}
        row = []
        for term in model.terms:
            value = 1.0
            for part in ([] if term == INTERCEPT else term.split(":")):
                hits = [c for c in factors for lev in factors[c] if part == f"{c}{lev}" and at[c] == lev]
                value *= 1.0 if hits else 0.0
            row.append(value)
        rows.append(row)
    return np.mean(rows, axis=0)


def marginal_means(df: DataFrame, model: Fit, by: Sequence[str]) -> DataFrame:
    """Means per cell on the response scale at exposure 1, with Wald intervals, from any fitted model."""
    rows = []
    for cell in product(*[model.spec.factors[c] for c in by]):
        x = _rows_of(model, by, cell)
        eta, se = float(x @ model.beta), float(math.sqrt(x @ model.cov @ x))
        rows.append((*[str(v) for v in cell], math.exp(eta), se, math.exp(eta - Z_95 * se), math.exp(eta + Z_95 * se)))
    names = ", ".join(f"{c} string" for c in by)
    return df.sparkSession.createDataFrame(rows, f"{names}, rate double, se_log double, lower double, upper double")


def marginal_ratios(df: DataFrame, model: Fit, within: Sequence[str], level: str) -> DataFrame:
    """Ratios between the levels of one factor in each stratum, with the covariance of the two means."""
    rows = []
    levels = list(model.spec.factors[level])
    for cell in product(*[model.spec.factors[c] for c in within]):
        for i, a in enumerate(levels):
            for b in levels[i + 1:]:
                x = _rows_of(model, [*within, level], [*cell, a]) - _rows_of(model, [*within, level], [*cell, b])
                est, se = float(x @ model.beta), float(math.sqrt(x @ model.cov @ x))
                rows.append((*[str(v) for v in cell], str(a), str(b), math.exp(est), se, est / se))
    names = "".join(f"{c} string, " for c in within)
    out = df.sparkSession.createDataFrame(
        rows, f"{names}level_a string, level_b string, ratio double, se_log double, z double"
    )
    return out.withColumn("p_value", normal_p_col(F.col("z")))
