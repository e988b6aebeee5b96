"""Model checks and comparison, each one aggregate over the scored rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nulls import safe_corr
from quadrat.functions.special import trigamma_value
from quadrat.functions.tails import chi2_p_col
from quadrat.models.families import next_count, row_terms, zero_probability
from quadrat.models.glm import fit_sums, score
from quadrat.models.glmm import Fit
from quadrat.operators.quantiles import exact_quantiles, value_counts

# Expected counts are worked out this many at a time, each block from its own first log-probability.
COUNT_BLOCK = 1024


def overdispersion(df: DataFrame, model: Fit) -> DataFrame:
    """Sum of squared Pearson residuals over the residual degrees of freedom, with its chi-square p."""
    one = score(df, model).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pearson") * F.col("pearson")).alias("chi2")
    )
    one = one.withColumn("df_resid", F.col("n") - F.lit(model.k)).withColumn("ratio", F.col("chi2") / F.col("df_resid"))
    return one.withColumn("p_value", chi2_p_col(F.col("chi2"), F.col("df_resid")))


def zero_inflation(df: DataFrame, model: Fit) -> DataFrame:
    """Observed zeros next to the number the model expects."""
    expected = zero_probability(model.spec.family, F.col("mu"), model.dispersion)
    one = score(df, model).agg(
        F.count_if(F.col(model.spec.response) == 0).alias("observed"), F.sum(expected).alias("expected")
    )
    return one.withColumn("ratio", F.try_divide(F.col("expected"), F.col("observed").cast("double")))


def residual_table(df: DataFrame, model: Fit, bins: int = 10) -> DataFrame:
    """Fitted mean and residuals by fitted-quantile bin."""
    scored = score(df, model).withColumn("mu", F.round("mu", 12))
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(value_counts(scored, [], "mu"), [], probs).first()
    steps = [F.when(F.col("mu") > F.lit(edges[f"q{i}"]), 1).otherwise(0) for i in range(len(probs))]
    slot = F.lit(1)
    for s in steps:
        slot = slot + s
    return scored.withColumn("bin", slot).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mu").alias("mean_fitted"), F.avg("resid").alias("mean_resid"),
        F.sqrt(F.avg(F.col("pearson") * F.col("pearson"))).alias("rms_pearson"),
    )


def count_frequencies(df: DataFrame, model: Fit, upto: int | None = None) -> DataFrame:
    """Observed and expected number of rows per count, and in a last row (``above``) of all higher counts.

    Counts go from 0 to ``upto``, or to the largest count observed. The row ``above`` is numbered one higher, and both columns add up
    to the number of rows. Rows with the same linear predictor are collapsed. Each then gives one vector per block of counts, whose
    log-probabilities follow from the block's first by the family's recurrence; the vectors are summed.
    """
    scored = score(df, model)
    response = F.col(model.spec.response)
    if upto is None:
        upto = int(scored.agg(F.max(response)).first()[0] or 0)
    eta = scored.groupBy(F.round("eta", 12).alias("eta")).agg(F.count(F.lit(1)).cast("double").alias("rows"))
    blocks = F.sequence(F.lit(0), F.lit(upto), F.lit(COUNT_BLOCK))
    grid = eta.withColumn("start", F.explode(blocks)).withColumn("y", F.col("start").cast("double"))
    for step in row_terms(model.spec.family, math.log(model.dispersion) if model.dispersion else 0.0):
        grid = grid.withColumns({k: F.expr(v) for k, v in step.items()})
    log_step = next_count(model.spec.family, model.dispersion)
    ends = F.sequence(F.lit(1), F.lit(min(COUNT_BLOCK, upto + 1) - 1)) if upto else F.array().cast("array<int>")
    logs = F.aggregate(
        ends, F.array("loglik"), lambda done, k: F.concat(done, F.array(F.element_at(done, -1) + log_step(F.col("eta"), F.col("y") + k)))
    )
    vectors = grid.select("start", "rows", array_to_vector(F.transform(logs, F.exp)).alias("p"))
    # A mean of vectors is what the summarizer merges stably; times the rows it is their sum.
    summed = vectors.groupBy("start").agg(
        Summarizer.mean(F.col("p"), F.col("rows")).alias("p"), F.sum("rows").alias("rows")
    )
    expected = summed.select("start", "rows", F.posexplode(vector_to_array("p"))).select(
        (F.col("start") + F.col("pos")).alias("count"), (F.col("rows") * F.col("col")).alias("expected")
    ).where(F.col("count") <= upto)
    observed = scored.groupBy(response.cast("int").alias("count")).agg(F.count(F.lit(1)).alias("observed"))
    within = expected.join(observed, "count", "left").select(
        "count", F.lit(False).alias("above"), F.coalesce("observed", F.lit(0)).alias("observed"), "expected"
    )
    left = scored.select(F.lit(1).alias("observed"), F.lit(1.0).alias("expected")).union(within.select(-F.col("observed"), -F.col("expected")))
    return within.union(left.agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected")).select(
        F.lit(upto + 1).alias("count"), F.lit(True).alias("above"), "observed", "expected"
    ))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation from the inverse of the correlation matrix; the matrix comes from one aggregate."""
    rows = df.select(*cols).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    one = rows.agg(*[safe_corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    corr = np.eye(len(cols))
    for i, j in pairs:
        corr[i, j] = corr[j, i] = one[f"r{i}_{j}"]
    values = np.diag(np.linalg.inv(corr))
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(cols, values)], "term string, vif double"
    )


def compare_models(df: DataFrame, fits: dict[str, Fit], null_fit: Fit | None = None) -> DataFrame:
    """Criteria, Akaike weights, R2, RMSE and a score in [0, 1] per model, mixed or not, best first; one scan serves all models.

    The score is the mean of the weights, the R2 values and the reversed RMSE after scaling each to [0, 1].
    """
    spark = df.sparkSession
    sums = dict(zip(fits, fit_sums(df, list(fits.values())), strict=True))
    r2 = {name: _shares(m, sums[name], "lognormal", null_fit) for name, m in fits.items()}
    names = list(fits)

    def weights(values: list[float]) -> list[float]:
        low = min(values)
        raw = [math.exp(-0.5 * (v - low)) for v in values]
        return [v / sum(raw) for v in raw]

    def scaled(values: list[float]) -> list[float]:
        low, high = min(values), max(values)
        return [1.0 if high == low else (v - low) / (high - low) for v in values]

    crit = {c: [getattr(fits[n], c) for n in names] for c in ("aic", "aicc", "bic")}
    wts = {c: weights(v) for c, v in crit.items()}
    marks = [scaled(v) for v in wts.values()] + [scaled([-sums[n]["rmse"] for n in names])]
    marks += [scaled([r2[n][i] for n in names]) for i in (0, 1)]
    rows = [
        (n, fits[n].k, *[float(crit[c][i]) for c in crit], *[float(wts[c][i]) for c in wts], r2[n][0], r2[n][1],
         float(sums[n]["rmse"]), float(np.mean([m[i] for m in marks])))
        for i, n in enumerate(names)
    ]
    schema = (
        "model string, k int, aic double, aicc double, bic double, aic_wt double, aicc_wt double, bic_wt double, "
        "r2_marginal double, r2_conditional double, rmse double, score double"
    )
    return spark.createDataFrame(rows, schema).orderBy(F.col("score").desc(), "model")


def _shares(model: Fit, sums: dict[str, float], method: str, null_fit: Fit | None) -> tuple[float, float]:
    var_f, lam = sums["fixed_var"], sums["mean"]
    var_r = sum(s * s for s in model.sds)
    if null_fit is not None:
        lam = math.exp(null_fit.beta[0] + 0.5 * sum(s * s for s in null_fit.sds))
    disp = model.dispersion
    if model.spec.family == "gaussian":
        var_d = disp * disp
    else:
        spread = {"poisson": lambda: 1.0 / lam, "nb2": lambda: 1.0 / lam + 1.0 / disp, "nb1": lambda: (1.0 + disp) / lam}
        ratio = spread[model.spec.family]()
        var_d = {
            "delta": lambda: ratio, "lognormal": lambda: math.log1p(ratio), "trigamma": lambda: trigamma_value(1.0 / ratio),
        }[method]()
    total = var_f + var_r + var_d
    return var_f / total, (var_f + var_r) / total


def r2_nakagawa(
    df: DataFrame, model: Fit, methods: Sequence[str] = ("delta", "lognormal", "trigamma"), null_fit: Fit | None = None
) -> DataFrame:
    """Marginal and conditional R2 per choice of the observation-level variance.

    The expected count in that variance is the mean response, or, with ``null_fit``, the null model's mean.
    """
    (sums,) = fit_sums(df, [model])
    rows = [(m, *_shares(model, sums, m, null_fit)) for m in methods]
    return df.sparkSession.createDataFrame(rows, "method string, r2_marginal double, r2_conditional double")
