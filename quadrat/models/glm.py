"""Count-rate models without random intercepts, and result tables of any fit."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.tails import normal_p
from quadrat.models.families import mean_of, num, row_terms, variance_of
from quadrat.models.glmm import Fit, fit_glmm, variance_components
from quadrat.models.spec import (
    COEF_SCHEMA,
    ModelSpec,
    complete,
    design,
    levels_of,
    linear_predictor,
    log_offset,
    model_rows,
    with_levels,
)
from quadrat.operators.joins import left_join_on


def fit_glm(df: DataFrame, spec: ModelSpec) -> Fit:
    """Generalised linear model with log exposure offset.

    Poisson and gaussian go through MLlib on the collapsed rows, with the frequency as weight; the covariance
    and the log-likelihood come from one more aggregate. The negative binomial families, which MLlib lacks,
    are the mixed model's special case without levels.
    """
    if spec.groups:
        raise ValueError("use fit_glmm for random intercepts")
    if spec.family not in ("poisson", "gaussian"):
        return fit_glmm(df, spec)
    spec = with_levels(df, spec)
    terms = [name for name, _ in design(spec)]
    p = len(terms)
    rows = model_rows(df, spec).persist()
    try:
        data = VectorAssembler(inputCols=[f"x{j}" for j in range(1, p)], outputCol="features").transform(rows)
        model = GeneralizedLinearRegression(
            family=spec.family, link="log" if spec.family == "poisson" else "identity", labelCol="y",
            offsetCol="off", weightCol="n", tol=1e-12, maxIter=100, regParam=0.0,
        ).fit(data)
        beta = np.array([model.intercept, *model.coefficients])
        eta = " + ".join(["off", *[f"x{j}*{num(b)}" for j, b in enumerate(beta)]])
        at = rows.selectExpr("*", f"{eta} AS eta")
        log_disp, disp = 0.0, None
        if spec.family == "gaussian":
            rss, n = at.selectExpr("sum(n*(y - eta)*(y - eta))", "sum(n)").first()
            disp = math.sqrt(rss / n)
            log_disp = math.log(disp)
        for step in row_terms(spec.family, log_disp):
            at = at.withColumns({k: F.expr(v) for k, v in step.items()})
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = at.selectExpr(
            "sum(n) AS n", "sum(n*loglik) AS ll", *[f"sum(n*weight*x{i}*x{j}) AS h{i}_{j}" for i, j in pairs]
        ).first()
    finally:
        rows.unpersist()
    info = np.zeros((p, p))
    for i, j in pairs:
        info[i, j] = info[j, i] = sums[f"h{i}_{j}"]
    return Fit(spec, terms, beta, np.linalg.inv(info), sums["ll"], int(round(sums["n"])), (), disp)


def fit_least_squares(df: DataFrame, specs: Sequence[ModelSpec]) -> list[Fit]:
    """All gaussian models without random intercepts in one scan.

    One aggregate gives the count, means and covariances of the columns of every model over the rows complete in it; models on the
    same rows share them. The equations are then solved on the driver from these small matrices. Centred sums keep their digits
    where the mean is large next to the spread; the product of such a column with a factor is nearly collinear with the factor and
    loses them, as in any normal equations, so centre it first.
    """
    kinds = dict(df.dtypes)
    specs = levels_of(df, specs)
    names: dict[tuple, str] = {}
    parts: list[Column] = []

    def part(value: Column, *key) -> str:
        """Name of an aggregate, added once per key."""
        if key not in names:
            names[key] = f"a{len(names)}"
            parts.append(value.alias(names[key]))
        return names[key]

    def there(c: str) -> Column:
        return F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))

    layouts = []
    for spec in specs:
        rows = tuple(sorted(spec.variables()))
        whole = reduce(lambda a, b: a & b, [there(c) for c in rows])
        y = (f"{spec.response} less log {spec.offset}", F.col(spec.response).cast("double") - log_offset(spec))
        if not spec.offset:
            y = (spec.response, F.col(spec.response).cast("double"))
        cols = [(name, F.when(whole, c)) for name, c in [y, *design(spec)[1:]]]
        n = part(F.count_if(whole), rows, "n")
        means = [part(F.avg(c), rows, name) for name, c in cols]
        pairs = {
            (i, j): part(F.covar_pop(c, d), rows, *sorted((name, other)), "pair")
            for i, (name, c) in enumerate(cols) for j, (other, d) in enumerate(cols[: i + 1])
        }
        layouts.append((spec, n, means, pairs))
    one = df.agg(*parts).first()
    solved = []
    for spec, n, means, pairs in layouts:
        count = one[n]
        if count <= len(means):
            raise ValueError(f"{count} complete rows for {len(means)} coefficients of {spec.response}")
        mean = np.array([one[m] for m in means])
        s = np.zeros((len(mean), len(mean)))
        for (i, j), name in pairs.items():
            s[i, j] = s[j, i] = one[name] * count
        sxx, sxy, syy = s[1:, 1:], s[1:, 0], s[0, 0]
        inverse = np.linalg.inv(sxx) if len(sxx) else sxx
        slopes = inverse @ sxy
        rss = max(float(syy - slopes @ sxy), 0.0)
        cov = np.zeros((len(mean), len(mean)))
        cov[1:, 1:] = inverse
        cov[0, 1:] = cov[1:, 0] = -mean[1:] @ inverse
        cov[0, 0] = 1.0 / count + mean[1:] @ inverse @ mean[1:]
        solved.append((spec, count, np.array([mean[0] - slopes @ mean[1:], *slopes]), cov, rss, s))
    fits = []
    for spec, count, beta, cov, rss, s in solved:
        # Where next to nothing is left over, the difference has lost its digits: the residuals are summed from the rows.
        rss = _residual_sum(df, spec, beta) if rss <= 1e-6 * s[0, 0] else rss
        disp = math.sqrt(rss / count)
        loglik = -0.5 * count * (math.log(2.0 * math.pi * disp * disp) + 1.0) if disp > 0 else math.inf
        fits.append(Fit(
            spec, [t for t, _ in design(spec)], beta, cov * disp * disp, loglik, count, (), disp,
            r2=float(1.0 - rss / s[0, 0]) if s[0, 0] > 0 else None, spreads=np.sqrt(np.diag(s) / (count - 1)),
        ))
    return fits


def _residual_sum(df: DataFrame, spec: ModelSpec, beta: np.ndarray) -> float:
    left = F.col(spec.response).cast("double") - log_offset(spec) - linear_predictor(spec, beta)
    return complete(df, spec).agg(F.sum(left * left)).first()[0]


def fit(df: DataFrame, spec: ModelSpec, **options) -> Fit:
    return fit_glmm(df, spec, **options) if spec.groups else fit_glm(df, spec)


def coef_rows(model: Fit, name: str) -> list[tuple]:
    out = []
    for term, b, se in zip(model.terms, model.beta, model.se):
        z = float(b / se) if se > 0 else None
        out.append((name, term, float(b), float(se), z, None if z is None else normal_p(z), model.converged, model.full_hessian))
    return out


def coef_table(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """Estimate, standard error, z and p per term and model, with what is to be known of the fit."""
    return spark.createDataFrame([r for name, m in fits.items() for r in coef_rows(m, name)], COEF_SCHEMA)


FIT_SCHEMA = (
    "model string, family string, n long, k int, loglik double, aic double, aicc double, bic double, "
    "dispersion double, converged boolean"
)


def fit_table(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """Log-likelihood and information criteria side by side."""
    rows = [
        (name, m.spec.family, m.n, m.k, float(m.loglik), float(m.aic), float(m.aicc), float(m.bic), m.dispersion, m.converged)
        for name, m in fits.items()
    ]
    return spark.createDataFrame(rows, FIT_SCHEMA)


def variance_table(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """Variance of each random intercept; one at its lower bound is 0 and marked."""
    rows = [(name, path, float(v), at, m.converged) for name, m in fits.items() for path, v, at in variance_components(m)]
    return spark.createDataFrame(rows, "model string, path string, variance double, at_bound boolean, converged boolean")


def with_eta(rows: DataFrame, model: Fit, fixed: str = "fixed", eta: str = "eta") -> DataFrame:
    """The fixed part and the linear predictor as two more columns. A path without an estimated intercept counts as 0."""
    spec = model.spec
    rows = rows.withColumn(fixed, linear_predictor(spec, model.beta))
    if model.effects is None:
        return rows.withColumn(eta, F.col(fixed) + log_offset(spec))
    depth = len(spec.groups)
    effects = model.effects.select(
        *[F.col(g).alias(f"__g{k}") for k, g in enumerate(spec.groups)],
        F.expr(" + ".join(f"b{k}" for k in range(1, depth + 1))).alias("__random"),
    )
    rows = rows.withColumns({f"__k{k}": F.col(g).cast(T.StringType()) for k, g in enumerate(spec.groups)})
    rows = left_join_on(rows, effects, {f"__k{k}": f"__g{k}" for k in range(depth)})
    rows = rows.withColumn(eta, F.col(fixed) + log_offset(spec) + F.coalesce(F.col("__random"), F.lit(0.0)))
    return rows.drop("__random", *[f"__k{k}" for k in range(depth)])


def score(df: DataFrame, model: Fit) -> DataFrame:
    """Complete rows with ``fixed`` (fixed part), ``eta``, fitted mean ``mu``, residual and Pearson residual."""
    spec = model.spec
    rows = with_eta(complete(df, spec), model)
    rows = rows.withColumn("mu", mean_of(spec.family, F.col("eta")))
    return rows.withColumns({
        "resid": F.col(spec.response) - F.col("mu"),
        "pearson": (F.col(spec.response) - F.col("mu")) / F.sqrt(variance_of(spec.family, F.col("mu"), model.dispersion)),
    })


def fit_sums(df: DataFrame, models: Sequence[Fit]) -> list[dict[str, float]]:
    """Per model the variance of its fixed part, the mean response and the root mean squared residual, over the rows complete in it.

    One scan and one aggregate for all models; a mixed model's intercepts are joined to the rows of that scan.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*sorted({c for m in models for c in m.spec.variables()}))
    parts: list[Column] = []
    for i, m in enumerate(models):
        rows = with_eta(rows, m, f"__fixed{i}", f"__eta{i}")
        whole = reduce(lambda a, b: a & b, [
            F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)) for c in m.spec.variables()
        ])
        y = F.col(m.spec.response).cast("double")
        resid = F.when(whole, y - mean_of(m.spec.family, F.col(f"__eta{i}")))
        parts += [
            F.var_pop(F.when(whole, F.col(f"__fixed{i}"))).alias(f"v{i}"), F.avg(F.when(whole, y)).alias(f"m{i}"),
            F.sqrt(F.avg(resid * resid)).alias(f"r{i}"),
        ]
    one = rows.agg(*parts).first()
    return [{"fixed_var": one[f"v{i}"], "mean": one[f"m{i}"], "rmse": one[f"r{i}"]} for i in range(len(models))]
