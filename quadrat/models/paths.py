"""Path analysis over a list of model equations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nulls import _col
from quadrat.functions.tails import chi2_p, normal_p
from quadrat.models.glm import fit, fit_least_squares
from quadrat.models.glmm import Fit, fit_many
from quadrat.models.spec import INTERCEPT, ModelSpec


def fit_paths(df: DataFrame, specs: Sequence[ModelSpec], **options) -> list[Fit]:
    """Fits in the order given. Gaussian equations without random intercepts share one scan, mixed ones their passes."""
    plain = [i for i, s in enumerate(specs) if s.family == "gaussian" and not s.groups]
    mixed = [i for i, s in enumerate(specs) if s.groups]
    found = dict(zip(plain, fit_least_squares(df, [specs[i] for i in plain]) if plain else []))
    if mixed:
        found |= dict(zip(mixed, fit_many([(df, specs[i]) for i in mixed], **options)))
    return [found[i] if i in found else fit(df, s, **options) for i, s in enumerate(specs)]


def path_coefs(df: DataFrame, specs: Sequence[ModelSpec], fits: Sequence[Fit] | None = None, **options) -> DataFrame:
    """One row per arrow: response, predictor, estimate, standard error, p, the estimate standardised by sd(x) / sd(y), and the
    R2 of its equation.

    The last two belong to gaussian equations without random intercepts; other equations have NULL there, except that numeric
    predictors of any gaussian equation are standardised.
    """
    fits = fit_paths(df, specs, **options) if fits is None else fits
    kinds = dict(df.dtypes)
    numeric = [
        c for s, m in zip(specs, fits) if m.spreads is None and s.family == "gaussian"
        for c in s.variables() if c not in s.groups and kinds[c] not in ("string", "boolean")
    ]
    sds = df.agg(*[F.stddev_samp(_col(c)).alias(c) for c in dict.fromkeys(numeric)]).first().asDict() if numeric else {}
    rows = []
    for spec, m in zip(specs, fits):
        for j, (term, b, se) in enumerate(zip(m.terms, m.beta, m.se)):
            if term == INTERCEPT:
                continue
            std = None
            if m.spreads is not None:
                std = float(b * m.spreads[j] / m.spreads[0]) if m.spreads[0] > 0 else None
            elif term in sds and spec.response in sds:
                std = float(b * sds[term] / sds[spec.response])
            rows.append((spec.response, term, float(b), float(se), normal_p(b / se) if se > 0 else None, std, m.r2))
    return df.sparkSession.createDataFrame(
        rows, "response string, predictor string, estimate double, std_error double, p_value double, std_estimate double, r2 double"
    )


def independence_claims(specs: Sequence[ModelSpec]) -> list[tuple[ModelSpec, str, list[str]]]:
    """Pairs of variables without an arrow that the model says are independent given their direct causes.

    The claim about (a, b), with b an equation's response, is tested by adding a to b's equation next to the
    direct causes of a. Where both are responses, the later one is tested.
    """
    equations = {s.response: s for s in specs}
    names = list(dict.fromkeys([c for s in specs for c in s.predictors()] + list(equations)))

    def above(v: str) -> set[str]:
        direct = equations[v].predictors() if v in equations else []
        return set(direct).union(*[above(d) for d in direct]) if direct else set()

    order = sorted(names, key=lambda v: (len(above(v)), names.index(v)))
    claims = []
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if b not in equations or a in equations[b].predictors():
                continue
            if a in equations and b in equations[a].predictors():
                continue
            given = [*equations[b].predictors(), *(equations[a].predictors() if a in equations else [])]
            claims.append((equations[b], a, [g for g in dict.fromkeys(given) if g not in (a, b)]))
    return claims


def _wald_p(tested: Fit, added: str, given: Sequence[str]) -> float:
    """Tail of the joint Wald test of a predictor: its own column, or the columns of all its levels if it is a factor."""
    hits = [i for i, t in enumerate(tested.terms) if t == added]
    longer = [g for g in given if g.startswith(added)]
    hits = hits or [i for i, t in enumerate(tested.terms) if t.startswith(added) and ":" not in t and not any(t.startswith(g) for g in longer)]
    beta, cov = np.asarray(tested.beta)[hits], np.asarray(tested.cov)[np.ix_(hits, hits)]
    return chi2_p(float(beta @ np.linalg.solve(cov, beta)), len(hits))


def path_summary(df: DataFrame, specs: Sequence[ModelSpec], fits: Sequence[Fit] | None = None, **options) -> DataFrame:
    """Fisher's C over the independence claims with its chi-square p, and the information criterion C + 2K."""
    claims = independence_claims(specs)
    tests = [replace(equation, terms=(*given, added)) for equation, added, given in claims]
    if fits is None:
        # Equations and claims together: they read the same rows.
        both = fit_paths(df, [*specs, *tests], **options)
        fits, tested = both[: len(specs)], both[len(specs):]
    else:
        tested = fit_paths(df, tests, **options)
    ps = [max(_wald_p(m, added, given), 1e-300) for m, (_, added, given) in zip(tested, claims)]
    c = -2.0 * sum(math.log(p) for p in ps)
    k = sum(m.k for m in fits)
    row = (len(ps), c, 2 * len(ps), chi2_p(c, 2 * len(ps)) if ps else 1.0, k, c + 2.0 * k)
    return df.sparkSession.createDataFrame(
        [row], "claims int, fisher_c double, df int, p_value double, k int, aic double"
    )


def indirect_effects(coefs: DataFrame, value: str = "estimate") -> DataFrame:
    """Products along two-step paths: predictor to middle to response."""
    a, b = coefs.alias("a"), coefs.alias("b")
    return a.join(b, F.col("a.response") == F.col("b.predictor")).select(
        F.col("a.predictor").alias("source"), F.col("a.response").alias("through"), F.col("b.response").alias("target"),
        (F.col(f"a.{value}") * F.col(f"b.{value}")).alias("indirect"),
    )
