"""Closed forms for the models without random intercepts, a dense evaluation for those with them."""

import itertools
import math
import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat import catalog
from quadrat.models import association, contrasts, diagnostics, figures, glm, paths
from quadrat.models.glm import coef_table, fit_glm, fit_sums, fit_table, score, variance_table
from quadrat.models import glmm
from quadrat.models.glmm import Batch, Fit, fit_glmm, fit_many
from quadrat.models.spec import INTERCEPT, ModelSpec, complete, crossed, design, with_levels
from quadrat.plans.registry import PATH_MODELS, QUESTION_1, QUESTION_2, fit_registry

NESTED = "site string, transect string, subplot string, treatment string, period string, area_m2 double, z double, y int, w double"


def _rows():
    rng = np.random.default_rng(1)
    out = []
    for a in range(3):
        ba = rng.normal() * 0.5
        for b in range(3):
            bb = rng.normal() * 0.4
            for c in range(4):
                bc = rng.normal() * 0.5
                for v in range(6):
                    treat, per, area = "thinned" if b % 2 else "control", "early" if v < 3 else "late", 3.0 if c % 2 else 5.0
                    eta = 0.2 + 0.4 * (b % 2) - 0.5 * (v >= 3) + math.log(area) + ba + bb + bc
                    y = int(rng.poisson(math.exp(eta) * rng.gamma(3.0) / 3.0))
                    out.append((f"s{a}", f"t{b}", f"u{c}", treat, per, area, float(rng.normal()), y, float(eta + rng.normal() * 0.3)))
    return out


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame(_rows(), NESTED).coalesce(2).cache()


def test_design_codes_levels_alphabetically(nested):
    spec = with_levels(nested, ModelSpec("y", crossed("treatment", "period"), "area_m2"))
    assert [n for n, _ in design(spec)] == [INTERCEPT, "treatmentthinned", "periodlate", "treatmentthinned:periodlate"]


def test_missing_values_leave_the_fit(make):
    df = make([(1, 1.0, "a"), (None, 1.0, "a"), (2, None, "b"), (3, 2.0, None)], "y int, x double, g string")
    assert complete(df, ModelSpec("y", ("x",), groups=("g",))).count() == 1


def test_poisson_closed_form(nested):
    rows = _rows()
    m = fit_glm(nested, ModelSpec("y", ("treatment",), "area_m2"))
    total = {t: sum(r[7] for r in rows if r[3] == t) for t in ("control", "thinned")}
    area = {t: sum(r[5] for r in rows if r[3] == t) for t in total}
    rate = {t: total[t] / area[t] for t in total}
    assert m.beta == pytest.approx([math.log(rate["control"]), math.log(rate["thinned"] / rate["control"])], abs=1e-9)
    assert m.se == pytest.approx([total["control"] ** -0.5, (1 / total["control"] + 1 / total["thinned"]) ** 0.5], rel=1e-8)
    mu = [rate[r[3]] * r[5] for r in rows]
    loglik = sum(r[7] * math.log(u) - u - math.lgamma(r[7] + 1) for r, u in zip(rows, mu))
    assert m.loglik == pytest.approx(loglik, abs=1e-7) and m.aic == pytest.approx(4 - 2 * loglik, abs=1e-6)
    over = diagnostics.overdispersion(nested, m).first()
    chi2 = sum((r[7] - u) ** 2 / u for r, u in zip(rows, mu))
    assert over["chi2"] == pytest.approx(chi2) and over["p_value"] < 1e-6 and over["df_resid"] == len(rows) - 2


def test_gaussian_line(nested):
    x, y = np.array([r[6] for r in _rows()]), np.array([r[8] for r in _rows()])
    m = fit_glm(nested, ModelSpec("w", ("z",), family="gaussian"))
    assert m.beta == pytest.approx(np.polyfit(x, y, 1)[::-1], abs=1e-9)
    trend = figures.linear_trend(nested, "z", "w").first()
    assert trend["slope"] == pytest.approx(m.beta[1])
    band = figures.trend_band(figures.linear_trend(nested, "z", "w"), 3).collect()
    assert all(r["lower"] < r["fit"] < r["upper"] for r in band)
    assert band[1]["se"] < band[0]["se"]


def _dense(batch, theta, family, number=0):
    """Laplace objective from full matrices, derivatives by differences: an independent evaluation."""
    model = batch.models[number]
    rows = batch.scaled.where(f"m = {number}").toPandas()
    p, depth, above = model.p, model.levels, batch.levels - model.levels
    x, off, y, n = rows[[f"x{j}" for j in range(p)]].values, rows.off.values, rows.y.values, rows.n.values
    blocks = []
    for k in range(1, depth + 1):
        path = rows[[f"g{q + above}" for q in range(1, k + 1)]].apply(tuple, axis=1)
        names = {v: i for i, v in enumerate(sorted(set(path)))}
        z = np.zeros((len(rows), len(names)))
        z[np.arange(len(rows)), [names[v] for v in path]] = 1
        blocks.append(z)
    z = np.hstack(blocks)
    sd = np.concatenate([np.full(b.shape[1], theta[p + k]) for k, b in enumerate(blocks)])
    lg = np.vectorize(math.lgamma)

    def loglik(eta):
        if family == "poisson":
            return y * eta - np.exp(eta) - lg(y + 1)
        if family == "nb2":
            t, mu = math.exp(theta[-1]), np.exp(eta)
            return lg(y + t) - math.lgamma(t) - lg(y + 1) + t * math.log(t) + y * eta - (y + t) * np.log(t + mu)
        if family == "nb1":
            f = math.exp(theta[-1])
            r = np.exp(eta) / f
            return lg(y + r) - lg(r) - lg(y + 1) + y * math.log(f / (1 + f)) - r * math.log1p(f)
        s = math.exp(theta[-1])
        return -theta[-1] - 0.5 * math.log(2 * math.pi) - (y - eta) ** 2 / (2 * s * s)

    def curve(eta, h):
        return -(loglik(eta + h) - 2 * loglik(eta) + loglik(eta - h)) / h / h

    b = np.zeros(z.shape[1])
    for _ in range(80):
        eta = x @ theta[:p] + off + z @ b
        slope = (loglik(eta + 1e-5) - loglik(eta - 1e-5)) / 2e-5
        h = z.T @ ((n * curve(eta, 1e-3))[:, None] * z) + np.diag(1 / sd**2)
        step = np.linalg.solve(h, z.T @ (n * slope) - b / sd**2)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    eta = x @ theta[:p] + off + z @ b
    h = z.T @ ((n * curve(eta, 1e-3))[:, None] * z) + np.diag(1 / sd**2)
    return (n * loglik(eta)).sum() - 0.5 * (b * b / sd**2).sum() - np.log(sd).sum() - 0.5 * np.linalg.slogdet(h)[1]


def _hill(value, top=(0.1, 0.2, 0.9)):
    """A batch of one model without rows, whose log-likelihood is ``value(theta, allowed step of the intercepts)``."""
    batch = Batch.__new__(Batch)
    batch.models = [glmm.Model(0, ModelSpec("y", ("z",), groups=("site",), family="poisson"))]
    batch.models[0].standardise({"n": 600_000, "m1": 0.0, "v1": 1.0, "my": 1.0, "vy": 2.0, "exposure": 600_000, "off": 0.0})
    info = np.diag([6e5, 6e5, 10.0])
    top = np.array(top)
    batch.evaluate = lambda asked, tol: {
        k: [glmm.Point(t, value(t, tol[k]) - 0.5 * (t - top) @ info @ (t - top), info @ (top - t), 1.5 * info, None) for t in thetas]
        for k, thetas in asked.items()
    }
    return batch, top


def test_fit_ends_though_many_leaves_share_a_small_error_of_the_intercepts(spark):
    """The log determinant may be off by half the last step per leaf; 60,000 leaves must not hide what a step gains."""
    sign = itertools.chain([1.0], itertools.repeat(-1.0))  # too high at the start, too low near the top
    batch, top = _hill(lambda theta, step: -6e5 + next(sign) * 0.5 * 60_000 * step, (0.02, 0.02, 0.5))
    point, converged, _, cov, full = batch.run("hessian", 60, 1e-5)[0]
    assert converged is True and full
    assert point.theta == pytest.approx(top, abs=2e-3)
    assert np.diag(cov) == pytest.approx([1 / 6e5] * 2, rel=1e-6)


def test_dispersion_that_rises_to_its_bound_gets_there_in_few_steps(spark):
    """A response that is constant within its leaves: the slope in the log of the residual sd stays as it is up to the bound."""
    model = glmm.Model(0, ModelSpec("w", ("z",), groups=("site",), family="gaussian"))
    model.standardise({"n": 8000, "m1": 0.0, "v1": 1.0, "my": 50.0, "vy": 36.0, "exposure": 8000, "off": 0.0})
    info, top = np.diag([8e3, 8e3, 10.0, 32e3]), np.array([49.0, 0.5, 5.0])

    def at(theta):
        away = (theta[:3] - top) * np.diag(info)[:3]
        return glmm.Point(theta, -0.5 * away @ (theta[:3] - top) - 8e3 * theta[-1], np.array([*-away, -8e3]), info, None)

    ascent, evaluations = model.maximise(), 0
    asked = next(ascent)
    with pytest.raises(StopIteration) as stop:
        while True:
            evaluations += len(asked)
            asked = ascent.send([at(theta) for theta in asked])
    point, converged, _ = stop.value.value
    assert converged and point.theta[:3] == pytest.approx(top, abs=1e-3)
    assert point.theta[-1] == pytest.approx(glmm.LOG_DISPERSION_BOUNDS[0] + math.log(6.0))
    assert evaluations <= 12  # 37 with steps that stay as long as the information says


@pytest.mark.parametrize("family", ["poisson", "nb2", "gaussian"])
def test_levels_of_one_task_and_joined_ones_agree(nested, monkeypatch, family):
    response, offset = ("w", None) if family == "gaussian" else ("y", "area_m2")
    found = []
    for few, hot in ((glmm.FEW_NODES, glmm.HOT_ROWS), (10, 7), (0, glmm.HOT_ROWS)):
        monkeypatch.setattr(glmm, "FEW_NODES", few)
        batch = Batch([(nested, ModelSpec(response, ("treatment", "z"), offset, ("site", "transect", "subplot"), family))], hot)
        start = batch.models[0].start()
        found.append((batch._top(2), batch.evaluate({0: [start, start + 0.05]}, {0: 1e-8})[0]))
        batch.close()
    assert [top for top, _ in found][::2] == [3, 0] and found[1][0] < 3
    for _, points in found[1:]:
        for one, other in zip(found[0][1], points, strict=True):
            assert other.value == pytest.approx(one.value, abs=1e-8) and other.grad == pytest.approx(one.grad, abs=1e-6)


def test_poisson_passes_read_sums_per_leaf_in_one_task(nested):
    """The rows are read once a theta; few leaves go through a pass without an exchange."""
    batch = Batch([(nested, ModelSpec("y", ("treatment", "z"), "area_m2", ("site", "transect", "subplot"), "poisson"))])
    par = batch._parameters({0: [batch.models[0].start()]})
    state = batch.scratch.keep(batch._leaf_sums(batch.state.join(F.broadcast(par.select("m", "t")), "m"), par, 1))
    plan = batch._newton_step(state, par)._jdf.queryExecution().executedPlan().toString()
    batch.close()
    assert "Generate inline" in plan and "Exchange hashpartitioning" not in plan and "scratch_" not in plan


def test_families_are_fitted_side_by_side(nested, monkeypatch):
    """Each waits for the other one to begin."""
    begun = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(glmm.Batch, "run", lambda self, *rest: begun.wait() and [] or [])
    monkeypatch.setattr(glmm.Batch, "__init__", lambda self, jobs, hot_rows: self.__dict__.update(models=[]))
    monkeypatch.setattr(glmm.Batch, "close", lambda self: None)
    specs = [ModelSpec("y", ("z",), None, (), "poisson"), ModelSpec("w", ("z",), None, (), "gaussian")]
    with pytest.raises(ValueError, match="shorter"):  # nothing is fitted here
        fit_many([(nested, spec) for spec in specs])


def test_fit_without_a_way_up_is_returned_as_not_converged(spark):
    """Gradient and value contradict each other: a row says so, in a type that a table takes."""
    tries = itertools.count()
    batch, _ = _hill(lambda theta, step: -1e9 * next(tries))
    point, converged, iterations, cov, full = batch.run("information", 60, 1e-5)[0]
    assert converged is False
    fit = Fit(batch.models[0].spec, batch.models[0].terms, point.theta[:2], cov, point.value, 600_000, (0.4,), None, converged, iterations)
    assert [r["converged"] for r in coef_table(spark, {"m": fit}).collect()] == [False, False]
    assert [r["converged"] for r in variance_table(spark, {"m": replace(fit, at_bound=(False,))}).collect()] == [False]


@pytest.mark.parametrize("family", ["poisson", "nb2", "nb1", "gaussian"])
def test_objective_and_gradient_match_dense(nested, family):
    """Two models of one family in one batch, of other levels and terms, on two bases."""
    response, offset = ("w", None) if family == "gaussian" else ("y", "area_m2")
    jobs = [
        (nested, ModelSpec(response, ("treatment", "z"), offset, ("site", "transect", "subplot"), family)),
        (nested.where("z > 0.2"), ModelSpec(response, ("z",), offset, ("site",), family)),
    ]
    batch = Batch(jobs)
    thetas = {m.number: m.start() + 0.07 for m in batch.models}
    points = batch.evaluate({k: [t + 0.01, t] for k, t in thetas.items()}, dict.fromkeys(thetas, 1e-9))
    for model in batch.models:
        theta, point = thetas[model.number], points[model.number][1]
        assert point.value == pytest.approx(_dense(batch, theta, family, model.number), abs=2e-4)
        for i in range(model.size):
            up, down = theta.copy(), theta.copy()
            up[i] += 1e-3
            down[i] -= 1e-3
            slope = (_dense(batch, up, family, model.number) - _dense(batch, down, family, model.number)) / 2e-3
            assert point.grad[i] == pytest.approx(slope, rel=2e-3, abs=2e-2)
    batch.close()


def test_rows_stay_where_they_are(spark, nested, monkeypatch):
    """No exchange above the rows when the intercepts are joined and summed per leaf."""
    batch = Batch([(nested, ModelSpec("y", ("treatment", "z"), "area_m2", ("site", "transect", "subplot"), "nb2"))])
    par = batch._parameters({0: [batch.models[0].start()]})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        leaf = batch._with_terms(batch.state.join(F.broadcast(par.select("m", "t")), "m"), par, ["weight"]).groupBy(*batch.nodes, "parts").agg({"weight": "sum"})
        plan = leaf._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
    assert batch.rows.count() > 0 and batch.scratch.tables
    batch.close()
    assert not batch.scratch.tables


def test_models_of_a_batch_are_those_fitted_alone(nested):
    specs = [
        ModelSpec("y", ("z",), "area_m2", ("site", "subplot"), "poisson", name="mixed"), ModelSpec("y", ("treatment",), None, (), "poisson", name="plain"),
        ModelSpec("w", ("z",), None, (), "gaussian", name="line"),
    ]
    together = fit_many([(nested, s) for s in specs])
    for spec, got in zip(specs, together, strict=True):
        one = fit_glmm(nested, spec) if spec.groups else fit_glm(nested, spec)
        assert got.converged and got.full_hessian and got.terms == one.terms
        assert got.loglik == pytest.approx(one.loglik, abs=1e-4) and got.beta == pytest.approx(one.beta, abs=2e-3)
        assert got.se == pytest.approx(one.se, rel=2e-2) and got.n == one.n and got.k == one.k


def test_gaussian_fit_follows_the_unit_of_the_response(nested):
    spec = ModelSpec("w", ("z",), None, ("site", "subplot"), "gaussian")
    one = fit_glmm(nested, spec, se="information")
    big = fit_glmm(nested.withColumn("w", nested.w * 250.0 + 1000.0), spec, se="information")
    assert one.converged and big.converged
    assert big.beta[1] == pytest.approx(250.0 * one.beta[1], rel=1e-2, abs=0.5)
    assert np.array(big.sds) == pytest.approx(250.0 * np.array(one.sds), rel=2e-2, abs=0.5)
    assert big.dispersion == pytest.approx(250.0 * one.dispersion, rel=5e-3)
    assert big.loglik == pytest.approx(one.loglik - one.n * math.log(250.0), abs=1e-2)


def test_split_leaves_and_row_order_do_not_matter(nested):
    spec = ModelSpec("y", ("z",), "area_m2", ("site", "transect"), "nb2")
    whole = Batch([(nested, spec)])
    split = Batch([(nested.repartition(5).orderBy("z"), spec)], hot_rows=7)
    assert not whole.split and split.split
    assert split.rows.groupBy("g1", "g2", "part").count().agg({"count": "max"}).first()[0] < 24
    theta = {0: [whole.models[0].start()]}
    a, b = whole.evaluate(theta, {0: 1e-8})[0][0], split.evaluate(theta, {0: 1e-8})[0][0]
    assert a.value == pytest.approx(b.value, abs=1e-8)
    assert a.grad == pytest.approx(b.grad, abs=1e-6)


def test_mixed_fit_is_a_maximum_and_feeds_the_reports(spark, nested):
    spec = ModelSpec("y", crossed("treatment", "period"), "area_m2", ("site", "subplot"), "nb2", name="main")
    m = fit_glmm(nested, spec)
    assert m.converged and m.n == len(_rows())
    batch = Batch([(nested, spec)])
    model = batch.models[0]
    theta = model.clip(np.concatenate([np.linalg.solve(model.unscale(), m.beta), m.sds, [math.log(m.dispersion)]]))
    best = _dense(batch, theta, "nb2")
    assert best == pytest.approx(m.loglik, abs=1e-3)
    for i in range(len(theta)):
        for h in (-0.05, 0.05):
            moved = theta.copy()
            moved[i] += h
            assert _dense(batch, model.clip(moved), "nb2") < best + 1e-4
    batch.close()
    # Truth: treatment acts through plots, so only the period effect and the dispersion are well determined.
    late = m.terms.index("periodlate")
    assert abs(m.beta[late] + 0.5) < 4 * m.se[late]
    table = {r["term"]: r for r in coef_table(spark, {"m": m}).collect()}
    assert table["periodlate"]["std_error"] == pytest.approx(float(m.se[late]))
    assert variance_table(spark, {"m": m}).count() == 2 and fit_table(spark, {"m": m}).first()["k"] == 7
    assert score(nested, m).where("mu is null").count() == 0
    shares = diagnostics.r2_nakagawa(nested, m).collect()
    assert all(0 <= r["r2_marginal"] <= r["r2_conditional"] <= 1 for r in shares) and len(shares) == 3
    means = {(r["treatment"], r["period"]): r["rate"] for r in contrasts.marginal_means(nested, m, ["treatment", "period"]).collect()}
    assert means["control", "late"] == pytest.approx(math.exp(m.beta[0] + m.beta[late]))
    ratio = contrasts.marginal_ratios(nested, m, ["treatment"], "period").where("treatment = 'control'").first()
    assert ratio["ratio"] == pytest.approx(math.exp(-m.beta[late])) and ratio["se_log"] == pytest.approx(float(m.se[late]))


def test_correlation_with_p(make):
    df = make([("g", float(i), float(i * i)) for i in range(6)] + [("h", 1.0, 2.0)], "k string, x double, y double")
    got = {r["k"]: r for r in association.with_p(association.cor_test(df, "x", "y", ["k"])).collect()}
    r = np.corrcoef(np.arange(6), np.arange(6) ** 2)[0, 1]
    assert got["g"]["r"] == pytest.approx(r) and 0 < got["g"]["p_value"] < 0.01
    assert got["h"]["r"] is None and got["h"]["p_value"] is None


def test_box_table_and_trend_of_degenerate_groups(make):
    df = make([("a", 1.0, float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 1.0, 5.0)], "k string, x double, y double")
    got = {r["k"]: r for r in figures.box_stats(df, "y", ["k"]).collect()}
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["q3"], got["a"]["whisker_hi"], got["a"]["n_outliers"]) == (2, 3, 4, 4, 1)
    assert got["b"]["n"] == 1
    assert [r["slope"] for r in figures.linear_trend(df, "x", "y", ["k"]).collect()] == [None] * 3


@pytest.mark.parametrize("name", ["glmm_poisson", "glmm_nb2", "glmm_nb1", "glmm_gaussian", "r2_marginal_means", "path_summary"])
def test_mixed_queries_use_the_full_hessian(monkeypatch, nested, name):
    """Each query's fits are stopped where they begin."""
    asked = []

    class Asked(Exception):
        pass

    def run(self, how, *rest):
        asked.append(how)
        raise Asked

    base = nested.selectExpr("*", "transect AS plot", "y AS oak_count", "y AS oak_count_noshoots", "z AS canopy_openness", "w AS total_ba", "z + w AS pH")
    monkeypatch.setattr(glmm.Batch, "run", run)
    for made in ("_rows", "_covered"):
        monkeypatch.setattr(catalog, made, lambda spark, sf: base)
    monkeypatch.setattr(catalog.b, "base_with_covariates", lambda spark, sf: base)
    with pytest.raises(Asked):
        catalog.QUERIES[name](nested.sparkSession, "")
    assert set(asked) == {"hessian"}


def test_path_summary_of_mixed_equations(nested):
    specs = [ModelSpec("w", ("z",), None, ("site",), "gaussian"), ModelSpec("z", ("area_m2",), None, ("site",), "gaussian")]
    claim = fit_glmm(nested, ModelSpec("w", ("z", "area_m2"), None, ("site",), "gaussian"))
    got = paths.path_summary(nested, specs).first()
    at = claim.terms.index("area_m2")
    assert got["fisher_c"] == pytest.approx(-2.0 * math.log(math.erfc(abs(claim.beta[at] / claim.se[at]) / math.sqrt(2.0))), rel=1e-4)
    assert got["claims"] == 1 and got["df"] == 2


def test_claims_follow_from_the_equations():
    for name, (added, response) in {"sem": ("pH", "canopy_openness"), "sem_period": ("period", "canopy_openness")}.items():
        claims = paths.independence_claims(PATH_MODELS[name][1])
        assert [(e.response, a, g) for e, a, g in claims] == [(response, added, ["total_ba"])]


def test_registry(spark, nested):
    assert len(QUESTION_1) + len(QUESTION_2) + sum(len(e) for _, e in PATH_MODELS.values()) == 37
    specs = [("base", ModelSpec("y", ("treatment",), "area_m2", name="a")), ("base", ModelSpec("y", ("z",), None, name="b"))]
    fits = fit_registry({"base": nested}, specs)
    assert set(fits) == {"base:a", "base:b"} and all(f.converged for f in fits.values())


def test_ratios_keep_strata_without_counts(spark):
    from quadrat.models.contrasts import rate_ratios

    rates = spark.createDataFrame([("x", "a", 0.0, 0.0), ("x", "b", 4.0, 2.0), ("y", "a", 4.0, 2.0), ("y", "b", 0.0, 0.0)], "s string, l string, total double, rate double")
    got = {r["s"]: (r["ratio"], r["se_log"], r["z"], r["p_value"]) for r in rate_ratios(rates, ["s"], "l").collect()}
    assert got == {"x": (0.0, None, None, None), "y": (None, None, None, None)}


def test_least_squares_of_several_models(make):
    rng = np.random.default_rng(5)
    n = 200
    x, g = rng.normal(10.0, 1.0, n), rng.integers(0, 3, n)
    y = 3.0 * x + 2.0 * (g == 1) - (g == 2) * x + rng.normal(size=n)
    rows = [(float(a), f"l{b}", float(c) if i % 7 else None, float("nan") if i % 11 == 0 else float(b)) for i, (a, b, c) in enumerate(zip(x, g, y))]
    df = make(rows, "x double, g string, y double, z double")
    specs = [ModelSpec("y", crossed("g", "x"), family="gaussian"), ModelSpec("y", ("z",), family="gaussian"), ModelSpec("z", ("x",), family="gaussian")]
    fits = glm.fit_least_squares(df, specs)
    keep = np.array([r[2] is not None for r in rows])
    real = np.array([not np.isnan(r[3]) for r in rows])
    c = x - 10.0
    design = {0: (keep, y, [g == 1, g == 2, x, (g == 1) * x, (g == 2) * x]), 1: (keep & real, y, [g]), 2: (real, g, [c])}
    for k, m in enumerate(fits):
        rows_in, target, cols = design[k]
        a = np.column_stack([np.ones(n), *cols]).astype(float)[rows_in]
        t = np.asarray(target, float)[rows_in]
        beta, *_ = np.linalg.lstsq(a, t, rcond=None)
        rss = ((t - a @ beta) ** 2).sum()
        assert m.n == rows_in.sum() and m.r2 == pytest.approx(1 - rss / ((t - t.mean()) ** 2).sum(), rel=1e-6)
        assert m.loglik == pytest.approx(-0.5 * m.n * (math.log(2 * math.pi * rss / m.n) + 1), rel=1e-6)
        if k:
            assert m.beta[-1] == pytest.approx(beta[-1], rel=1e-6)
            assert m.se[-1] == pytest.approx(math.sqrt(rss / m.n * np.linalg.inv(a.T @ a)[-1, -1]), rel=1e-6)
    with pytest.raises(ValueError, match="complete rows"):
        glm.fit_least_squares(df.limit(1), specs[2:])


def _log_p(family, mu, k, disp):
    """Log-probability of a count, from gamma functions."""
    if family == "poisson":
        return k * math.log(mu) - mu - math.lgamma(k + 1)
    size = disp if family == "nb2" else mu / disp
    return math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(size / (size + mu)) + k * math.log(mu / (size + mu))


@pytest.mark.parametrize("family, disp, upto", [("poisson", None, None), ("nb2", 1.7, None), ("nb1", 0.6, None), ("nb2", 1.7, 5), ("poisson", None, 0)])
def test_expected_counts_over_blocks(make, monkeypatch, family, disp, upto):
    """Blocks of 4 counts: the range ends inside a block, at a block's end, and at 0."""
    monkeypatch.setattr(diagnostics, "COUNT_BLOCK", 4)
    rows = [(y, x) for y, x in [(0, 0.1), (3, 0.4), (11, 1.2), (3, 1.2), (None, 0.3), (0, 0.4)]]
    df = make(rows, "y int, x double")
    spec = ModelSpec("y", ("x",), None, (), family)
    m = Fit(spec, ["(Intercept)", "x"], np.array([0.3, 1.1]), np.eye(2), 0.0, 5, (), disp)
    got = {r["count"]: r for r in diagnostics.count_frequencies(df, m, upto).collect()}
    top = 11 if upto is None else upto
    assert sorted(got) == list(range(top + 2)) and [k for k, r in got.items() if r["above"]] == [top + 1]
    full = [(y, math.exp(0.3 + 1.1 * x)) for y, x in rows if y is not None]
    for k in range(top + 1):
        assert got[k]["expected"] == pytest.approx(sum(math.exp(_log_p(family, mu, k, disp)) for _, mu in full), rel=1e-9)
        assert got[k]["observed"] == sum(y == k for y, _ in full)
    assert sum(r["observed"] for r in got.values()) == 5 and sum(r["expected"] for r in got.values()) == pytest.approx(5)


def test_models_ranked_from_one_scan(spark, make):
    """A mixed and a plain model with gaps in different columns: each is judged on its own complete rows."""
    rows = [("a", 1, 0.5), ("a", 4, None), ("b", 2, 0.1), (None, 7, 0.9), ("b", 0, 0.2)]
    df = make(rows, "g string, y int, x double")
    effects = make([("a", 0.4), ("b", -0.2)], "g string, b1 double")
    plain = Fit(ModelSpec("y", ("x",), None, (), "poisson"), ["(Intercept)", "x"], np.array([0.2, 0.7]), np.eye(2), -5.0, 4, (), None)
    mixed = Fit(ModelSpec("y", ("x",), None, ("g",), "poisson"), ["(Intercept)", "x"], np.array([0.1, 0.6]), np.eye(2), -4.0, 3, (0.3,), effects=effects)
    got = fit_sums(df, [plain, mixed])
    random = {"a": 0.4, "b": -0.2}
    for found, (b0, b1), kept, extra in [
        (got[0], (0.2, 0.7), [r for r in rows if r[2] is not None], {}),
        (got[1], (0.1, 0.6), [r for r in rows if None not in r], random),
    ]:
        fixed = [b0 + b1 * x for _, _, x in kept]
        resid = [y - math.exp(f + extra.get(g, 0.0)) for (g, y, _), f in zip(kept, fixed)]
        assert found["fixed_var"] == pytest.approx(np.var(fixed)) and found["mean"] == pytest.approx(np.mean([y for _, y, _ in kept]))
        assert found["rmse"] == pytest.approx(math.sqrt(np.mean(np.square(resid))))
    table = diagnostics.compare_models(df, {"plain": plain, "mixed": mixed}).collect()
    assert {r["model"]: r["rmse"] for r in table} == pytest.approx({"plain": got[0]["rmse"], "mixed": got[1]["rmse"]})
