import math

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from quadrat.functions import nulls, scalar, special, tails


def test_membership_is_never_null(make):
    df = make([("a",), ("b",), (None,)], "x string")
    assert rows_of(df.select(nulls.in_set("x", ["a"]).alias("m"), (~nulls.in_set("x", ["a"])).alias("n"))) == [
        (False, True), (False, True), (True, False)]
    num = make([(3,), (7,), (None,)], "x int")
    assert rows_of(num.select(nulls.in_set("x", range(1, 5)).alias("m"))) == [(False,), (False,), (True,)]


def test_tolerant_inequality_keeps_missing(make):
    df = make([("core",), ("extended",), (None,)], "z string")
    assert rows_of(df.where(nulls.is_not("z", "extended"))) == [("core",), (None,)]


def test_strict_and_conditional_sums(make):
    df = make([("a", 1.0, True), ("a", None, True), ("b", 2.0, True), ("b", 3.0, False)], "k string, x double, s boolean")
    out = df.groupBy("k").agg(
        nulls.strict_sum("x").alias("s"), nulls.strict_mean("x").alias("m"), nulls.sum_if("x", ~F.col("s")).alias("c"))
    assert rows_of(out) == [("a", None, None, 0.0), ("b", 5.0, 2.5, 3.0)]


def test_any_and_none(make):
    df = make([("a", None), ("a", "x"), ("b", None), ("c", "q"), ("d", "q"), ("d", None)], "k string, s string")
    out = df.groupBy("k").agg(nulls.any_true(F.col("s") == "q").alias("any"), nulls.none_true(F.col("s") == "q").alias("none"))
    assert rows_of(out) == [("a", False, None), ("b", False, None), ("c", True, False), ("d", True, False)]


def test_only_fails_on_two_values(make):
    df = make([("a", 1.0), ("a", 1.0), ("b", None)], "k string, x double")
    assert rows_of(df.groupBy("k").agg(nulls.only("x").alias("x"))) == [("a", 1.0), ("b", None)]
    with pytest.raises(Exception, match="several values"):
        make([("a", 1.0), ("a", 2.0)], "k string, x double").groupBy("k").agg(nulls.only("x")).collect()


def test_correlation_of_a_constant_is_null(make):
    df = make([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.agg(nulls.safe_corr("x", "y")).first()[0] is None
    one = make([(1.0, 5.0)], "x double, y double")
    assert one.agg(nulls.safe_corr("x", "y")).first()[0] is None


def test_tolerant_threshold(make):
    df = make([(None,), ("",), ("3.2",), ("7",), ("0.1-5",), ("abc",)], "d string")
    kept = df.withColumn("d", scalar.blank_to_null("d")).where(nulls.tolerant_keep("d", 5, "0.1-5"))
    assert rows_of(kept) == [("0.1-5",), ("3.2",), (None,), (None,)]


def test_scalars(make):
    df = make([(2.5, 10.0, "2003-06-01"), (-2.5, 20.0, "never"), (2.4, 0.0, None)], "x double, d double, t string")
    out = df.select(
        scalar.round_half_up("x").alias("r"), F.round(scalar.circle_area("d"), 10).alias("cm"),
        F.round(scalar.circle_area("d", "mm", F.lit(3)), 12).alias("mm"), scalar.year_of("t").alias("y"))
    expect = [
        (3, round(math.pi * 0.05**2, 10), round(3 * math.pi * 0.005**2, 12), 2003),
        (-2, round(math.pi * 0.1**2, 10), round(3 * math.pi * 0.01**2, 12), None), (2, 0.0, 0.0, None)]
    assert rows_of(out) == sorted(expect, key=repr)
    merged = make([("p",), ("q",), ("z",), (None,)], "s string").select(scalar.merge_levels("s", {"m": ["p", "q"]}).alias("s"))
    assert rows_of(merged) == [("m",), ("m",), ("z",), (None,)]


@pytest.mark.parametrize("x", [0.03, 0.9, 1.0, 4.5, 60.0, 3000.0])
def test_gamma_functions(spark, x):
    row = spark.range(1).selectExpr(
        *[f"{f(f'({x!r}D)')} AS v{i}" for i, f in enumerate((special.lgamma, special.digamma, special.trigamma, special.tetragamma))]
    ).first()
    assert row[0] == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-11)
    assert row[1] == pytest.approx(special.digamma_value(x), rel=1e-10)
    assert row[2] == pytest.approx(special.trigamma_value(x), rel=1e-10)
    h = 1e-4 * x
    slope = (special.trigamma_value(x + h) - special.trigamma_value(x - h)) / (2 * h)
    assert row[3] == pytest.approx(slope, rel=1e-5)
    assert special.digamma_value(1.0) == pytest.approx(-0.5772156649015329)
    assert special.trigamma_value(1.0) == pytest.approx(math.pi**2 / 6)


def test_tail_probabilities(make):
    assert tails.normal_p(1.959963984540054) == pytest.approx(0.05)
    assert tails.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_p(12.7062047, 1) == pytest.approx(0.05, abs=1e-7)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert tails.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_p(18.307038053, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_p(2.0, 2) == pytest.approx(math.exp(-1.0))
    df = make([(2.228138852, 10), (None, 10)], "t double, df int")
    got = [r[0] for r in df.select(tails.t_p_col(F.col("t"), F.col("df"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-8) and got[1] is None


def test_tail_columns_match_the_scalars(make):
    sizes = [1.0, 2.0, 3.0, 10.0, 41.0, 1000.0, 50000.0]
    rows = [(t, d) for t in (0.0, 0.01, 1.0, -2.0, 10.0, 40.0) for d in sizes]
    df = make([*rows, (1.0, None), (None, 3.0), (1.0, 0.0)], "t double, d double")
    for r in df.select("t", "d", tails.t_p_col(F.col("t"), F.col("d")).alias("p")).collect():
        if r.t is None or not r.d:
            assert r.p is None
        else:
            assert r.p == pytest.approx(tails.t_p(r.t, r.d), rel=1e-8, abs=1e-250)
    df = make([(d,) for d in [*sizes, 3e7, 0.0, None]], "d double")
    for p in (0.6, 0.975, 0.9995):
        for r in df.select("d", tails.t_quantile_col(p, F.col("d")).alias("q")).collect():
            assert r.q is None if not r.d else r.q == pytest.approx(tails.t_quantile(p, r.d), rel=1e-7)
    rows = [(d * m, d) for d in sizes for m in (0.0, 0.01, 0.95, 1.0, 1.05, 2.0)]
    for r in make([*rows, (None, 2.0)], "x double, d double").select("x", "d", tails.chi2_p_col(F.col("x"), F.col("d")).alias("p")).collect():
        assert r.p is None if r.x is None else r.p == pytest.approx(tails.chi2_p(r.x, r.d), rel=1e-7, abs=1e-14)


def test_normal_tail_column(spark):
    import math

    from quadrat.functions.tails import normal_p_col

    values = [0.0, 1e-6, 0.01, 0.5, 1.0, 1.96, 2.999, 3.0, 3.001, 5.0, 9.0, 20.0, -2.5]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "z double")
    got = {r["z"]: r["p"] for r in rows.select("z", normal_p_col(rows.z).alias("p")).collect()}
    assert got[None] is None
    assert all(math.isclose(got[v], math.erfc(abs(v) / math.sqrt(2)), rel_tol=1e-11, abs_tol=1e-300) for v in values)
