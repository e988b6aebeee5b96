import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from quadrat.operators import aggregates, columns, filters, joins
from quadrat.operators.quantiles import exact_quantiles, value_counts


def test_names(make):
    assert [columns.clean_name(n) for n in ("Betula sp.", "Quercus sp.", "10g_measurement", "canopyOpen (%)", "Björk sp.")] == [
        "betula_sp", "quercus_sp", "x10g_measurement", "canopy_open_percent", "bjork_sp"]
    df = make([(1, 2, 3)], "a int, `B c.` int, `b_c` int")
    assert columns.clean_names(df).columns == ["a", "b_c", "b_c_2"]
    assert columns.suffix_columns(df.select("a", "b_c"), "_ba", ["a"]).columns == ["a", "b_c_ba"]
    assert columns.lead_columns(df, "b_c").columns == ["b_c", "a", "B c."]


def test_mask_and_nan(make):
    df = make([("s", "t1", 1.0), ("s", "t2", 2.0), (None, "t1", 3.0)], "site string, transect string, x_ba double")
    out = columns.mask_columns(df, "_ba", columns.allowed_pairs({"s": ["t1"]}, "site", "transect"))
    assert rows_of(out, "x_ba") == [(1.0,), (None,), (None,)]
    nan = columns.nan_to_null(make([(float("nan"), 1), (2.0, 2)], "x double, k int"))
    assert rows_of(nan) == [(2.0, 2), (None, 1)]


def test_union_by_name(make):
    out = columns.union_all(make([(1, "a")], "k int, s string"), make([("b", 2.0)], "s string, x double"))
    assert rows_of(out) == [(1, "a", None), (None, "b", 2.0)]


def test_filters(make):
    df = make([("s", "1", 1), ("s", "2", 2), ("t", "1", 3), ("s", None, 4)], "site string, sub string, v int")
    assert rows_of(filters.exclude_keys(df, [{"site": "s", "sub": "1"}]), "v") == [(2,), (3,)]
    assert rows_of(filters.exclude_keys(df, [{"site": "s", "sub": ["1", "2"]}]), "v") == [(3,), (4,)]
    blank = make([(None, None, 1.0), ("a", None, 2.0)], "k string, j string, x double")
    assert filters.drop_blank_rows(blank, ["k", "j"]).count() == 1


def test_dedup_prefers_present_values(make):
    df = make([("a", None, "x"), ("a", 4.5, "10,0"), ("b", None, "y"), ("b", None, "x")], "k string, pH double, g string")
    assert rows_of(filters.dedup_samples(df, ["k"], ["pH", "g"])) == [("a", 4.5, "10,0"), ("b", None, "x")]


def test_joins(make):
    left = make([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = make([("a", 10.0), (None, 30.0)], "K2 string, x double")
    expect = [("a", 1, 10.0), ("b", 2, None), (None, 3, 30.0)]
    assert rows_of(joins.left_join_on(left, right, {"k": "K2"})) == expect
    assert rows_of(joins.left_join_on(left, right, {"k": "K2"}, salts=7)) == expect
    with pytest.raises(Exception, match="duplicate key"):
        joins.join_unique(left, make([("a", 1.0), ("a", 2.0)], "k string, x double"), ["k"]).collect()
    both = joins.join_coalesce(
        make([("a", 1.0), ("b", None), ("c", None)], "k string, x double"), make([("a", 9.0), ("b", 8.0)], "k string, x double"),
        ["k"], "x")
    assert rows_of(both) == [("a", 1.0), ("b", 8.0), ("c", None)]
    named = joins.decode(make([(1,), (9,)], "code int"), make([(1, "oak")], "code int, name string"), "code", "name")
    assert rows_of(named) == [(1, "oak"), (9, None)]


def test_pivot_keeps_missing_cells_apart(make):
    df = make([("p", "a", 1.0), ("p", "b", None), ("q", "a", 2.0)], "k string, s string, v double")
    assert rows_of(aggregates.pivot_fill(df, ["k"], "s", "v"), "k", "a", "b") == [("p", 1.0, None), ("q", 2.0, 0.0)]


def test_sum_of_distinct_areas(make):
    df = make([("a", 3.0), ("a", 2.0), ("a", 2.0), ("b", 2.5), ("b", 2.5), ("c", 5.0)], "k string, area double")
    assert rows_of(aggregates.sum_distinct_over(df, ["k"], "area")) == [
        ("a", 5.0), ("a", 5.0), ("a", 5.0), ("b", 2.5), ("b", 2.5), ("c", 5.0)]


def test_total_and_center(make):
    df = make([("a", 1.0), ("a", 2.0), ("b", None)], "k string, x double")
    assert rows_of(aggregates.with_total(df, ["k"], "x", "t")) == [("a", 1.0, 3.0), ("a", 2.0, 3.0), ("b", None, None)]
    assert rows_of(aggregates.center(make([(1,), (3,)], "y int"), "y"), "y_c") == [(-1.0,), (1.0,)]


def test_period_mean_rounds_half_up(make):
    df = make([("s", 2003, 2, None), ("s", 2005, 3, 4.0), ("s", 2025, 1, None)], "k string, year int, n int, c double")
    out = aggregates.collapse_period(df, ["k"], {"early": [2003, 2005]}, "late", "n", ["c"])
    assert rows_of(out) == [("s", "early", 3, 4.0), ("s", "late", 1, None)]


def test_zone_mean(make):
    rows = [("a", "core", 10.0), ("a", "extended", 20.0), ("b", "core", 5.0), ("c", None, 7.0)]
    df = make(rows, "k string, area_type string, total_ba double")
    area = F.when(F.col("area_type") == "core", 0.3).when(F.col("area_type") == "extended", 0.1)
    out = aggregates.weighted_zone_mean(df, ["k"], ["total_ba"], area)
    assert [(k, z, round(v, 9)) for k, z, v in rows_of(out)] == [("a", "core", 12.5), ("b", "core", 5.0), ("c", None, 7.0)]


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_exact_quantiles_match_brute_force(make, limit):
    """With a small limit the narrowing rounds run, on even, skewed, tied and tiny groups."""
    rnd = random.Random(4)
    data = [("even", rnd.uniform(-5, 5)) for _ in range(3000)] + [("skew", 10 ** rnd.uniform(-8, 8)) for _ in range(2500)]
    data += [("tied", float(rnd.randrange(4))) for _ in range(700)] + [("one", 3.25)] + [(None, 1.0), (None, 2.0)]
    df = make(data, "g string, y double")
    probs = [0.25, 0.5, 0.75]
    for row in exact_quantiles(value_counts(df, ["g"], "y"), ["g"], probs, limit).collect():
        y = np.array([v for g, v in data if g == row["g"]])
        assert row["n"] == len(y)
        assert [row[f"q{i}"] for i in range(3)] == pytest.approx(list(np.quantile(y, probs)), rel=1e-12)
