"""Analysis bases: one row per visit with its counts and covariates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nulls import in_set
from quadrat.operators.aggregates import center, collapse_period, sum_counts, visit_counts, weighted_zone_mean
from quadrat.operators.filters import complete_cases, without_value
from quadrat.plans import study_values as v
from quadrat.plans.campaigns import VISIT
from quadrat.plans.zones import zone_area
from quadrat.session import side_by_side

COVARIATES = ["canopy_openness", "pH", "total_ba", "quercus_sp_ba"]
AREA_COLS = ["total_ba", "quercus_sp_ba"]


def core_rows(tidy: DataFrame) -> DataFrame:
    return without_value(tidy, "area_type", "extended")


def extended_rows(tidy: DataFrame, area: Column | None = None) -> DataFrame:
    """Rows whose basal area is the mean over core and extended zone, weighted by zone area (the study's, if none is given)."""
    if area is None:
        area = zone_area(v.ZONE_AREAS_HA, code="site", plot="plot", names=v.SITE_NAMES)
    return weighted_zone_mean(tidy, VISIT, AREA_COLS, area)


def analysis_base(
    tidy: DataFrame, variant: str, focal: str = v.FOCAL_SPECIES, early: Sequence[int] = tuple(v.EARLY_YEARS), area: Column | None = None
) -> DataFrame:
    """Base by name.

    ``oaks_all`` / ``oaks_noshoots`` (and ``_ext``) have one row per visit and ``oak_count``; ``oaks_period``,
    ``oaks_0305``, ``oaks_2025`` and ``oaks_sem`` are derived from ``oaks_noshoots``; ``oak_density``,
    ``total_density`` and ``others_density`` feed the figures and carry their covariates in the key.
    """
    if variant in ("oak_density", "total_density", "others_density"):
        species = {"oak_density": {"species": focal}, "others_density": {"exclude": focal}}.get(variant, {})
        return sum_counts(core_rows(tidy), [*VISIT, "area_m2", *COVARIATES], "density", variant, **species)
    if variant in ("oaks_all", "oaks_noshoots", "oaks_all_ext", "oaks_noshoots_ext"):
        return _one_count(both_counts(tidy, variant.endswith("_ext"), focal, area), variant)
    base = analysis_base(tidy, "oaks_noshoots", focal, early, area)
    if variant == "oaks_2025":
        return complete_cases(base, ["total_ba", "canopy_openness", "pH"])
    return _of_periods(period_base(base, early), variant)


def both_counts(tidy: DataFrame, extended: bool, focal: str = v.FOCAL_SPECIES, area: Column | None = None) -> DataFrame:
    """One row per visit with its counts with and without shoots and its covariates."""
    rows = extended_rows(tidy, area) if extended else core_rows(tidy)
    return visit_counts(rows, [*VISIT, "area_m2"], focal, COVARIATES)


def _one_count(counts: DataFrame, variant: str) -> DataFrame:
    if variant.startswith("oaks_noshoots"):
        counts = counts.withColumn("oak_count", F.col("oak_count_noshoots"))
    return counts.drop("oak_count_noshoots")


def _of_periods(period: DataFrame, variant: str) -> DataFrame:
    if variant == "oaks_period":
        return period
    if variant == "oaks_0305":
        return period.where(F.col("period") == "early")
    if variant == "oaks_sem":
        return complete_cases(period, ["total_ba", "canopy_openness"])
    raise ValueError(f"unknown base {variant}")


def period_base(base: DataFrame, early: Sequence[int] = tuple(v.EARLY_YEARS)) -> DataFrame:
    keys = [c for c in VISIT if c != "year"]
    return collapse_period(base, [*keys, "area_m2"], {"early": list(early)}, "late", "oak_count", COVARIATES)


def modelling_bases(
    tidy: DataFrame, focal: str = v.FOCAL_SPECIES, early: Sequence[int] = tuple(v.EARLY_YEARS), area: Column | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """Every base of the fit list by name, with ``period`` and the centred year where models use them.

    ``keep`` makes a table of what several bases are derived from: the counts per visit (core, extended) and the periods. With it
    the tidy table is read twice, however many bases there are.
    """
    both = [partial(lambda extended: keep(both_counts(tidy, extended, focal, area)), extended) for extended in (False, True)]
    out, counts = {}, dict(enumerate(side_by_side(tidy.sparkSession, both)))
    for name in ("oaks_all", "oaks_noshoots", "oaks_all_ext", "oaks_noshoots_ext"):
        base = _one_count(counts[name.endswith("_ext")], name)
        period = F.when(in_set("year", early), "early").otherwise("late")
        out[name] = center(base.withColumn("period", period), "year", "year_c")
    base = _one_count(counts[False], "oaks_noshoots")
    periods = keep(period_base(base, early))
    out |= {name: _of_periods(periods, name) for name in ("oaks_period", "oaks_0305")}
    out["oaks_2025"] = complete_cases(base, ["total_ba", "canopy_openness", "pH"])
    out["oaks_sem"] = _of_periods(periods, "oaks_sem")
    return out
