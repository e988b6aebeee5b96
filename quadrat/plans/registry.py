"""The study's list of fits, and running many fits over several bases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from quadrat.models.glmm import Fit, fit_many
from quadrat.models.spec import ModelSpec, crossed

STS = ("site", "transect", "subplot")
SPTS = ("site", "plot", "transect", "subplot")


def _spec(name, terms, groups, family="nb2", offset="area_m2", response="oak_count", factor=()) -> ModelSpec:
    return ModelSpec(response, terms, offset, groups, family, {c: [] for c in factor}, name)


YEAR_AS_FACTOR = {"factor": ("year",)}


# The fits of question 1 as (base, model).
QUESTION_1 = [
    ("oaks_all", _spec("m1_p", ("treatment",), (), "poisson")),
    ("oaks_all", _spec("m1_x", ("treatment",), (), "poisson", None)),
    ("oaks_all", _spec("m1_pr", ("treatment",), STS, "poisson")),
    ("oaks_all", _spec("m2_p", ("year",), STS, "poisson")),
    ("oaks_all", _spec("m3_p", ("treatment", "year"), STS, "poisson")),
    ("oaks_all", _spec("m1_nb", ("treatment",), STS)),
    ("oaks_all", _spec("m2_nb", ("year",), STS)),
    ("oaks_all", _spec("m3_nb", ("treatment", "year"), STS)),
    ("oaks_all", _spec("m4", crossed("treatment", "year"), STS)),
    ("oaks_all", _spec("m4_year_c", crossed("treatment", "year_c"), STS)),
    ("oaks_all", _spec("m4_year_f", crossed("treatment", "year"), STS, **YEAR_AS_FACTOR)),
    ("oaks_all", _spec("m4_nb1_c", crossed("treatment", "year_c"), STS, "nb1")),
    ("oaks_all", _spec("m4_nb1_f", crossed("treatment", "year"), STS, "nb1", **YEAR_AS_FACTOR)),
    ("oaks_all", _spec("m4_year_f_plot", crossed("treatment", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_all", _spec("m4_period", crossed("treatment", "period"), STS)),
    ("oaks_all", _spec("m4_period_plot", crossed("treatment", "period"), SPTS)),
    ("oaks_noshoots", _spec("m4_noshoots", crossed("treatment", "period"), SPTS)),
]

# The fits of question 2 as (base, model).
QUESTION_2 = [
    ("oaks_noshoots", _spec("m1", ("total_ba", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_noshoots_ext", _spec("m1_ext", ("total_ba", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_all", _spec("m1_shoots", ("total_ba", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_noshoots", _spec("m1_oak", ("quercus_sp_ba", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_noshoots", _spec("m2", ("canopy_openness", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_all", _spec("m2_shoots", ("canopy_openness", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_noshoots", _spec("m3", ("pH", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_all", _spec("m3_shoots", ("pH", "year"), SPTS, **YEAR_AS_FACTOR)),
    ("oaks_noshoots", _spec("m4", ("total_ba", "canopy_openness", "pH"), SPTS)),
    ("oaks_all", _spec("m4_shoots", ("total_ba", "canopy_openness", "pH"), SPTS)),
    ("oaks_period", _spec("m1_period", ("total_ba", "period"), SPTS)),
    ("oaks_period", _spec("m2_period", ("canopy_openness", "period"), SPTS)),
    ("oaks_period", _spec("m3_period", ("pH", "period"), SPTS)),
    ("oaks_period", _spec("m4_period_pH", ("total_ba", "canopy_openness", "pH", "period"), SPTS)),
    ("oaks_period", _spec("m4_period", ("total_ba", "canopy_openness", "period"), SPTS)),
]

# The path models as (base, equations).
PATH_MODELS = {
    "sem": ("oaks_2025", [
        _spec("sem_1", ("total_ba",), ("site",), "gaussian", None, "canopy_openness"),
        _spec("sem_2", ("pH",), ("site",), "gaussian", None, "total_ba"),
        _spec("sem_3", ("total_ba", "canopy_openness", "pH"), SPTS, "nb2", None),
    ]),
    "sem_period": ("oaks_sem", [
        _spec("sem_period_1", ("total_ba",), SPTS, "gaussian", None, "canopy_openness"),
        _spec("sem_period_2", ("total_ba", "canopy_openness", "period"), SPTS, "nb2", None),
    ]),
}


def all_specs() -> list[tuple[str, ModelSpec]]:
    """Every fit of the study: both questions and the equations of the path models."""
    return QUESTION_1 + QUESTION_2 + [(base, spec) for base, equations in PATH_MODELS.values() for spec in equations]


def fit_registry(bases: Mapping[str, DataFrame], specs: Sequence[tuple[str, ModelSpec]], **options) -> dict[str, Fit]:
    """Fit each (base, model): the models of a family share every pass, and each base is scanned once for them."""
    fits = fit_many([(bases[base], spec) for base, spec in specs], **options)
    return {f"{base}:{spec.name}": fit for (base, spec), fit in zip(specs, fits, strict=True)}
