"""Basal area per plot and species, scaled to the hectare, long and wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nulls import strict_sum
from quadrat.functions.scalar import circle_area, per_ha
from quadrat.operators.aggregates import pivot_fill
from quadrat.operators.columns import clean_name, clean_names, suffix_columns
from quadrat.operators.joins import left_join_on


def species_area(
    trees: DataFrame, keys: Sequence[str], species: str = "species", diameter: str = "diameter_cm", unit: str = "cm",
    stems: str | None = None,
) -> DataFrame:
    """Stem cross-section summed per key and species; one missing diameter makes its sum missing."""
    return trees.groupBy(*keys, species).agg(strict_sum(circle_area(diameter, unit, stems)).alias("basal_area"))


def net_of(standing: DataFrame, removed: DataFrame, keys: Sequence[str], col: str = "basal_area") -> DataFrame:
    """Standing minus removed per key, keeping what is left above zero."""
    gone = removed.select(*keys, F.col(col).alias("__gone"))
    net = left_join_on(standing, gone, list(keys))
    return net.withColumn(col, F.col(col) - F.coalesce(F.col("__gone"), F.lit(0.0))).drop("__gone").where(F.col(col) > 0)


def widen(
    long: DataFrame, keys: Sequence[str], species: str = "species", levels: Sequence[str | None] | None = None
) -> DataFrame:
    """Total per key and one ``<species>_ba`` column per species; a species absent from a plot is 0 there."""
    keys = list(keys)
    total = strict_sum("basal_area").alias("total_ba")
    wide = pivot_fill(long, keys, species, "basal_area", levels, also=[total])
    return suffix_columns(clean_names(wide), "_ba", [*(clean_name(k) for k in keys), "total_ba"])


def basal_area(
    trees: DataFrame, keys: Sequence[str], area_ha: Column | float, species: str = "species",
    diameter: str = "diameter_cm", unit: str = "cm", stems: str | None = None,
    levels: Sequence[str | None] | None = None,
) -> DataFrame:
    long = species_area(trees, keys, species, diameter, unit, stems)
    return widen(long.withColumn("basal_area", per_ha("basal_area", area_ha)), keys, species, levels)
