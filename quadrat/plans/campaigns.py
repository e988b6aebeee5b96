"""The two campaigns and their integration into the tidy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nulls import in_set, strict_sum, tolerant_keep
from quadrat.functions.scalar import blank_to_null, merge_levels, per_ha, year_of
from quadrat.operators.aggregates import count_per, sum_distinct_over
from quadrat.operators.columns import allowed_pairs, mask_columns, recode, union_all
from quadrat.operators.filters import dedup_samples, drop_blank_rows, exclude_keys
from quadrat.operators.joins import decode, join_coalesce, join_unique, left_join_on
from quadrat.plans import study_values as v
from quadrat.plans.basal_area import basal_area, net_of, species_area, widen
from quadrat.plans.zero_fill import zero_fill
from quadrat.plans.zones import assign_zone, zone_area

SUBPLOT = ["site", "plot", "treatment", "transect", "subplot"]
VISIT = ["site", "plot", "treatment", "year", "transect", "subplot"]

# A plot holds many visits, so its rows are spread over this many tasks when plot values are attached.
PLOT_SALTS = 16


def repair_soil(soil: DataFrame) -> DataFrame:
    """One sample per subplot: blank rows go, of twins the one with a pH value stays."""
    return dedup_samples(drop_blank_rows(soil, SUBPLOT), SUBPLOT, ["pH", "10g_measurement"])


def prepare_current(
    seedlings: DataFrame, canopy: DataFrame, soil: DataFrame, trees: DataFrame, species: list[str] | None = None
) -> DataFrame:
    """Counts of the current campaign with canopy, pH and, on measured transects, basal area."""
    rows = seedlings.withColumns({
        "year": F.lit(v.CURRENT_YEAR),
        "area_m2": F.lit(v.CURRENT_AREA_M2),
        "shoot": in_set("notes", v.SHOOT_NOTES),
    })
    counts = zero_fill(rows, [*VISIT, "area_m2"], "species", v.FOCAL_SPECIES, v.EMPTY_MARKER)
    keys = {c.capitalize(): c for c in SUBPLOT}
    readings = (
        canopy.withColumnsRenamed(keys).groupBy(*SUBPLOT).agg(F.avg("`Canopy openness (%)`").alias("canopy_openness"))
    )
    data = left_join_on(counts, readings, SUBPLOT)
    data = join_unique(data, repair_soil(soil).select(*SUBPLOT, "pH"), SUBPLOT)
    plot = ["site", "plot", "treatment"]
    wide = basal_area(trees, plot, v.TREE_PLOT_AREA_HA, levels=species)
    data = left_join_on(data, wide, plot, PLOT_SALTS)
    return mask_columns(data, "_ba", allowed_pairs(v.MEASURED_TRANSECTS, "site", "transect"))


def net_basal_area(
    standing: DataFrame, removed: DataFrame, species_codes: DataFrame, species: list[str] | None = None
) -> DataFrame:
    """Basal area per plot, zone and species left after the removal, per hectare of the zone, wide."""
    keys = ["Omrkod", "Yta", "Trad_lati", "area_type"]

    def by_species(trees: DataFrame, rules) -> DataFrame:
        # Sum per species code first, so that only one row per plot, zone and code is decoded.
        by_code = species_area(assign_zone(trees, rules), ["Omrkod", "Yta", "area_type"], "Tradartkod", "Diameter", "mm", "Antal")
        named = decode(by_code, species_codes, "Tradartkod", "Trad_lati")
        named = named.withColumn("Trad_lati", merge_levels("Trad_lati", v.MERGED_SPECIES))
        return named.groupBy(*keys).agg(strict_sum("basal_area").alias("basal_area"))

    left = net_of(by_species(standing, v.STANDING_ZONES), by_species(removed, v.REMOVED_ZONES), keys)
    left = left.withColumn("basal_area", per_ha("basal_area", zone_area(v.ZONE_AREAS_HA)))
    wide = widen(left, ["Omrkod", "Yta", "area_type"], "Trad_lati", species)
    return recode(wide.withColumnsRenamed({"omrkod": "site", "yta": "plot"}), "site", v.SITE_NAMES)


def prepare_historic(
    old: DataFrame, old_canopy: DataFrame, standing: DataFrame, removed: DataFrame, species_codes: DataFrame,
    species: list[str] | None = None,
) -> DataFrame:
    """Counts of the earlier campaigns; in the year of the tree survey each visit repeats per zone of its plot."""
    rows = old.withColumn("year", year_of("date")).withColumn("diameter_cm", blank_to_null("diameter_cm"))
    rows = rows.where(
        ~in_set("year", v.YEARS_LEFT_OUT)
        & (F.col("subplot") != v.SUBPLOT_LEFT_OUT)
        & (F.col("species") != v.SPECIES_LEFT_OUT)
        & ~F.col("in_exclosure")
        & tolerant_keep("diameter_cm", v.LARGEST_DIAMETER_CM, v.SMALL_DIAMETER_CLASS)
    )
    # Count first: from here on a visit has a few rows per species, however many plants were found in it.
    visit = [*VISIT, "area_m2", "canopy_openness", "pH"]
    rows = count_per(exclude_keys(rows, v.VISITS_LEFT_OUT), [*visit, "species", "shoot"], name="n")
    rows = join_coalesce(rows, old_canopy, ["site", "plot", "year", "transect", "subplot"], "canopy_openness")
    rows = sum_distinct_over(rows, VISIT, "area_m2")
    counts = zero_fill(rows, visit, "species", v.FOCAL_SPECIES, v.EMPTY_MARKER, weight="n")
    trees = net_basal_area(standing, removed, species_codes, species).withColumn("year", F.lit(v.TREE_YEAR))
    return left_join_on(counts, trees, ["site", "plot", "year"], PLOT_SALTS)


def integrate(historic: DataFrame, current: DataFrame) -> DataFrame:
    return union_all(historic, current)
