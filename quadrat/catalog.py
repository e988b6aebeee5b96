"""Queries over the benchmark tables, one per operator or job, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat import bindings as b
from quadrat import study_bindings as study
from quadrat.functions import nulls, scalar
from quadrat.models import association, contrasts, diagnostics, figures, paths
from quadrat.models.glm import coef_table, fit, fit_glm, fit_table, variance_table
from quadrat.models.glmm import fit_glmm
from quadrat.models.spec import ModelSpec, crossed
from quadrat.operators import aggregates, columns, filters, joins
from quadrat.plans import basal_area as ba
from quadrat.plans import campaigns
from quadrat.plans.bases import modelling_bases as study_bases
from quadrat.plans.registry import all_specs, fit_registry
from quadrat.plans.zero_fill import zero_fill
from quadrat.plans.zones import assign_zone_table, zone_area
from quadrat.session import Scratch, materialize, scratch_path, side_by_side
from quadrat.sources.delimited import load_tidy, read_delim, read_delim_eu, write_tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PLACE = ("site", "plot", "transect", "subplot")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so that sums taken in another order compare equal."""
    return columns.map_columns(df, lambda _, t: t == "double", lambda c: F.round(c, digits))


# -- counting and filling ---------------------------------------------------------------------------------


@query
def focal_rate_change(spark, sf):
    """Did the rate of the focal species change between the periods, by treatment?"""
    rates = contrasts.adjusted_rates(b.base(spark, sf), "oak_count_noshoots", "area_m2", ["treatment", "period"])
    out = contrasts.rate_ratios(rates, ["treatment"], "period")
    return rounded(out.withColumn("percent_change", 100.0 / F.col("ratio") - 100.0))


@query
def count_per_visit(spark, sf):
    rows = b.seedlings(spark, sf).where(F.col("species") != b.EMPTY)
    return aggregates.count_per(rows, [*b.VISIT, "species", "shoot"], "n")


@query
def zero_fill_focal(spark, sf):
    return b.filled(spark, sf)


@query
def conditional_sum_keep_zero(spark, sf):
    return aggregates.visit_counts(b.filled(spark, sf), b.VISIT, b.FOCAL)


@query
def sum_counts_all(spark, sf):
    return aggregates.sum_counts(b.filled(spark, sf), b.VISIT, "density", "total_density")


@query
def sum_counts_others(spark, sf):
    return aggregates.sum_counts(b.filled(spark, sf), b.VISIT, "density", "others_density", exclude=b.FOCAL)


@query
def distinct_visits(spark, sf):
    return b.visits(spark, sf).select(*b.VISIT).distinct()


@query
def groups_without_focal(spark, sf):
    """Visits in which no row has the focal species."""
    rows = b.seedlings(spark, sf).groupBy(*b.VISIT).agg(nulls.none_true(F.col("species") == b.FOCAL).alias("none"))
    return rows.where("none").drop("none")


# -- joins ------------------------------------------------------------------------------------------------


@query
def canopy_left_join(spark, sf):
    return rounded(joins.left_join_on(b.base(spark, sf), b.canopy(spark, sf), {"subplot": "Subplot"}))


def _items(spark, sf) -> DataFrame:
    return b.table(spark, sf, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query
def dedup_samples(spark, sf):
    return filters.dedup_samples(_items(spark, sf), ["l_orderkey", "l_linenumber"], ["l_quantity"])


@query
def unique_join(spark, sf):
    """Each order with one sample of its items."""
    samples = filters.dedup_samples(_items(spark, sf), ["l_orderkey"], ["l_linenumber", "l_quantity"])
    samples = samples.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_tax")
    return joins.join_unique(b.visits(spark, sf), samples, ["o_orderkey"])


@query
def blank_row_drop(spark, sf):
    rows = _items(spark, sf).select(
        F.nullif("l_linenumber", F.lit(1)).alias("line"), F.nullif("l_returnflag", F.lit("A")).alias("flag"),
    )
    return aggregates.count_per(filters.drop_blank_rows(rows, ["line", "flag"]), ["line", "flag"], name="n")


@query
def masked_columns(spark, sf):
    """Basal area attached to the visits of the plot, kept on measured transects only."""
    wide = ba.basal_area(b.trees(spark, sf), ["site", "plot"], 0.1, "species", "diameter", "cm", "stems", b.SPECIES)
    out = joins.left_join_on(b.base(spark, sf).select(*b.VISIT, "oak_count"), wide, ["site", "plot"], salts=16)
    return rounded(columns.mask_columns(out, "_ba", columns.allowed_pairs(b.MEASURED, "site", "transect")))


@query
def coalesce_join(spark, sf):
    """Canopy of the visit, else the value known for the subplot."""
    left = joins.left_join_on(b.base(spark, sf).select("subplot", "year", "oak_count"), b.canopy(spark, sf), {"subplot": "Subplot"})
    right = b.subplots(spark, sf).where(F.col("transect") == "BUILDING").select("subplot", F.col("pH").alias("canopy_openness"))
    return rounded(joins.join_coalesce(left, right, ["subplot"], "canopy_openness"))


@query
def decode_lookup(spark, sf):
    """Items per decoded name; codes that are not in the lookup have none."""
    counts = aggregates.count_per(_items(spark, sf), ["l_partkey"], name="n")
    lookup = b.table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    named = joins.decode(counts, lookup, "l_partkey", "p_name")
    return aggregates.count_per(named, ["p_name"], "n", "n")


@query
def recode_merge(spark, sf):
    rows = b.seedlings(spark, sf).withColumn(
        "species", scalar.merge_levels("species", {"SIZED": ["SMALL", "MEDIUM", "LARGE"], "CHEAP": ["ECONOMY"]})
    )
    rows = columns.recode(rows, "site", {"MIDDLE EAST": "ORIENT", "AMERICA": "NEW WORLD"})
    return aggregates.count_per(rows, ["site", "species"], "n", "n")


@query
def zone_fanout_join(spark, sf):
    """In one year each visit repeats per zone of its plot; the NULL-tolerant filter then drops the extra rows."""
    wide = b.zone_wide(spark, sf).select("site", "plot", "area_type", "total_ba", F.lit(1996).alias("year"))
    rows = b.base(spark, sf).select(*b.VISIT, "oak_count")
    both = joins.left_join_on(rows, wide, ["site", "plot", "year"], salts=16)
    return rounded(both.withColumn("kept", nulls.is_not("area_type", "extended")))


@query
def core_rows(spark, sf):
    return filters.without_value(zone_fanout_join(spark, sf), "area_type", "extended").drop("kept")


# -- zones and basal area ---------------------------------------------------------------------------------


@query
def zone_assignment(spark, sf):
    return aggregates.count_per(b.zoned(spark, sf), ["site", "plot", "area_type", "section"], "stems", "stems")


@query
def zone_assignment_by_table(spark, sf):
    """The same with the section bounds in a table: for each site and species, from the smallest section to the mean one."""
    trees = b.trees(spark, sf)
    mean = F.floor(F.sum(F.col("section") * F.col("stems")) / F.sum("stems")).cast("int")
    rules = trees.groupBy(F.col("site").alias("code"), F.col("species").alias("zone")).agg(F.min("section").alias("lo"), mean.alias("hi"))
    rows = aggregates.count_per(trees, ["site", "plot", "section"], "stems", "stems")
    return assign_zone_table(rows, rules.withColumn("plot", F.lit(None).cast("string")), "site", "plot", "section")


@query
def species_basal_area(spark, sf):
    long = ba.species_area(b.trees(spark, sf), ["site", "plot"], "species", "diameter", "cm", "stems")
    return rounded(aggregates.with_total(long, ["site", "plot"], "basal_area", "total_ba"))


@query
def strict_species_sum(spark, sf):
    """One missing diameter makes the sum of its group missing."""
    rows = _items(spark, sf).withColumn("d", F.nullif("l_quantity", F.lit(50.0)))
    return rounded(rows.groupBy("l_partkey").agg(nulls.strict_sum("d").alias("total"), nulls.strict_mean("d").alias("mean")))


@query
def basal_area_wide(spark, sf):
    return rounded(ba.basal_area(b.trees(spark, sf), ["site", "plot"], 0.1, "species", "diameter", "cm", "stems", b.SPECIES))


@query
def net_standing(spark, sf):
    trees = b.zoned(spark, sf)
    keys = ["site", "plot", "area_type", "species"]
    area = {"trees": trees, "removed": trees.where("removed")}
    area = {k: ba.species_area(t, keys[:3], "species", "diameter", "cm", "stems") for k, t in area.items()}
    return rounded(ba.net_of(area["trees"], area["removed"], keys))


@query
def zone_weighted_mean(spark, sf):
    wide = b.zone_wide(spark, sf).select("site", "plot", "area_type", "total_ba", "standard_ba")
    wide = wide.withColumn("year", F.lit(1996))
    rows = joins.left_join_on(b.base(spark, sf).select(*b.VISIT, "oak_count"), wide, ["site", "plot", "year"], salts=16)
    area = zone_area(b.ZONE_AREAS, code="site", plot="plot")
    return rounded(aggregates.weighted_zone_mean(rows, b.VISIT[:-1], ["total_ba", "standard_ba"], area))


# -- cleaning rules ---------------------------------------------------------------------------------------


@query
def distinct_area_sum(spark, sf):
    """Visits recorded in parts: the areas of distinct size add up."""
    part = F.when(F.col("o_orderkey") % 3 == 0, 3.0).otherwise(2.0)
    rows = b.visits(spark, sf).withColumn("area_m2", part).select("o_orderkey", "subplot", "year", "area_m2")
    return aggregates.sum_distinct_over(rows, ["subplot", "year"], "area_m2")


@query
def centered_year(spark, sf):
    return rounded(aggregates.center(b.base(spark, sf).select("subplot", "year", "oak_count"), "year"))


def _diameter() -> Column:
    text = F.col("l_quantity").cast("string")
    return F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_quantity") > 40, "0.1-5").when(
        F.col("l_tax") == 0, "abc").otherwise(text)


@query
def tolerant_threshold(spark, sf):
    rows = _items(spark, sf).withColumn("diameter", _diameter())
    kept = rows.where(nulls.tolerant_keep("diameter", 5, "0.1-5"))
    return aggregates.count_per(kept, ["diameter", "l_returnflag"], name="n")


@query
def exclusion_list(spark, sf):
    rows = b.visits(spark, sf).where(~nulls.in_set("year", [1995, 1996]) & (F.col("transect") != "FURNITURE"))
    out = filters.exclude_keys(rows, [
        {"site": "ASIA", "transect": "BUILDING", "plot": "NATION_2"},
        {"site": "AFRICA", "transect": "MACHINERY", "plot": ["NATION_0", "NATION_5", "NATION_10"]},
    ])
    return aggregates.count_per(out, ["site", "plot", "transect", "year"], name="n")


@query
def exclude_by_table(spark, sf):
    """Visits of orders none of whose items was returned."""
    returned = _items(spark, sf).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.exclude_key_table(b.visits(spark, sf), returned)


@query
def visit_year(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("no date")).otherwise(F.col("o_orderdate").cast("string"))
    rows = b.table(spark, sf, "orders").withColumn("year", scalar.year_of(text))
    return aggregates.count_per(rows, ["o_orderstatus", "year"], name="n")


@query
def blank_text(spark, sf):
    rows = _items(spark, sf).withColumn(
        "flag", scalar.blank_to_null(F.when(F.col("l_linestatus") == "F", F.lit("")).otherwise(F.col("l_returnflag")))
    )
    return aggregates.count_per(rows.withColumn("shown", F.coalesce("flag", F.lit("none"))), ["flag", "shown"], name="n")


@query
def complete_cases(spark, sf):
    return rounded(filters.complete_cases(b.base_with_covariates(spark, sf), ["canopy_openness", "pH", "total_ba"]))


@query
def nan_to_null(spark, sf):
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount") / F.nullif("l_tax", F.lit(0.0)))
    rows = columns.nan_to_null(_items(spark, sf).withColumn("ratio", ratio))
    return rounded(rows.groupBy("l_partkey").agg(F.count("ratio").alias("n"), F.avg("ratio").alias("mean_ratio")))


def _campaigns(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = b.seedlings(spark, sf)
    early, late = rows.where(F.col("year").isin(b.EARLY)), rows.where(~F.col("year").isin(b.EARLY))
    historic = zero_fill(early, b.VISIT, "species", b.FOCAL, b.EMPTY, weight="n")
    wide = b.zone_wide(spark, sf).select("site", "plot", "area_type", "total_ba", F.lit(1996).alias("year"))
    historic = joins.left_join_on(historic, wide, ["site", "plot", "year"], salts=16)
    current = zero_fill(late, b.VISIT, "species", b.FOCAL, b.EMPTY, weight="n")
    current = joins.left_join_on(current, b.canopy(spark, sf), {"subplot": "Subplot"})
    current = joins.join_unique(current, b.subplots(spark, sf).select("subplot", "pH"), ["subplot"])
    return historic, current


@query
def integrate_campaigns(spark, sf):
    return rounded(campaigns.integrate(*_campaigns(spark, sf)))


def _current(spark, sf) -> DataFrame:
    return campaigns.prepare_current(*study.current_inputs(spark, sf), study.CURRENT_SPECIES)


def _historic(spark, sf) -> DataFrame:
    return campaigns.prepare_historic(*study.historic_inputs(spark, sf), *study.tree_inputs(spark, sf), study.STANDING_SPECIES)


@query
def study_soil(spark, sf):
    """One soil sample per subplot: blank rows dropped, of several samples the one with a value."""
    return rounded(campaigns.repair_soil(study.current_inputs(spark, sf)[2]))


@query
def study_net_basal_area(spark, sf):
    """Basal area left per plot and zone after the harvest, by merged species, from diameters in mm."""
    return rounded(campaigns.net_basal_area(*study.tree_inputs(spark, sf), study.STANDING_SPECIES))


@query
def study_current(spark, sf):
    """The current campaign, prepared by the study's job."""
    return rounded(_current(spark, sf))


@query
def study_historic(spark, sf):
    """The earlier campaigns, prepared by the study's job."""
    return rounded(_historic(spark, sf))


@query
def study_tidy(spark, sf):
    """Both campaigns as one tidy table, counted per year, species, shoot flag and zone."""
    rows = campaigns.integrate(_historic(spark, sf), _current(spark, sf))
    ends = [F.count(F.lit(1)).alias("n"), F.sum("density").alias("density"), F.avg("pH").alias("pH"), F.avg("canopy_openness").alias("canopy_openness")]
    areas = [F.avg("total_ba").alias("total_ba"), F.avg("quercus_sp_ba").alias("quercus_sp_ba"), F.avg("betula_sp_ba").alias("betula_sp_ba")]
    return rounded(rows.groupBy("site", "year", "species", "shoot", "area_type").agg(*ends, *areas))


@query
def period_collapse(spark, sf):
    rows = b.base_with_covariates(spark, sf)
    keys = ["site", "plot", "treatment", "transect", "subplot", "area_m2"]
    return rounded(aggregates.collapse_period(rows, keys, {"early": b.EARLY}, "late", "oak_count", ["canopy_openness", "pH", "total_ba"]))


@query
def rate_per_visit(spark, sf):
    rows = b.base(spark, sf)
    return rounded(rows.select(
        "subplot", "year", scalar.rate("oak_count", "area_m2").alias("rate"), scalar.log_exposure("area_m2").alias("log_area"),
        scalar.per_ha("oak_count", F.col("area_m2") / 10000.0).alias("per_ha"),
        scalar.round_half_up(scalar.rate("oak_count", "area_m2")).alias("whole_rate"),
    ))


# -- sources and sinks ------------------------------------------------------------------------------------


def _write_eu(df: DataFrame, path: str) -> None:
    """A European file from given rows: decimal comma, blank for missing."""
    comma = [
        F.regexp_replace(F.col(c).cast("string"), r"\.", ",").alias(c) if t == "double"
        else F.col(c).cast("string").alias(c) for c, t in df.dtypes
    ]
    df.select(*comma).write.csv(path, sep=";", header=True, encoding="UTF-8")


@query
def scan_decimal_comma(spark, sf):
    rows = b.base_with_covariates(spark, sf).select("site", "subplot", "year", "oak_count", "canopy_openness", "pH")
    path = scratch_path(spark, "eu-csv")
    _write_eu(rows, path)
    return rounded(read_delim_eu(spark, path, rows.schema), 5)


@query
def scan_decimal_point(spark, sf):
    rows = _items(spark, sf).select(
        "l_orderkey", F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_returnflag")).alias("note"),
        "l_quantity", (F.col("l_returnflag") == "R").alias("shoot"),
    )
    path = scratch_path(spark, "point-csv")
    rows.write.csv(path, sep=";", header=True)
    return read_delim(spark, path, rows.schema).groupBy("note", "shoot").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query
def tidy_parquet(spark, sf):
    path = scratch_path(spark, "tidy")
    write_tidy(conditional_sum_keep_zero(spark, sf), path)
    return load_tidy(spark, path)


@query
def tidy_sorted(spark, sf):
    """The table sorted at the sink, and one site's later visits read back by range."""
    path = scratch_path(spark, "tidy-sorted")
    write_tidy(conditional_sum_keep_zero(spark, sf), path, partition_by=None, sort_by=["site", "plot", "transect", "subplot", "year"])
    return load_tidy(spark, path).where((F.col("site") == "EUROPE") & (F.col("plot") >= "NATION_13") & (F.col("year") >= 1996))


@query
def tidy_csv(spark, sf):
    rows = canopy_left_join(spark, sf).select("subplot", "oak_count", "canopy_openness", "year")
    path = scratch_path(spark, "tidy-csv")
    write_tidy(rows, path, "csv")
    return load_tidy(spark, path, "csv", rows.schema)


# -- figure tables ----------------------------------------------------------------------------------------


@query
def box_stats(spark, sf):
    return rounded(figures.box_stats(b.base(spark, sf), "oak_count", ["year", "treatment"]))


@query
def box_stats_price(spark, sf):
    """A continuous measure: here the values do not collapse."""
    return rounded(figures.box_stats(_items(spark, sf), "l_extendedprice", ["l_returnflag"]))


@query
def box_outliers(spark, sf):
    return rounded(figures.box_outliers(b.base(spark, sf), "oak_count", ["treatment"]))


@query
def linear_trend(spark, sf):
    return rounded(figures.linear_trend(b.base_with_covariates(spark, sf), "canopy_openness", "oak_count", ["year", "treatment"]))


@query
def trend_band(spark, sf):
    lines = figures.linear_trend(b.base_with_covariates(spark, sf), "pH", "oak_count", ["treatment"])
    return rounded(figures.trend_band(lines, 20))


@query
def others_trend(spark, sf):
    """Density of all species per visit against the basal area of the others."""
    every = b.filled(spark, sf).groupBy(*b.VISIT).agg(F.sum("density").alias("total_density"))
    rows = joins.left_join_on(b.base_with_covariates(spark, sf), every, list(b.VISIT))
    rows = rows.withColumn("others_ba", F.col("total_ba") - F.col("standard_ba"))
    return rounded(figures.linear_trend(rows, "others_ba", "total_density").drop("syy", "sxx", "sxy"))


@query
def point_layer(spark, sf):
    rows = b.base(spark, sf).withColumn("rate", F.col("oak_count") / F.col("area_m2"))
    return rounded(figures.point_layer(rows, "period", "rate", ["treatment"]))


# -- association ------------------------------------------------------------------------------------------


@query
def cor_test(spark, sf):
    return rounded(association.with_p(association.cor_test(b.base_with_covariates(spark, sf), "canopy_openness", "pH", ["period"])))


@query
def cor_matrix(spark, sf):
    pairs = association.cor_matrix(b.base_with_covariates(spark, sf), ["total_ba", "canopy_openness", "pH"])
    return rounded(association.with_p(pairs))


@query
def pairs_table(spark, sf):
    cols = ["oak_count", "canopy_openness", "pH", "total_ba", "standard_ba"]
    return rounded(association.pairs_table(b.base_with_covariates(spark, sf), cols, "treatment"))


@query
def pairs_histogram(spark, sf):
    return association.histogram(b.base_with_covariates(spark, sf), ["oak_count", "canopy_openness", "pH"], "treatment", 8)


# -- rates and models without random intercepts -----------------------------------------------------------


@query
def adjusted_rates(spark, sf):
    return rounded(contrasts.adjusted_rates(b.base(spark, sf), "oak_count", "area_m2", ["treatment", "period"]))


@query
def rate_ratios(spark, sf):
    rates = contrasts.adjusted_rates(b.base(spark, sf), "oak_count", "area_m2", ["treatment", "period"])
    return rounded(contrasts.rate_ratios(rates, ["period"], "treatment"))


def _poisson(terms, offset="area_m2", **kw) -> ModelSpec:
    return ModelSpec("oak_count", terms, offset, (), "poisson", **kw)


def _rows(spark, sf) -> DataFrame:
    """The base, kept as a table: a fit and its checks read it in several jobs."""
    return materialize(b.base(spark, sf))


def _covered(spark, sf) -> DataFrame:
    rows = b.base_with_covariates(spark, sf)
    return materialize(filters.complete_cases(rows, ["total_ba", "canopy_openness", "pH"]))


@query
def poisson_glm(spark, sf):
    m = fit_glm(_rows(spark, sf), _poisson(("treatment",)))
    return rounded(coef_table(spark, {"m": m}).select("term", "estimate", "std_error", "statistic", "p_value"))


@query
def poisson_glm_no_offset(spark, sf):
    m = fit_glm(_rows(spark, sf), _poisson(("treatment",), None))
    return rounded(coef_table(spark, {"m": m}).select("term", "estimate", "std_error", "statistic", "p_value"))


@query
def poisson_glm_saturated(spark, sf):
    m = fit_glm(_rows(spark, sf), _poisson(crossed("treatment", "period")))
    return rounded(coef_table(spark, {"m": m}).select("term", "estimate", "std_error", "statistic", "p_value"), 5)


@query
def poisson_glm_year_factor(spark, sf):
    m = fit_glm(_rows(spark, sf), _poisson(("year",), factors={"year": []}))
    return rounded(coef_table(spark, {"m": m}).select("term", "estimate", "std_error", "statistic", "p_value"), 5)


@query
def model_aic(spark, sf):
    rows = _rows(spark, sf)
    fits = {"offset": fit_glm(rows, _poisson(("treatment",))), "no_offset": fit_glm(rows, _poisson(("treatment",), None))}
    return rounded(fit_table(spark, fits).select("model", "n", "k", "aic"), 3)


@query
def overdispersion(spark, sf):
    rows = _rows(spark, sf)
    return rounded(diagnostics.overdispersion(rows, fit_glm(rows, _poisson(("treatment",)))), 5)


@query
def zero_inflation(spark, sf):
    rows = _rows(spark, sf)
    return rounded(diagnostics.zero_inflation(rows, fit_glm(rows, _poisson(("treatment",)))), 5)


@query
def residual_table(spark, sf):
    rows = _rows(spark, sf)
    return rounded(diagnostics.residual_table(rows, fit_glm(rows, _poisson(crossed("treatment", "period"))), 4), 5)


@query
def count_frequencies(spark, sf):
    rows = _rows(spark, sf)
    return rounded(diagnostics.count_frequencies(rows, fit_glm(rows, _poisson(("treatment",))), 12), 5)


@query
def count_frequencies_all(spark, sf):
    """As ``count_frequencies``, for every count up to the largest observed one."""
    rows = _rows(spark, sf)
    return rounded(diagnostics.count_frequencies(rows, fit_glm(rows, _poisson(crossed("treatment", "period")))), 5)


@query
def r2_methods(spark, sf):
    """R2 of a Poisson model by all three methods, with the mean of the null model."""
    rows = _rows(spark, sf)
    m, null = fit_glm(rows, _poisson(crossed("treatment", "period"))), fit_glm(rows, _poisson(()))
    return rounded(diagnostics.r2_nakagawa(rows, m, null_fit=null))


@query
def vif(spark, sf):
    return rounded(diagnostics.vif(b.base_with_covariates(spark, sf), ["canopy_openness", "pH"]))


def _gaussian_paths() -> list[ModelSpec]:
    return [
        ModelSpec("canopy_openness", ("total_ba",), family="gaussian", name="canopy"),
        ModelSpec("total_ba", ("pH",), family="gaussian", name="area"),
    ]


@query
def path_coefs(spark, sf):
    return rounded(paths.path_coefs(b.base_with_covariates(spark, sf), _gaussian_paths()), 5)


@query
def path_summary_linear(spark, sf):
    """Fisher's C of three equations, which leave three claims of independence; one scan serves them all."""
    rows = filters.complete_cases(b.base_with_covariates(spark, sf), ["total_ba", "canopy_openness", "pH"])
    focal = ModelSpec("standard_ba", ("total_ba",), family="gaussian", name="focal")
    return rounded(paths.path_summary(rows, [*_gaussian_paths(), focal]), 4)


@query
def indirect_effects(spark, sf):
    rows = b.base_with_covariates(spark, sf)
    return rounded(paths.indirect_effects(paths.path_coefs(rows, _gaussian_paths())), 5)


# -- iterative models: no SQL equivalent ------------------------------------------------------------------


def _mixed(terms, family="nb2", groups=PLACE, name="", offset="area_m2", response="oak_count_noshoots") -> ModelSpec:
    return ModelSpec(response, terms, offset, groups, family, name=name)


@query
def nb2_glm(spark, sf):
    return coef_table(spark, {"nb2": fit(_rows(spark, sf), _mixed(("treatment",), groups=()))})


@query
def glmm_poisson(spark, sf):
    m = fit_glmm(_rows(spark, sf), _mixed(("treatment",), "poisson", ("site", "transect", "subplot")))
    return coef_table(spark, {"poisson": m})


@query
def glmm_nb2(spark, sf):
    """The main model: treatment by period, intercepts for site, plot, transect and subplot."""
    return coef_table(spark, {"nb2": fit_glmm(_rows(spark, sf), _mixed(crossed("treatment", "period")))})


@query
def glmm_nb1(spark, sf):
    m = fit_glmm(_rows(spark, sf), _mixed(crossed("treatment", "period"), "nb1", ("site", "subplot")))
    return variance_table(spark, {"nb1": m})


@query
def glmm_gaussian(spark, sf):
    rows = materialize(b.base_with_covariates(spark, sf))
    spec = ModelSpec("canopy_openness", ("pH",), None, ("site", "plot"), "gaussian")
    return fit_table(spark, {"gaussian": fit_glmm(rows, spec)})


@query
def model_compare(spark, sf):
    """Ranking of nested Poisson models with R2 and information criteria."""
    rows = _rows(spark, sf)
    fits = {
        "treatment": fit(rows, _poisson(("treatment",))), "period": fit(rows, _poisson(("period",))),
        "both": fit(rows, _poisson(("treatment", "period"))), "crossed": fit(rows, _poisson(crossed("treatment", "period"))),
    }
    return rounded(diagnostics.compare_models(rows, fits), 4)


@query
def r2_marginal_means(spark, sf):
    """R2 by method and the marginal rates of one mixed model."""
    rows = _rows(spark, sf)
    m = fit_glmm(rows, _mixed(crossed("treatment", "period"), "nb2", ("site", "subplot")))
    r2 = diagnostics.r2_nakagawa(rows, m, ["lognormal"]).first()
    rates = contrasts.marginal_means(rows, m, ["treatment", "period"])
    return rates.withColumns({c: F.lit(r2[c]) for c in ("r2_marginal", "r2_conditional")})


@query
def path_summary(spark, sf):
    rows = _covered(spark, sf)
    specs = [
        ModelSpec("canopy_openness", ("total_ba",), None, ("site",), "gaussian"),
        ModelSpec("total_ba", ("pH",), None, ("site",), "gaussian"),
    ]
    return paths.path_summary(rows, specs)


def _study_bases(spark, sf) -> dict[str, DataFrame]:
    """The bases of the study's fits. The tidy table is kept as files, so each read takes only its columns."""
    tidy = Scratch(spark, "tidy").keep(b.tidy(spark, sf))
    area = zone_area(b.ZONE_AREAS, code="site", plot="plot")
    return study_bases(tidy, b.FOCAL, b.EARLY, area, keep=materialize)


@query
def modelling_bases(spark, sf):
    """All rows of all bases of the fit list, with the base's name."""
    both = [df.withColumn("base", F.lit(name)) for name, df in _study_bases(spark, sf).items()]
    out = both[0]
    for df in both[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return rounded(out)


@query
def model_registry(spark, sf):
    """One model over the base with and without shoots, fitted side by side."""
    rows = _rows(spark, sf)
    bases = {"all": rows.withColumn("oaks", F.col("oak_count")), "noshoots": rows.withColumn("oaks", F.col("oak_count_noshoots"))}
    specs = [(n, _mixed(("treatment", "period"), "nb2", ("site", "subplot"), "period", response="oaks")) for n in bases]
    return coef_table(spark, fit_registry(bases, specs))


@query
def study_registry(spark, sf):
    """The study's Poisson and gaussian fits over their bases; the models of a family share every pass."""
    specs = [(base, spec) for base, spec in all_specs() if spec.family in ("poisson", "gaussian")]
    bases = _study_bases(spark, sf)
    kept = side_by_side(spark, [partial(materialize, df) for df in bases.values()])
    return coef_table(spark, fit_registry(dict(zip(bases, kept, strict=True)), specs))


@query
def glmm_gaussian_site(spark, sf):
    """One random intercept: the profile likelihood has a closed form, so SQL can follow."""
    rows = materialize(b.base_with_covariates(spark, sf))
    m = fit_glmm(rows, ModelSpec("canopy_openness", ("pH",), None, ("plot",), "gaussian"), tol=1e-11)
    out = fit_table(spark, {"gaussian": m}).select("n", "k", "loglik", F.col("dispersion").alias("sigma"), "converged")
    return rounded(out.withColumns({"sd_plot": F.lit(m.sds[0]), "intercept": F.lit(float(m.beta[0])), "slope": F.lit(float(m.beta[1])), "aic": F.lit(float(m.aic))}), 4)
