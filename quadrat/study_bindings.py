"""Binding of the benchmark tables to the inputs of the study's own jobs, with the study's names and codes.

A region is a site and the parity of the nation its plot; the market segment is the transect and the customer number modulo 6 the
subplot, so customers share subplots and a visit has several parts. Orders before 2000 are the earlier campaigns, six years
later; the others the current one. An item is a plant, its part type the species and a returned item a shoot; every item is a tree too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.bindings import table
from quadrat.plans import study_values as v

# (site, area code, plot of even nations, plot of odd nations) by region.
SITES = {
    "AFRICA": ("Karla", "KAR", "NV", "SO"),
    "AMERICA": ("Rya åsar", "RYA", "NO", "SV"),
    "ASIA": ("Sandviksås", "SAN", "V", "Ö"),
    "EUROPE": ("Skölvene", "SKÖ", "V", "Ö"),
    "MIDDLE EAST": ("Östadkulle", "ÖST", "V", "Ö"),
}
TRANSECTS = {"BUILDING": "NV45", "MACHINERY": "SO55", "AUTOMOBILE": "V55", "FURNITURE": "Ö55", "HOUSEHOLD": "Ö75"}
# (tree code, name) by part type; SMALL and LARGE are merged into one species by the study's list.
SPECIES = {
    "ECONOMY": (1, "Pinus sylvestris"), "LARGE": (2, "Betula pendula"), "MEDIUM": (3, "Salix caprea"),
    "PROMO": (4, v.SPECIES_LEFT_OUT), "SMALL": (5, "Betula pubescens"), "STANDARD": (6, v.FOCAL_SPECIES),
}
CURRENT_SPECIES = sorted(name for _, name in SPECIES.values())
STANDING_SPECIES = sorted(["Betula sp.", "Pinus sylvestris", v.FOCAL_SPECIES, v.SPECIES_LEFT_OUT, "Salix sp."])
FIRST_CURRENT = 2000
YEARS_LATER = 6


def _pick(col: str, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(col)]


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    even = F.col("n_nationkey") % 2 == 0
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", _pick("r_name", {r: s[0] for r, s in SITES.items()}).alias("site"),
        _pick("r_name", {r: s[1] for r, s in SITES.items()}).alias("Omrkod"),
        F.when(even, _pick("r_name", {r: s[2] for r, s in SITES.items()})).otherwise(_pick("r_name", {r: s[3] for r, s in SITES.items()})).alias("plot"),
        F.when(even, "control").otherwise("thinned").alias("treatment"),
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, place = table(spark, sf_dir, "customer"), plots(spark, sf_dir)
    number = F.col("c_custkey") % 6
    return customer.join(place, customer.c_nationkey == place.n_nationkey).select(
        "c_custkey", "site", "plot", "treatment", _pick("c_mktsegment", TRANSECTS).alias("transect"),
        F.when(number == 0, v.SUBPLOT_LEFT_OUT).otherwise(number.cast("string")).alias("subplot"),
    )


def _plants(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """One row per item; an order without items is a visit marked empty."""
    orders, item, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    kind = item.join(part, item.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("flag"), _pick("p_type", {k: s for k, (_, s) in SPECIES.items()}).alias("name")
    )
    year = F.year("o_orderdate")
    orders = orders.where(year >= FIRST_CURRENT if current else year < FIRST_CURRENT)
    place = spots(spark, sf_dir)
    rows = orders.join(place, orders.o_custkey == place.c_custkey)
    return rows.join(kind, rows.o_orderkey == kind.l_orderkey, "left").withColumn("species", F.coalesce("name", F.lit(v.EMPTY_MARKER)))


def current_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Seedlings, canopy readings, soil samples and trees, as ``prepare_current`` reads them."""
    place = ["site", "plot", "treatment", "transect", "subplot"]
    seedlings = _plants(spark, sf_dir, True).select(*place, "species", F.when(F.col("flag") == "R", v.SHOOT_NOTES[1]).alias("notes"))
    events, spot = table(spark, sf_dir, "events"), spots(spark, sf_dir)
    canopy = events.join(spot, events.user_id == spot.c_custkey).select(
        *[F.col(c).alias(c.capitalize()) for c in place], F.col("value").alias("Canopy openness (%)")
    )
    orders = table(spark, sf_dir, "orders")
    blank = F.col("o_orderstatus") == "P"
    soil = orders.join(spot, orders.o_custkey == spot.c_custkey).select(
        *[F.when(~blank, F.col(c)).alias(c) for c in place], F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 1e5).alias("pH"),
        F.col("o_orderpriority").alias("10g_measurement"),
    )
    item, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    home = supplier.join(plots(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    trees = item.join(part, item.l_partkey == part.p_partkey).join(home, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "site", "plot", "treatment", _pick("p_type", {k: s for k, (_, s) in SPECIES.items()}).alias("species"), F.col("l_quantity").alias("diameter_cm")
    )
    return seedlings, canopy, soil, trees


def tree_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standing trees, harvested trees and the species codes, as ``net_basal_area`` reads them."""
    item, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    home = supplier.join(plots(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    trees = item.join(part, item.l_partkey == part.p_partkey).join(home, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "Omrkod", F.col("plot").alias("Yta"), (F.col("p_size") * 25).alias("BSektion"),
        _pick("p_type", {k: n for k, (n, _) in SPECIES.items()}).alias("Tradartkod"), (F.col("l_quantity") * 10).alias("Diameter"),
        (F.col("l_linenumber") % 3 + 1).alias("Antal"), F.col("l_returnflag").alias("flag"),
    )
    codes = part.select("p_type").distinct().select(
        _pick("p_type", {k: n for k, (n, _) in SPECIES.items()}).alias("Tradartkod"), _pick("p_type", {k: s for k, (_, s) in SPECIES.items()}).alias("Trad_lati")
    )
    return trees.drop("flag"), trees.where("flag = 'A'").drop("flag"), codes


def historic_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Plants of the earlier campaigns and the canopy readings kept apart from them."""
    rows = _plants(spark, sf_dir, False)
    line, size = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    old = rows.select(
        F.concat((F.year("o_orderdate") + YEARS_LATER).cast("string"), F.lit("-07-01")).alias("date"),
        "site", "plot", "treatment", "transect", "subplot", "species",
        F.when(F.col("o_orderkey") % 3 == 0, 3.0).otherwise(2.0).alias("area_m2"),
        F.when(F.col("subplot") == "1", 20.0).alias("canopy_openness"),
        F.when(F.col("plot") == "V", 4.5).otherwise(5.5).alias("pH"), (F.col("flag") == "R").alias("shoot"),
        (F.col("o_orderpriority") == "5-LOW").alias("in_exclosure"),
        F.when(line == 1, "").when(size > 40, v.SMALL_DIAMETER_CLASS).otherwise((size % 10).cast("string")).alias("diameter_cm"),
    )
    events, spot = table(spark, sf_dir, "events"), spots(spark, sf_dir)
    canopy = events.join(spot, events.user_id == spot.c_custkey).groupBy("site", "plot", "transect", "subplot").agg(F.avg("value").alias("canopy_openness"))
    return old, canopy.withColumn("year", F.lit(v.TREE_YEAR))
