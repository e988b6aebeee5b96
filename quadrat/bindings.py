"""Binding of the benchmark tables to the study's shape.

site > plot > transect > subplot is region > nation > market segment > customer; a visit is what a customer
ordered in a year; a seedling row is a line item with the part type as its species, and a returned item is a
shoot; an order without line items is a visit marked empty. Line items are also the trees: quantity is the
diameter, part size the section, and the supplier's nation the plot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.aggregates import count_per, visit_counts
from quadrat.operators.joins import left_join_on
from quadrat.plans.basal_area import species_area, widen
from quadrat.plans.zero_fill import zero_fill
from quadrat.plans.zones import assign_zone, zone_area

VISIT = ["site", "plot", "treatment", "year", "transect", "subplot", "area_m2"]
KEY = ["o_custkey", "year"]
TASK_ROWS = 500_000  # rows of items and orders that one task counts or joins
ORDER_PARTS = 16  # parts that an order's items are dealt in
FOCAL, EMPTY = "STANDARD", "0"
SPECIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
EARLY = [1995, 1996, 1997]
MEASURED = {
    "AFRICA": ["BUILDING", "MACHINERY"],
    "AMERICA": ["AUTOMOBILE", "HOUSEHOLD"],
    "ASIA": ["BUILDING", "FURNITURE"],
    "EUROPE": ["FURNITURE", "HOUSEHOLD"],
    "MIDDLE EAST": ["AUTOMOBILE", "MACHINERY"],
}
ZONES = [
    ("core", "AFRICA", None, [(1, 20)]),
    ("core", "AMERICA", None, [(1, 25)]),
    ("core", "ASIA", "NATION_2", [(5, 25)]),
    ("core", "ASIA", "NATION_7", None),
    ("core", "EUROPE", None, [(1, 10), (21, 30)]),
    ("core", "MIDDLE EAST", None, [(1, 25)]),
    ("extended", "AFRICA", "NATION_0", [(21, 40)]),
    ("extended", "AMERICA", "NATION_1", [(26, 30), (41, 45)]),
    ("extended", "ASIA", "NATION_2", [(26, 50)]),
    ("extended", "EUROPE", "NATION_3", [(31, 31)]),
]
ZONE_AREAS = [
    ("core", "AFRICA", None, 0.249),
    ("core", "AMERICA", None, 0.249),
    ("core", "ASIA", None, 0.3),
    ("core", "EUROPE", None, 0.3),
    ("core", "MIDDLE EAST", None, 0.249),
    ("extended", "AFRICA", "NATION_0", 0.332),
    ("extended", "AMERICA", "NATION_1", 0.083),
    ("extended", "ASIA", "NATION_2", 0.2),
    ("extended", "EUROPE", "NATION_3", 0.1),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    treatment = F.when(F.col("n_nationkey") % 2 == 0, "control").otherwise("thinned")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("site"), F.col("n_name").alias("plot"), treatment.alias("treatment")
    )


def subplots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: its place in the hierarchy, its area and its pH."""
    customer, place = table(spark, sf_dir, "customer"), plots(spark, sf_dir)
    return customer.join(place, customer.c_nationkey == place.n_nationkey).select(
        "c_custkey", "site", "plot", "treatment", F.col("c_mktsegment").alias("transect"),
        F.col("c_custkey").cast("string").alias("subplot"),
        F.when(F.col("c_custkey") % 4 == 0, 3.0).otherwise(5.0).alias("area_m2"),
        (F.col("c_acctbal") / 1000.0).alias("pH"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order."""
    orders, place = table(spark, sf_dir, "orders"), subplots(spark, sf_dir)
    return orders.join(place, orders.o_custkey == place.c_custkey).select(
        "o_orderkey", *[F.year("o_orderdate").alias("year") if c == "year" else c for c in VISIT]
    )


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the exchanges on the way to the counts, as many as the rows call for.

    The rows compress so well that partitions of a size in bytes would hold millions of them.
    """
    rows = sum(table(spark, sf_dir, name).count() for name in ("lineitem", "orders", "customer"))
    return math.ceil(rows / TASK_ROWS) or 1


def _found(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Counts ``n`` under customer and year, several per order, species and shoot flag; an order without items gets the empty marker.

    The items are counted per order before they meet the orders, so one large order is a few rows there. They are dealt before
    they are counted, in several parts per order: an order's items are few, so a count in the scan would hold nearly every row
    of its file split.
    """
    item, part, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    parts = parts or _parts(spark, sf_dir)
    share = F.pmod(F.xxhash64("l_partkey"), F.lit(ORDER_PARTS)).alias("share")
    found = item.join(part, item.l_partkey == part.p_partkey).select(
        "l_orderkey", share, F.col("p_type").alias("species"), (F.col("l_returnflag") == "R").alias("shoot")
    )
    dealt = found.repartition(parts, "l_orderkey", "share")
    counted = dealt.groupBy("l_orderkey", "share", "species", "shoot").agg(F.count(F.lit(1)).alias("n"))
    visit = orders.where(F.col("o_custkey").isNotNull()).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    visit, counted = visit.repartition(parts, "o_orderkey"), counted.repartition(parts, "l_orderkey")
    joined = visit.join(counted, visit.o_orderkey == counted.l_orderkey, "left")
    return joined.select(
        "o_orderkey", *KEY, F.coalesce("species", F.lit(EMPTY)).alias("species"), "shoot", F.coalesce("n", F.lit(1)).alias("n")
    )


def _counted(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Counts ``n`` under customer and year, a few per species and shoot flag, dealt by customer.

    They are counted in several parts per customer first, so one with very many orders is a few rows where it meets its place.
    """
    found = _found(spark, sf_dir, parts).withColumn("share", F.pmod(F.xxhash64("o_orderkey"), F.lit(ORDER_PARTS)))
    keys = [*KEY, "species", "shoot", "share"]
    return count_per(found.repartition(parts, *keys), keys, "n", "n").drop("share").repartition(parts, "o_custkey")


def _placed(spark: SparkSession, sf_dir: str, rows: DataFrame, count: str, parts: int) -> DataFrame:
    """The visit's columns in place of its key, dealt by subplot. A customer listed several times counts that often, as in a join before counting."""
    own = [c for c in VISIT if c != "year"]
    customer = subplots(spark, sf_dir).repartition(parts, "c_custkey")
    place = customer.groupBy("c_custkey", *own).agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(place, rows.o_custkey == place.c_custkey).select(
        *VISIT, "species", "shoot", (F.col(count) * F.col("copies")).alias(count)
    ).repartition(parts, "subplot")


def seedlings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts ``n`` per visit, species and shoot flag, the empty marker of orders without items among the species."""
    parts = _parts(spark, sf_dir)
    return _placed(spark, sf_dir, count_per(_counted(spark, sf_dir, parts), [*KEY, "species", "shoot"], "n", "n"), "n", parts)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled counts per visit, species and shoot flag.

    Counted and filled under the key, a few numbers a row; the place's texts would fill a task's memory there.
    """
    parts = _parts(spark, sf_dir)
    rows = zero_fill(_counted(spark, sf_dir, parts), KEY, "species", FOCAL, EMPTY, weight="n")
    return _placed(spark, sf_dir, rows, "density", parts)


def canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reading per customer; most customers have none."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("Subplot")).agg(
        F.avg("value").alias("canopy_openness")
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit: focal counts with and without shoots, and the period."""
    counts = visit_counts(filled(spark, sf_dir), VISIT, FOCAL)
    return counts.withColumn("period", F.when(F.col("year").isin(EARLY), "early").otherwise("late"))


def base_with_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with canopy (a few subplots only), pH and the basal area of the core zone of the plot."""
    ph = subplots(spark, sf_dir).select("subplot", "pH")
    out = left_join_on(base(spark, sf_dir), canopy(spark, sf_dir), {"subplot": "Subplot"})
    out = left_join_on(out, ph, ["subplot"])
    core = zone_wide(spark, sf_dir).where(F.col("area_type") == "core")
    return left_join_on(out, core.select("site", "plot", "total_ba", "standard_ba"), ["site", "plot"], salts=16)


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems ``stems`` per plot, species, section, diameter and removal flag, counted before the place is joined."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier, place = table(spark, sf_dir, "supplier"), plots(spark, sf_dir).drop("treatment")
    counted = (
        item.join(part, item.l_partkey == part.p_partkey)
        .groupBy(
            "l_suppkey", F.col("p_type").alias("species"), F.col("p_size").alias("section"),
            F.col("l_quantity").alias("diameter"), (F.col("l_returnflag") == "A").alias("removed"),
        )
        .agg(F.count(F.lit(1)).alias("stems"))
    )
    where = supplier.join(place, supplier.s_nationkey == place.n_nationkey).select("s_suppkey", "site", "plot")
    return counted.join(where, counted.l_suppkey == where.s_suppkey).select(
        "site", "plot", "species", "section", "diameter", "removed", "stems"
    )


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_zone(trees(spark, sf_dir), ZONES, "site", "plot", "section")


def zone_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basal area per plot, zone and species, per hectare of the zone."""
    long = species_area(zoned(spark, sf_dir), ["site", "plot", "area_type"], "species", "diameter", "cm", "stems")
    return long.withColumn("basal_area", F.col("basal_area") / zone_area(ZONE_AREAS, code="site", plot="plot"))


def zone_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(zone_long(spark, sf_dir), ["site", "plot", "area_type"], levels=SPECIES)


def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tidy table: counts per visit, species and shoot flag with covariates, once per zone of the plot."""
    ph = subplots(spark, sf_dir).select("subplot", "pH")
    rows = left_join_on(filled(spark, sf_dir), canopy(spark, sf_dir), {"subplot": "Subplot"})
    rows = left_join_on(rows, ph, ["subplot"])
    wide = zone_wide(spark, sf_dir).select("site", "plot", "area_type", "total_ba", F.col("standard_ba").alias("quercus_sp_ba"))
    return left_join_on(rows, wide, ["site", "plot"], salts=16)
