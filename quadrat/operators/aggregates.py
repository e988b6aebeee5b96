"""Grouped statistics. All are aggregates with a map-side part, joined back where the rows must stay.

No window runs over raw rows: a key holding a third of them would put them in one task. The one window here
runs over counted rows, a handful per visit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.nulls import in_set, is_not, only, strict_sum, sum_if
from quadrat.functions.scalar import round_half_up
from quadrat.operators.joins import left_join_on

MAX_PIVOT_LEVELS = 10_000


def count_per(df: DataFrame, keys: Sequence[str], weight: str | None = None, name: str = "density") -> DataFrame:
    """Rows per key; with ``weight`` the input is already counted and the counts are added up."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(n.cast("long").alias(name))


def sum_counts(
    df: DataFrame, keys: Sequence[str], col: str, name: str, species_col: str = "species",
    species: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """Sum of counts per visit: of one species, of all, or of all but one."""
    if species is not None:
        df = df.where(F.col(species_col) == species)
    if exclude is not None:
        df = df.where(F.col(species_col) != exclude)
    return df.groupBy(*keys).agg(strict_sum(col).alias(name))


def visit_counts(
    df: DataFrame, keys: Sequence[str], focal: str, covariates: Sequence[str] = (), col: str = "density",
    species_col: str = "species", shoot_col: str = "shoot",
) -> DataFrame:
    """Focal count per visit with and without shoots, in one aggregate.

    Shoots are left out inside the sum, so a visit with shoots only stays with a zero.
    """
    return df.where(F.col(species_col) == focal).groupBy(*keys).agg(
        strict_sum(col).alias("oak_count"),
        sum_if(col, ~F.col(shoot_col)).cast("long").alias("oak_count_noshoots"),
        *[only(c).alias(c) for c in covariates],
    )


def with_group_value(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Attach a group statistic to every row of its group."""
    stat = df.groupBy(*keys).agg(value.alias(name))
    return left_join_on(df.drop(name), stat, list(keys))


def with_total(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    return with_group_value(df, keys, strict_sum(col), name)


def sum_distinct_over(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Replace a column by the sum of its distinct values in the group.

    Two parts of equal size count once, as in the study. One missing part makes the sum missing.
    """
    total = F.when(F.count_if(F.col(col).isNull()) == 0, F.sum_distinct(F.col(col)))
    order = df.columns
    stat = df.groupBy(*keys).agg(total.alias("__total"))
    return left_join_on(df, stat, list(keys)).withColumn(col, F.col("__total")).select(*order)


def center(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Subtract the mean over all rows, taken as a scalar subquery; missing if any value is missing."""
    mean = df.agg(F.when(F.count_if(F.col(col).isNull()) == 0, F.avg(col)).alias("m")).scalar()
    return df.withColumn(name or f"{col}_c", F.col(col) - mean)


def pivot_levels(df: DataFrame, names: str) -> list[str | None]:
    """Levels of a column, sorted. The number of output columns is checked, as every level becomes one."""
    rows = df.select(names).distinct().limit(MAX_PIVOT_LEVELS + 1).collect()
    if len(rows) > MAX_PIVOT_LEVELS:
        raise ValueError(f"{names} has more than {MAX_PIVOT_LEVELS} levels")
    return sorted((r[0] for r in rows), key=lambda v: (v is None, v))


def pivot_fill(
    df: DataFrame, keys: Sequence[str], names: str, values: str, levels: Sequence[str | None] | None = None, fill=0.0,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Long to wide: an absent cell gets ``fill``, a cell that is present but missing stays missing.

    ``also`` lists further aggregates over the same groups, computed along the way.
    """
    levels = pivot_levels(df, names) if levels is None else levels

    def cell(level) -> Column:
        here = F.col(names).eqNullSafe(F.lit(level))
        value = F.when(F.count_if(here) == 0, F.lit(fill)).otherwise(F.max(F.when(here, F.col(values))))
        return value.alias("NA" if level is None else level)

    return df.groupBy(*keys).agg(*also, *[cell(v) for v in levels])


def collapse_period(
    df: DataFrame, keys: Sequence[str], mapping: Mapping[str, Sequence[int]], default: str, count: str,
    covariates: Sequence[str], year: str = "year",
) -> DataFrame:
    """Years to periods: the count is the mean rounded half up, covariates are means of what is there."""
    period = F.lit(default)
    for label, years in mapping.items():
        period = F.when(in_set(year, years), F.lit(label)).otherwise(period)
    mean_count = F.when(F.count_if(F.col(count).isNull()) == 0, F.avg(count))
    return df.withColumn("period", period).groupBy(*keys, "period").agg(
        round_half_up(mean_count).cast("long").alias(count), *[F.avg(c).alias(c) for c in covariates]
    )


def weighted_zone_mean(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], area: Column, zone: str = "area_type",
    core: str = "core", extended: str = "extended",
) -> DataFrame:
    """Area-weighted mean over the core and the extended zone, written to the rows that remain.

    With an extended row in the group: (core * a1 + extended * a2) / (a1 + a2). With a core row only: the core
    value. With neither: the value as it is. Extended rows, which repeat the visit, are then dropped.

    The input is the tidy table, whose key ends in species, shoot flag and zone, so a visit is a few rows and a
    window over it stays small.
    """
    group = Window.partitionBy(*keys)
    in_core, in_ext = F.col(zone) == core, F.col(zone) == extended

    def over(value: Column, test: Column | None = None) -> Column:
        return F.max(value if test is None else F.when(test, value)).over(group)

    d = df.withColumn("__a", area)
    d = d.withColumns({
        "__ext": F.coalesce(F.bool_or(in_ext).over(group), F.lit(False)),
        "__core": F.coalesce(F.bool_or(in_core).over(group), F.lit(False)),
        "__ac": over(F.col("__a"), in_core), "__ae": over(F.col("__a"), in_ext),
        **{f"__c_{c}": over(F.col(c), in_core) for c in cols},
        **{f"__e_{c}": over(F.col(c), in_ext) for c in cols},
        **{f"__any_{c}": over(F.col(c)) for c in cols},
    })
    new = {}
    for c in cols:
        both = F.col(f"__c_{c}") * F.col("__ac") + F.col(f"__e_{c}") * F.col("__ae")
        new[c] = (
            F.when(F.col("__ext"), both / (F.col("__ac") + F.col("__ae")))
            .when(F.col("__core"), F.col(f"__c_{c}"))
            .otherwise(F.col(f"__any_{c}"))
        )
    return d.where(is_not(zone, extended)).withColumns(new).select(*df.columns)
