"""Zone tagging and zone areas. The rules are a fixed short list, so they compile to one predicate per zone
and need no join; a rule set kept in a table goes through :func:`assign_zone_table`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.scalar import when_chain


def _matches(rule, code: str, plot: str, section: str) -> Column:
    _, code_value, plot_value, ranges = rule
    test = F.col(code) == code_value
    if plot_value is not None:
        test = test & (F.col(plot) == plot_value)
    if ranges is not None:
        test = test & reduce(lambda a, b: a | b, [F.col(section).between(lo, hi) for lo, hi in ranges])
    return test


def assign_zone(
    df: DataFrame, rules: Sequence[tuple], code: str = "Omrkod", plot: str = "Yta", section: str = "BSektion",
    zone: str = "area_type",
) -> DataFrame:
    """Rows that fall in a zone, tagged with it; a row in two zones appears in both. One scan, no shuffle."""
    names = list(dict.fromkeys(r[0] for r in rules))
    tags = [
        F.when(reduce(lambda a, b: a | b, [_matches(r, code, plot, section) for r in rules if r[0] == name]), F.lit(name))
        for name in names
    ]
    return df.withColumn(zone, F.explode(F.array_compact(F.array(*tags))))


def assign_zone_table(
    df: DataFrame, rules: DataFrame, code: str = "Omrkod", plot: str = "Yta", section: str = "BSektion",
    zone: str = "area_type", bin_width: int = 16,
) -> DataFrame:
    """The same with rules in a table (code, plot or NULL, lo, hi, zone): equal code, section within bounds.

    A rule is cut into bins of ``bin_width`` sections and met by equal code and bin, so the join hashes both sides whatever
    the number of rules of a code; the exact bounds follow. Rows with the same code, plot and section meet the same rules, so only
    the distinct combinations are joined. A section in two zones appears in both, once each; a rule without a bound or with its
    bounds the wrong way round holds nothing.
    """
    def slot(value: Column) -> Column:
        return F.floor(value / bin_width)

    combos = df.select(code, plot, section).distinct().withColumn("bin", slot(F.col(section))).alias("d")
    bins = F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi"))))
    r = rules.where(F.col("lo") <= F.col("hi")).withColumn("bin", bins).alias("r")
    same = (F.col(f"d.{code}") == F.col("r.code")) & (F.col("d.bin") == F.col("r.bin"))
    inside = F.col(f"d.{section}").between(F.col("r.lo"), F.col("r.hi"))
    here = F.col("r.plot").isNull() | (F.col("r.plot") == F.col(f"d.{plot}"))
    hit = combos.join(r, same & inside & here)
    hit = hit.select(*[F.col(f"d.{c}").alias(c) for c in (code, plot, section)], F.col("r.zone").alias(zone)).distinct()
    return df.join(hit, [code, plot, section])


def zone_area(
    areas: Sequence[tuple], zone: str = "area_type", code: str = "Omrkod", plot: str = "Yta",
    names: dict[str, str] | None = None,
) -> Column:
    """Area of the row's zone in hectares, NULL where none is defined. ``names`` maps codes to site names."""
    branches = []
    for zone_value, code_value, plot_value, area in areas:
        test = (F.col(zone) == zone_value) & (F.col(code) == (names or {}).get(code_value, code_value))
        if plot_value is not None:
            test = test & (F.col(plot) == plot_value)
        branches.append((test, area))
    return when_chain(branches)
