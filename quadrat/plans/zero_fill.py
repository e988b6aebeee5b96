"""Zero-filling: every visit gets a row of the focal category, with 0 where none was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.aggregates import count_per


def zero_fill(
    df: DataFrame, keys: Sequence[str], category_col: str, focal: str, empty_marker: str,
    count_col: str = "density", shoot_col: str | None = "shoot", weight: str | None = None,
) -> DataFrame:
    """Counts per (visit, category, shoot), plus a focal row with 0 for visits marked empty or without focal rows.

    The rows are counted first, marker rows included. A visit is then a few rows, one per category and shoot
    flag, however many plants it had, so a window over it is small; its first row also emits the row to fill
    in. The input is scanned once.
    """
    keys = list(keys)
    extra = [shoot_col] if shoot_col else []
    counts = count_per(df.where(F.col(category_col).isNotNull()), [*keys, category_col, *extra], weight, count_col)
    found = F.col(category_col)
    visit = Window.partitionBy(*keys)
    first = F.row_number().over(visit.orderBy(category_col, *extra)) == 1
    missing = F.bool_or(found == empty_marker).over(visit) | ~F.bool_or(found == focal).over(visit)

    def row(category: Column, shoot: Column, count: Column) -> Column:
        parts = [category.alias(category_col), count.alias(count_col)]
        return F.struct(*parts, *([F.coalesce(shoot, F.lit(False)).alias(shoot_col)] if shoot_col else []))

    shoot = F.col(shoot_col) if shoot_col else F.lit(None)
    rows = F.array_compact(F.array(
        F.when(found != empty_marker, row(found, shoot, F.col(count_col))),
        F.when(F.col("__first") & F.col("__missing"), row(F.lit(focal), F.lit(False), F.lit(0).cast("long"))),
    ))
    flagged = counts.withColumns({"__first": first, "__missing": missing})
    out = flagged.select(*keys, F.explode(rows).alias("__row")).select(*keys, "__row.*")
    return out.select(*keys, category_col, *extra, count_col)
