"""Row filters. Key lists that are part of the study are compiled into the predicate, so they cost no join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.nulls import in_set, is_not


def without_value(df: DataFrame, col: str, value) -> DataFrame:
    """Drop the rows equal to ``value`` and keep those with a missing one."""
    return df.where(is_not(col, value))


def exclude_keys(df: DataFrame, keys: Sequence[Mapping[str, object]]) -> DataFrame:
    """Drop rows matching any of a fixed list of key patterns (a list value means any of its entries).

    A row whose match cannot be decided because a single-value key is missing is dropped, as in the study.
    """
    def test(pattern: Mapping[str, object]) -> Column:
        parts = [
            in_set(c, v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v)
            for c, v in pattern.items()
        ]
        return reduce(lambda a, b: a & b, parts)

    return df.where(reduce(lambda a, b: a & b, [~test(k) for k in keys]))


def exclude_key_table(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop rows whose key occurs in a key table of any size."""
    return df.join(keys.distinct(), list(keys.columns), "left_anti")


def drop_blank_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows without any key value, as left behind by blank lines at the end of a file."""
    return df.dropna(how="all", subset=list(keys))


def dedup_samples(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, then by the other columns, missing values last.

    Each task keeps its first row per key before the shuffle (the planner's group limit), so a key that holds a large
    share of all rows sends one row per task instead of being sorted whole by one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in [*order, *rest]])
    return df.withColumn("__rank", F.row_number().over(first)).where("__rank <= 1").drop("__rank")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value (neither NULL nor NaN) in every listed column."""
    return df.dropna(subset=list(cols))
