"""Left joins of the study. Missing keys match missing keys; every key test stays a hashable equality.

No side is marked for broadcast here. The adaptive planner broadcasts a side once its measured size is below
the session's threshold and otherwise shuffles both sides, so nothing depends on a guessed size. For a key
that may hold a large share of the left rows, ``salts`` spreads it: each left row gets a salt from a hash
of its content and the right side, which has one row per key, is repeated once per salt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_join_on(
    left: DataFrame, right: DataFrame, mapping: Mapping[str, str] | Sequence[str], salts: int = 1
) -> DataFrame:
    """Left join with keys named ``{left: right}`` (or alike); the right keys are not kept.

    Several right rows per key fan out, which is the contract of the zone join.
    """
    if not isinstance(mapping, Mapping):
        mapping = {k: k for k in mapping}
    values = [c for c in right.columns if c not in mapping.values()]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    r = right.select(*[F.col(rk).alias(f"__r{i}") for i, rk in enumerate(mapping.values())], *values)
    on: list[Column] = [left[lk].eqNullSafe(r[f"__r{i}"]) for i, lk in enumerate(mapping)]
    l_cols = left.columns
    if salts > 1:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in l_cols]), F.lit(salts)).cast("int")
        left = left.withColumn("__salt", spread)
        r = r.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = [left[lk].eqNullSafe(r[f"__r{i}"]) for i, lk in enumerate(mapping)]
        on.append(left["__salt"] == r["__rsalt"])
    joined = left.join(r, reduce(lambda a, b: a & b, on), "left")
    return joined.select(*[left[c] for c in l_cols], *[r[c] for c in values])


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing where a key occurs twice. The check is part of the plan, not an extra job."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    again = F.raise_error(F.lit(f"duplicate key in {list(keys)}")).cast("boolean")
    return df.withColumn("__n", number).where(F.when(F.col("__n") > 1, again).otherwise(True)).drop("__n")


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 1) -> DataFrame:
    """Left join that cannot add rows: a duplicate right key fails the job."""
    return left_join_on(left, unique_by(right, keys), keys, salts)


def join_coalesce(left: DataFrame, right: DataFrame, keys: Sequence[str], col: str, salts: int = 1) -> DataFrame:
    """Left join on a column both sides have: the left value, else the right one."""
    r = right.select(*keys, F.col(col).alias("__other"))
    joined = left_join_on(left, r, keys, salts)
    return joined.withColumn(col, F.coalesce(F.col(col), F.col("__other"))).drop("__other")


def decode(df: DataFrame, lookup: DataFrame, key: str, value: str, salts: int = 1) -> DataFrame:
    """Add the name that belongs to a code; an unknown code gives NULL."""
    return join_unique(df, lookup.select(key, value), [key], salts)
