"""Column bookkeeping: order, names, masks and recoding. All narrow, no shuffle."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nulls import nan_as_null


def lead_columns(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in (*cols, *[c for c in df.columns if c not in cols])])


def map_columns(df: DataFrame, pick: Callable[[str, str], bool], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every column for which ``pick(name, type)`` holds."""
    return df.select(
        *[(fn(F.col(f"`{c}`")) if pick(c, t) else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes]
    )


def allowed_pairs(allowed: Mapping[str, Sequence[str]], outer: str, inner: str) -> Column:
    """Test for (outer, inner) pairs in a fixed whitelist; false for missing values."""
    tests = [(F.col(outer) == o) & F.col(inner).isin(list(values)) for o, values in allowed.items()]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def mask_columns(df: DataFrame, suffix: str, keep: Column) -> DataFrame:
    """Blank every column with the suffix on the rows where ``keep`` does not hold."""
    return map_columns(df, lambda c, _: c.endswith(suffix), lambda c: F.when(keep, c))


def nan_to_null(df: DataFrame) -> DataFrame:
    return map_columns(df, lambda _, t: t in ("double", "float"), nan_as_null)


def clean_name(name: str) -> str:
    """snake_case in ASCII, punctuation dropped, camel case split."""
    name = unicodedata.normalize("NFKD", name.replace("%", "_percent_").replace("#", "_number_"))
    name = "".join(c for c in name if not unicodedata.combining(c))
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    return f"x{name}" if name[:1].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    """Clean every column name; a name met again gets a counter."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = clean_name(c)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str]) -> DataFrame:
    keep = set(keep)
    return df.toDF(*[c if c in keep else f"{c}{suffix}" for c in df.columns])


def recode(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace listed values and keep the others."""
    return df.replace(dict(mapping), subset=[col])


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all inputs, aligned by name; a column absent from one input is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
