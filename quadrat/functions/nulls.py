"""Columns that follow the study's missing-value rules where they differ from SQL's.

The study's rules: membership is never missing, a strict sum or mean is missing as soon as one input is,
the sum of an empty selection is zero, and a statistic of a constant column is missing instead of an error.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is false, never NULL, for a missing value; ranges become BETWEEN."""
    c = _col(c)
    if isinstance(values, range) and values.step == 1 and len(values):
        return F.coalesce(c.between(values[0], values[-1]), F.lit(False))
    return F.coalesce(c.isin(list(values)), F.lit(False))


def is_not(c: Column | str, value) -> Column:
    """True for every row but those equal to ``value``; a missing value stays in."""
    return ~_col(c).eqNullSafe(F.lit(value))


def strict_sum(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def strict_mean(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.count_if(c.isNull()) == 0, F.avg(c))


def sum_if(c: Column | str, predicate: Column) -> Column:
    """Sum over the rows where ``predicate`` holds; 0 when there are none, so the group stays."""
    return F.coalesce(F.sum(F.when(predicate, _col(c))), F.lit(0))


def any_true(predicate: Column) -> Column:
    """Any, with a missing test counted as not met."""
    return F.coalesce(F.bool_or(predicate), F.lit(False))


def none_true(predicate: Column) -> Column:
    """Not any; missing when some test is missing and none is met, so a filter drops the group."""
    return F.when(any_true(predicate), F.lit(False)).when(F.count_if(predicate.isNull()) == 0, F.lit(True))


def only(c: Column | str) -> Column:
    """The value shared by all rows of a group; fails where the group holds two different ones."""
    c = _col(c)
    low, high = F.min(c), F.max(c)
    return F.when(low.eqNullSafe(high), high).otherwise(
        F.raise_error(F.lit("a group holds several values where one was expected"))
    )


def nan_as_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs; NULL when one side is constant."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.try_divide(F.covar_pop(xx, yy), spread)


def tolerant_keep(c: Column | str, limit: float, class_label: str) -> Column:
    """Text measure that is missing, a number up to ``limit``, or the given class label."""
    c = _col(c)
    return F.coalesce(c.isNull() | (c.try_cast("double") <= F.lit(limit)) | (c == class_label), F.lit(False))
