"""Scalar helpers of the cleaning and rate steps; every one is a plain Column expression."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.nulls import _col, in_set

MM_PER_M, CM_PER_M = 1000.0, 100.0


def when_chain(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """First branch whose test holds; NULL when none does and no default is given."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    (test, value), *rest = branches
    out = F.when(test, lit(value))
    for test, value in rest:
        out = out.when(test, lit(value))
    return out if default is None else out.otherwise(lit(default))


def merge_levels(c: Column | str, merged: Mapping[str, Sequence[str]]) -> Column:
    """Replace each listed level by the name it is merged into and keep all others."""
    c = _col(c)
    return when_chain([(in_set(c, olds), new) for new, olds in merged.items()], default=c)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def year_of(c: Column | str) -> Column:
    """Year of a date, timestamp or ISO text; NULL where the text is no date."""
    return F.year(F.try_to_date(_col(c).cast("string").substr(1, 10)))


def tolerant_double(c: Column | str) -> Column:
    """Number in a text column, NULL where the text is none."""
    return _col(c).try_cast("double")


def circle_area(diameter: Column | str, unit: str = "cm", stems: Column | str | None = None) -> Column:
    """Stem cross-section in square metres from a diameter in cm or mm, times the number of stems."""
    per_m = {"cm": CM_PER_M, "mm": MM_PER_M}[unit]
    area = F.lit(math.pi) * F.pow(_col(diameter) / F.lit(per_m) / F.lit(2.0), F.lit(2.0))
    return area if stems is None else area * _col(stems)


def per_ha(x: Column | str, area_ha: Column | float) -> Column:
    return _col(x) / (area_ha if isinstance(area_ha, Column) else F.lit(float(area_ha)))


def rate(count: Column | str, exposure: Column | str) -> Column:
    return _col(count) / _col(exposure)


def round_half_up(c: Column | str) -> Column:
    """floor(x + 0.5): unlike SQL's round it sends -2.5 to -2."""
    return F.floor(_col(c) + F.lit(0.5))


def log_exposure(area: Column | str) -> Column:
    return F.log(_col(area))
