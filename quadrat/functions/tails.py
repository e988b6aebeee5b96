"""Tail probabilities for test statistics, for single values and, as plain expressions, for result columns.

The columns are evaluated in the JVM: series and continued fractions are an ``aggregate`` over as many steps as their
argument needs, which grow with the square root of the degrees of freedom.
"""

from __future__ import annotations

import math

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054

# Beyond this many degrees of freedom Student's t is taken to the normal tail by a transform that is exact to rounding there.
LARGE_DF = 1e7
_TINY = 1e-300


def normal_p(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided Student t p-value."""
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p >= 0.5, by bisection on the tail."""
    lo, hi = 0.0, 1.0
    while t_p(hi, df) > 2.0 * (1.0 - p):
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if t_p(mid, df) > 2.0 * (1.0 - p) else (lo, mid)
    return 0.5 * (lo + hi)


def chi2_p(x: float, df: float) -> float:
    """Upper tail of chi-square."""
    a, x = df / 2.0, x / 2.0
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b or tiny)
        c = b + num / c or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def normal_p_col(z: Column) -> Column:
    """Two-sided normal tail as a plain expression.

    Up to 3, one minus the odd power series of the centre; beyond, the mean of ``exp(-z^2 / (2 sin^2 t))`` over a quarter turn,
    which 64 midpoints give to full precision.
    """
    z = F.abs(z.cast("double"))
    series, odd = [], 1.0
    for n in range(60):
        odd *= 2 * n + 1
        series.append(1.0 / odd)
    centre = F.aggregate(F.array(*map(F.lit, reversed(series))), F.lit(0.0), lambda acc, c: acc * z * z + c)
    near = F.lit(1.0) - centre * z * F.exp(-z * z / 2) * F.lit(2.0 / math.sqrt(2.0 * math.pi))
    turns = F.array(*(F.lit(0.5 / math.sin((k + 0.5) * math.pi / 128) ** 2) for k in range(64)))
    far = F.aggregate(turns, F.lit(0.0), lambda acc, w: acc + F.exp(-z * z * w)) / 64
    return F.when(z <= 3.0, near).otherwise(far)


def _stirling_rest(z: Column) -> Column:
    """What log-gamma adds to Stirling's formula, for z from 8 on."""
    w = F.lit(1.0) / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def _lgamma(x: Column) -> Column:
    z, product = x + 8.0, x
    for k in range(1, 8):
        product = product * (x + float(k))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + _stirling_rest(z) - F.ln(product)


def _steps(scale: Column, factor: float) -> Column:
    """1, 2, .. up to a fixed part and a part that grows with the square root of the scale."""
    return F.sequence(F.lit(1), (F.lit(80.0) + F.lit(factor) * F.sqrt(scale)).cast("int"))


def _apart(x: Column) -> Column:
    return F.when(F.abs(x) > _TINY, x).otherwise(F.lit(_TINY))


def _fraction(steps: Column, b0: Column, top, bottom) -> Column:
    """Value of 1 / (b0 + top(1) / (bottom(1) + top(2) / (bottom(2) + ..))) by Lentz's forward steps."""
    def state(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def step(acc: Column, i: Column) -> Column:
        # Two nested structs: c and d are made once and h from them.
        num, den = top(i.cast("double")), bottom(i.cast("double"))
        c, d = _apart(den + num / acc["c"]), F.lit(1.0) / _apart(den + num * acc["d"])
        return F.aggregate(F.array(F.struct(c.alias("c"), d.alias("d"))), acc, lambda old, new: state(new["c"], new["d"], old["h"] * new["c"] * new["d"]))

    d0 = F.lit(1.0) / _apart(b0)
    return F.aggregate(steps, state(F.lit(1.0 / _TINY), d0, d0), step, lambda acc: acc["h"])


def _beta_part(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function."""
    def top(i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return _fraction(_steps(F.greatest(a, b), 6.0), F.lit(1.0), top, lambda i: F.lit(1.0))


def t_p_col(t: Column, df: Column) -> Column:
    """Two-sided Student t tail as a plain expression; NULL where t or the degrees of freedom are missing or not positive."""
    t, df = F.abs(t.cast("double")), df.cast("double")
    a, half = df / 2.0, F.lit(0.5)
    log_x = -F.log1p(t * t / df)
    x, rest = df / (df + t * t), t * t / (df + t * t)
    w = F.lit(1.0) / a
    far = half * F.ln(a) - w / 8 + w * w * w / 192 - w * w * w * w * w / 640
    ratio = F.when(a > 20.0, far).otherwise(_lgamma(a + 0.5) - _lgamma(a))
    front = F.exp(ratio - 0.5 * math.log(math.pi) + a * log_x + half * F.ln(rest))
    beta = F.when(t == 0.0, F.lit(1.0)).when(
        x < (a + 1.0) / (a + 2.5), front * _beta_part(a, half, x) / a
    ).otherwise(F.lit(1.0) - front * _beta_part(half, a, rest) / 0.5)
    z = (df * 8.0 + 1.0) / (df * 8.0 + 3.0) * F.sqrt(df * F.log1p(t * t / df))
    return F.when(df > LARGE_DF, normal_p_col(z)).when(df > 0.0, beta)


def t_quantile_col(p: float, df: Column) -> Column:
    """Upper quantile for p >= 0.5 by Newton steps on the two-sided tail.

    The steps start at the normal quantile, which is too small, and the tail is convex, so they rise to the root.
    """
    df, start = df.cast("double"), NormalDist().inv_cdf(p)
    a = df / 2.0
    log_density = _lgamma(a + 0.5) - _lgamma(a) - 0.5 * F.ln(df * math.pi)

    def step(t: Column, _: Column) -> Column:
        density = F.exp(log_density - (a + 0.5) * F.log1p(t * t / df))
        return t + (t_p_col(t, df) - 2.0 * (1.0 - p)) / (density * 2.0)

    steps = F.sequence(F.lit(1), F.when(df < 5.0, F.lit(40)).otherwise(F.lit(12)))
    return F.when(df > 0.0, F.aggregate(steps, F.lit(start), step))


def chi2_p_col(x: Column, df: Column) -> Column:
    """Upper tail of chi-square as a plain expression."""
    a, x = df.cast("double") / 2.0, x.cast("double") / 2.0
    off = (x - a) / a
    large = -a * (off - F.log1p(off)) + 0.5 * F.ln(a / (2.0 * math.pi)) - _stirling_rest(a)
    front = F.exp(F.when(a > 16.0, large).otherwise(a * F.ln(x) - x - _lgamma(a)))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * x / (a + i.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    first = F.lit(1.0) / a
    series = F.aggregate(_steps(a, 9.0), F.struct(first.alias("term"), first.alias("total")), add, lambda acc: acc["total"])
    fraction = _fraction(_steps(a, 9.0), x + 1.0 - a, lambda i: -i * (i - a), lambda i: x + 1.0 - a + i * 2.0)
    tail = F.when(x < a + 1.0, F.greatest(F.lit(1.0) - front * series, F.lit(0.0))).otherwise(front * fraction)
    return F.when(x <= 0.0, F.lit(1.0)).when(a > 0.0, tail)
