"""Exact quantiles per group, by linear interpolation between order statistics (type 7).

The rows are first collapsed to (group, value, count). Where every group then holds a bounded number of
distinct values, one ``percentile`` aggregate over the counts finishes. A group with more distinct values is
narrowed first: an equal-width histogram between its bounds shows which bin holds each wanted rank, only the
values of those bins are kept, and this repeats until the bins are small. Nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.joins import left_join_on
from quadrat.session import materialize

MAX_DISTINCT = 1_000_000
BINS = 1024


def value_counts(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """Rows per group and value, kept as a table because the quantile search reads it several times."""
    rows = df.where(F.col(y).isNotNull()).groupBy(*by, F.col(y).cast("double").alias("y"))
    return materialize(rows.agg(F.count(F.lit(1)).alias("cnt")))


def exact_quantiles(
    hist: DataFrame, by: Sequence[str], probs: Sequence[float], max_distinct: int = MAX_DISTINCT
) -> DataFrame:
    """Columns ``n, lo, hi`` and ``q0..`` per group, from the output of :func:`value_counts`."""
    by = list(by)
    if not by:
        return exact_quantiles(hist.withColumn("__all", F.lit(0)), ["__all"], probs, max_distinct).drop("__all")
    ends = [F.sum("cnt").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")]
    largest = hist.groupBy(*by).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0] or 0
    if largest <= max_distinct:
        quantiles = F.percentile("y", F.array(*[F.lit(float(p)) for p in probs]), F.col("cnt"))
        return hist.groupBy(*by).agg(*ends, quantiles.alias("q")).select(
            *by, "n", "lo", "hi", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))]
        )
    return _narrowed(hist, by, probs, hist.groupBy(*by).agg(*ends), max_distinct)


def _narrowed(
    hist: DataFrame, by: list[str], probs: Sequence[float], ends: DataFrame, max_distinct: int
) -> DataFrame:
    """One search per group and wanted rank: (group, rank id, rank, lo, hi, rows below lo)."""
    ranks = [F.floor((F.col("n") - 1) * F.lit(float(p))) for p in probs]
    wanted = [r for rank in ranks for r in (rank, F.least(rank + 1, F.col("n") - 1))]
    search = ends.select(
        *by, "lo", "hi", F.lit(0).cast("long").alias("below"), F.posexplode(F.array(*wanted)).alias("rid", "rank")
    )
    rows = hist
    while True:
        # Distinct (lo, hi) ranges only: neighbouring ranks share theirs, so a value is kept once per range.
        ranges = search.select(*by, "lo", "hi", "below").distinct()
        near = left_join_on(rows, ranges.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi", "below")).alias("rs")), by, salts=16)
        near = near.select(*by, "y", "cnt", F.explode("rs").alias("r")).where("y between r.lo and r.hi")
        near = materialize(near.select(*by, "y", "cnt", "r.lo", "r.hi", "r.below"))
        largest = near.groupBy(*by, "lo", "hi").count().agg(F.max("count")).first()[0]
        if largest <= max_distinct:
            break
        width = (F.col("hi") - F.col("lo")) / BINS
        slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("y") - F.col("lo")) / width), F.lit(BINS - 1)))
        bins = near.withColumn("bin", F.coalesce(slot, F.lit(0).cast("long"))).groupBy(*by, "lo", "hi", "below", "bin").agg(
            F.sum("cnt").alias("c"), F.min("y").alias("blo"), F.max("y").alias("bhi")
        )
        # At most BINS rows per range: this window stays small however large the group is.
        upto = Window.partitionBy(*by, "lo", "hi").orderBy("bin")
        bins = bins.withColumn("start", F.col("below") + F.sum("c").over(upto) - F.col("c"))
        s, b = search.alias("s"), bins.alias("b")
        hit = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "lo", "hi"]]
        inside = (F.col("s.rank") >= F.col("b.start")) & (F.col("s.rank") < F.col("b.start") + F.col("b.c"))
        search = materialize(
            s.join(b, [*hit, inside]).select(
                *[F.col(f"s.{k}").alias(k) for k in by], F.col("b.blo").alias("lo"), F.col("b.bhi").alias("hi"),
                F.col("b.start").alias("below"), "s.rid", "s.rank",
            )
        )
        rows = near.select(*by, "y", "cnt").distinct()
    upto = Window.partitionBy(*by, "lo", "hi").orderBy("y")
    placed = near.withColumn("end", F.col("below") + F.sum("cnt").over(upto))
    s, v = search.alias("s"), placed.alias("v")
    hit = [F.col(f"s.{k}").eqNullSafe(F.col(f"v.{k}")) for k in [*by, "lo", "hi"]]
    inside = (F.col("s.rank") >= F.col("v.end") - F.col("v.cnt")) & (F.col("s.rank") < F.col("v.end"))
    found = s.join(v, [*hit, inside]).select(*[F.col(f"s.{k}").alias(k) for k in by], "s.rid", F.col("v.y").alias("y"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("rid") == i, F.col("y"))).alias(f"__o{i}") for i in range(len(wanted))])
    out = left_join_on(ends, wide, by)
    for i, p in enumerate(probs):
        part = (F.col("n") - 1) * F.lit(float(p))
        lower, upper = F.col(f"__o{2 * i}"), F.col(f"__o{2 * i + 1}")
        out = out.withColumn(f"q{i}", lower + (part - F.floor(part)) * (upper - lower))
    return out.drop(*[f"__o{i}" for i in range(len(wanted))])

