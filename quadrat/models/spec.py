"""Model description and its design columns.

Factors are treatment coded: the alphabetically first level is the reference and every other level is a 0/1
column; an interaction is the product of its parents' columns. Everything is a Column expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERCEPT = "(Intercept)"
MAX_LEVELS = 1000


@dataclass(frozen=True)
class ModelSpec:
    """``terms`` holds column names and tuples of column names (interactions).

    ``offset`` is the exposure column whose log enters with coefficient 1. ``groups`` lists the nested grouping
    columns, outermost first; one random intercept per path prefix. ``factors`` fixes levels; a text or
    boolean column is a factor anyway, a numeric one only when named in ``factors`` (an empty list means
    levels are read from the data).
    """

    response: str
    terms: tuple
    offset: str | None = None
    groups: tuple[str, ...] = ()
    family: str = "poisson"
    factors: Mapping[str, Sequence] = field(default_factory=dict)
    name: str = ""

    def variables(self) -> list[str]:
        out = [self.response]
        for t in self.terms:
            out += [t] if isinstance(t, str) else list(t)
        out += [self.offset] if self.offset else []
        return list(dict.fromkeys(out + list(self.groups)))

    def predictors(self) -> list[str]:
        return [c for c in self.variables() if c not in (self.response, self.offset, *self.groups)]


def crossed(*cols: str) -> tuple:
    """Main effects and their interaction."""
    return (*cols, tuple(cols))


def with_levels(df: DataFrame, spec: ModelSpec) -> ModelSpec:
    """Fill in factor levels that are not given."""
    return levels_of(df, [spec])[0]


def levels_of(df: DataFrame, specs: Sequence[ModelSpec]) -> list[ModelSpec]:
    """The models with the factor levels filled in that are not given: one job for all factors of all models of a base."""
    kinds, found = dict(df.dtypes), []
    for number, spec in enumerate(specs):
        wanted = [
            c for c in spec.predictors()
            if not spec.factors.get(c) and (c in spec.factors or kinds[c] in ("string", "boolean"))
        ]
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in spec.variables()])
        found += [
            F.when(whole, F.struct(F.lit(number).alias("m"), F.lit(c).alias("f"), F.col(c).cast("string").alias("s"))) for c in wanted
        ]
    if not found:
        return list(specs)
    rows = df.select(F.explode(F.array(*found)).alias("p")).where("p is not null").select("p.*").distinct()
    rows = rows.limit(len(found) * MAX_LEVELS + 1).collect()
    if len(rows) > len(found) * MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels per factor")
    convert = {"int": int, "bigint": int, "double": float, "boolean": lambda v: v == "true"}
    levels: dict[int, dict[str, list]] = {}
    for r in rows:
        levels.setdefault(r["m"], {}).setdefault(r["f"], []).append(convert.get(kinds[r["f"]], str)(r["s"]))
    return [
        replace(spec, factors={**spec.factors, **{f: sorted(v) for f, v in levels.get(k, {}).items()}}) for k, spec in enumerate(specs)
    ]


def complete(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Rows with a value in every variable of the model, as all fits use."""
    return df.select(*spec.variables()).dropna()


def design(spec: ModelSpec) -> list[tuple[str, Column]]:
    """Names and expressions of the fixed-effect columns, intercept first."""
    def coded(col: str) -> list[tuple[str, Column]]:
        levels = spec.factors.get(col)
        if not levels:
            return [(col, F.col(col).cast("double"))]
        return [
            (f"{col}{level}", F.when(F.col(col) == F.lit(level), F.lit(1.0)).otherwise(F.lit(0.0)))
            for level in list(levels)[1:]
        ]

    out = [(INTERCEPT, F.lit(1.0))]
    for term in spec.terms:
        for parts in product(*[coded(c) for c in ((term,) if isinstance(term, str) else term)]):
            value = parts[0][1]
            for _, c in parts[1:]:
                value = value * c
            out.append((":".join(n for n, _ in parts), value))
    return out


def linear_predictor(spec: ModelSpec, beta: Sequence[float]) -> Column:
    """Fixed part without the offset."""
    total = F.lit(0.0)
    for (_, c), b in zip(design(spec), beta):
        total = total + c * F.lit(float(b))
    return total


def log_offset(spec: ModelSpec) -> Column:
    return F.log(F.col(spec.offset).cast("double")) if spec.offset else F.lit(0.0)


def model_rows(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Columns ``y, off, x0.., n`` and the grouping columns, equal rows collapsed to one with a frequency.

    Counts with factor covariates collapse strongly, and do so before the shuffle.
    """
    cols = [F.col(spec.response).cast("double").alias("y"), log_offset(spec).alias("off")]
    cols += [c.alias(f"x{j}") for j, (_, c) in enumerate(design(spec))]
    cols += [F.col(g).cast("string").alias(f"g{k}") for k, g in enumerate(spec.groups, 1)]
    rows = complete(df, spec).select(*cols)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("n"))


COEF_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()),
    T.StructField("statistic", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("full_hessian", T.BooleanType()),
])
