"""Mixed count-rate models with nested random intercepts, many of them at a time, fitted as Spark aggregations.

The Laplace-approximated likelihood is maximised over theta = (fixed effects, sd per level, log dispersion) of each model.
Rows never leave the executors; the driver holds vectors and matrices of the size of theta.

For nested intercepts the matrix of second derivatives in the intercepts is a tree, so it is eliminated level by
level with one ``groupBy`` per level, deepest first (``_newton_pass``): a node sums the weights S and scores s
of its rows or children, has pivot d = S + 1/sd^2, and hands S - S^2/d and s - (S/d) g to its parent. The way
back down joins each level with its parents. The same elimination gives the exact gradient (``_sweep``): with
a the pull of log det H on the intercepts and c the sensitivity of the intercepts' score to a parameter, the
product a' H^-1 c is the sum of a_node * c_node / d over the nodes on the way up, so no second solve is needed.

All models of one family share every pass (``Batch``). Each base is scanned once: a row gives one row per model that is complete
in it, tagged with the model's number, and equal rows (response, design, path) collapse to one with a frequency. A model with
fewer levels has further ones on top with one node and no variance. A gaussian model's rows collapse to one per leaf, its
means and count: what rows add within leaves is one matrix of sums per model, which the driver holds, so a pass costs the
leaves and not the rows. In a Poisson model an intercept is a factor of the means of all its rows, so their sums per leaf are
taken once a theta (``_leaf_sums``) and its passes cost the leaves too.

The collapsed rows are written once, bucketed by model and path, and stay there: the table of intercepts, one row per leaf,
comes to them. A leaf with more collapsed rows than ``hot_rows`` is split by a content hash into several parts, so no task holds
an unbounded leaf. Parameters are a table with a row per model, so the plans, and the code made for them, are the same in each pass.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadrat.functions.special import lgamma
from quadrat.models.families import DERIVED, HAS_DISPERSION, LOG_LINK, constants, num, row_terms
from quadrat.models.spec import INTERCEPT, ModelSpec, design, levels_of, log_offset
from quadrat.session import Scratch, materialize, side_by_side

HOT_ROWS = 200_000
FEW_NODES = 100_000  # nodes of a level, counted beforehand, up to which one task takes it and it is broadcast to the level below
AT_ONCE = 8  # thetas of a model that one set of passes evaluates
SD_BOUNDS = (1e-3, 50.0)
LOG_DISPERSION_BOUNDS = (-9.0, 12.0)
NO_VARIANCE = 1e20  # precision of the levels that a model does not have
# Largest last step of an intercept. The pivots are those before that step, so the log-likelihood is off by up to half of it per
# leaf, which must stay below what tells two thetas apart.
SETTLED = 1e-8


@dataclass
class Fit:
    """A fitted model: small arrays, plus the table of random intercepts per deepest path.

    ``at_bound`` marks levels whose sd ended at its lower bound and is given as 0; ``full_hessian`` is False where the differenced
    Hessian gave a fixed effect no positive variance, so that the information of the fixed effects alone was taken. A least-squares
    fit also has its share of explained variance, ``r2``, and the sds of the response and of each column in ``spreads``.
    """

    spec: ModelSpec
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    sds: tuple[float, ...] = ()
    dispersion: float | None = None
    converged: bool = True
    iterations: int = 0
    effects: DataFrame | None = field(default=None, repr=False)
    at_bound: tuple[bool, ...] = ()
    full_hessian: bool = True
    r2: float | None = None
    spreads: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.beta) + len(self.sds) + (self.dispersion is not None)

    @property
    def aic(self) -> float:
        return 2.0 * self.k - 2.0 * self.loglik

    @property
    def aicc(self) -> float:
        return self.aic + 2.0 * self.k * (self.k + 1) / max(self.n - self.k - 1, 1)

    @property
    def bic(self) -> float:
        return self.k * math.log(self.n) - 2.0 * self.loglik

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0.0, None))


@dataclass
class Point:
    """One evaluated theta."""

    theta: np.ndarray
    value: float
    grad: np.ndarray
    info: np.ndarray
    state: DataFrame | None


#: What a model asks for (thetas), what it is sent, what it ends with.
Ascent = Generator[list[np.ndarray], list[Point], object]


def _sum(c: Column, name: str) -> Column:
    return F.sum(c).alias(name)


class Model:
    """The driver's part of one fit: vectors of the size of theta. Its methods ask for evaluations by ``yield``."""

    def __init__(self, number: int, spec: ModelSpec):
        self.number, self.spec = number, spec
        self.terms = [name for name, _ in design(spec)]
        self.p, self.levels, self.has_disp = len(self.terms), len(spec.groups), HAS_DISPERSION[spec.family]
        self.size = self.p + self.levels + self.has_disp
        self.within: np.ndarray | None = None
        self.across: np.ndarray | None = None

    def standardise(self, one: Mapping[str, float]) -> None:
        """Means and spreads of the design, and of the response for the start values, from sums over the rows."""
        if not one.get("n"):
            raise ValueError(f"no complete rows for {self.spec.name or self.spec.response}")
        self.n = int(round(one["n"]))
        self.mean = np.array([0.0] + [one[f"m{j}"] for j in range(1, self.p)])
        self.scale = np.array([1.0] + [math.sqrt(max(one[f"v{j}"], 0.0)) for j in range(1, self.p)])
        if (self.scale <= 0).any():
            raise ValueError(f"constant design columns: {[self.terms[j] for j in range(self.p) if self.scale[j] <= 0]}")
        self.y_mean, self.y_var = one["my"], one["vy"]
        self.exposure, self.off_mean = one["exposure"] / self.n, one["off"] / self.n

    def unscale(self) -> np.ndarray:
        """Matrix from the coefficients of the standardised design to those of the design itself."""
        back = np.diag(1.0 / self.scale)
        back[0, 1:] = -(self.mean / self.scale)[1:]
        return back

    def parameters(self, theta: np.ndarray, width: int, depth: int) -> tuple[list[float], list[float], dict[str, float]]:
        """Fixed effects and precisions, filled up to the widest model, and the family's constants."""
        sd = theta[self.p:self.p + self.levels]
        precision = [NO_VARIANCE] * (depth - self.levels) + [1.0 / float(v * v) for v in sd]
        return [float(b) for b in theta[:self.p]] + [0.0] * (width - self.p), precision, constants(self.spec.family, float(theta[-1]) if self.has_disp else 0.0)

    def read(self, theta: np.ndarray, row: Mapping[str, float], depth: int, state: DataFrame | None) -> Point:
        p, grad, info = self.p, np.zeros(self.size), np.zeros((self.size, self.size))
        for j in range(p):
            grad[j] = row[f"gx{j}"]
            for i in range(j + 1):
                info[i, j] = info[j, i] = row[f"h{i}_{j}"]
        for k in range(1, self.levels + 1):
            sd, level = theta[p + k - 1], k + depth - self.levels
            grad[p + k - 1], info[p + k - 1, p + k - 1] = row[f"gs{level}"] / sd, max(row[f"hs{level}"] / sd**2, 1e-2 / self.unit() ** 2)
        if self.has_disp:
            grad[-1], info[-1, -1] = row["gd"], max(row["hd"], 1e-2)
        value = row["val"]
        if self.across is not None:  # what rows add whatever the intercepts
            value += self.across[0] + theta[:p] @ self.across[1:]
            grad[:p] += self.across[1:]
        if self.within is not None:  # what rows add to the means of their leaves
            inv, beta = math.exp(-2.0 * theta[-1]), theta[:p]
            xx, xy, yy = self.within[:p, :p], self.within[:p, p], self.within[p, p]
            squares = yy - 2.0 * beta @ xy + beta @ xx @ beta
            value -= 0.5 * inv * squares
            grad[:p] += inv * (xy - xx @ beta)
            info[:p, :p] += inv * xx
            grad[-1] += inv * squares
            info[-1, -1] = 2.0 * self.n
        return Point(theta, float(value), grad, info, state)

    def start(self) -> np.ndarray:
        theta = np.zeros(self.size)
        if self.spec.family == "gaussian":
            theta[0] = self.y_mean - self.off_mean
            theta[-1] = 0.5 * math.log(max(self.y_var, 1e-12))
            level = math.exp(theta[-1]) / math.sqrt(self.levels + 1)
        else:
            theta[0] = math.log(max(self.y_mean, 1e-8) / self.exposure)
            extra = max(self.y_var - self.y_mean, 0.05 * self.y_mean)
            if self.spec.family == "nb2":
                theta[-1] = math.log(max(self.y_mean**2 / extra, 1e-3) * (2.0 if self.levels else 1.0))
            if self.spec.family == "nb1":
                theta[-1] = math.log(extra / self.y_mean / (2.0 if self.levels else 1.0))
            level = 0.4
        theta[self.p:self.p + self.levels] = level
        return self.clip(theta)

    def clip(self, theta: np.ndarray) -> np.ndarray:
        theta, unit = theta.copy(), self.unit()
        sd = slice(self.p, self.p + self.levels)
        theta[sd] = np.clip(theta[sd], SD_BOUNDS[0] * unit, SD_BOUNDS[1] * unit)
        if self.has_disp:
            low, high = LOG_DISPERSION_BOUNDS
            theta[-1] = np.clip(theta[-1], low + math.log(unit), high + math.log(unit))
        return theta

    def unit(self) -> float:
        """Scale of the linear predictor: the spread of a gaussian response, 1 on the log scale."""
        return math.sqrt(max(self.y_var, 1e-12)) if not LOG_LINK[self.spec.family] else 1.0

    def free(self, point: Point) -> np.ndarray:
        """Parameters not pinned at a bound: moving along the gradient changes them."""
        nudge = 1e-6 * self.unit() * np.where(point.grad < 0, -1.0, 1.0)
        return np.abs(self.clip(point.theta + nudge) - point.theta) > 0.0

    def _direction(self, point: Point, grad: np.ndarray, free: np.ndarray, pairs: list) -> np.ndarray:
        """Limited-memory quasi-Newton direction on top of the information at this point."""
        info = np.where(np.outer(free, free), point.info, np.eye(self.size))
        pairs = [(np.where(free, s, 0.0), np.where(free, y, 0.0)) for s, y in pairs]
        pairs = [(s, y) for s, y in pairs if s @ y > 1e-8 * np.linalg.norm(s) * np.linalg.norm(y)]
        q, used = grad.copy(), []
        for s, y in reversed(pairs):
            alpha = (s @ q) / (s @ y)
            q = q - alpha * y
            used.append(alpha)
        r = np.linalg.solve(info, q)
        for (s, y), alpha in zip(pairs, reversed(used)):
            r = r + s * (alpha - (y @ r) / (s @ y))
        return np.where(free, r, 0.0)

    def maximise(self, max_iter: int = 60, tol: float = 1e-5) -> Ascent:
        """Ascent from the start values; stops when the log-likelihood can gain less than ``tol``: point, converged, iterations."""
        unit = self.unit()
        caps = np.array([2.0 * unit] * self.p + [0.6 * unit] * self.levels + [1.5] * self.has_disp)
        (point,) = yield [self.start()]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        last, held, reach = math.inf, None, 1.0
        for it in range(1, max_iter + 1):
            free = self.free(point)
            grad = np.where(free, point.grad, 0.0)
            if held is not None and (held != free).any():
                pairs = []
            held = free

            def bounded(pairs: list) -> tuple[np.ndarray, float]:
                step = self._direction(point, grad, free, pairs)
                if step[-1] * grad[-1] > 0:
                    step[-1] *= reach
                step = np.clip(step, -caps, caps)
                step = self.clip(point.theta + step) - point.theta
                return step, 0.5 * (grad @ step)

            step, gain = bounded(pairs)
            if pairs and not 0 < gain < last:
                # Steps taken far from here describe another curvature.
                pairs = []
                step, gain = bounded(pairs)
            last = gain
            if gain < tol:
                return point, True, it
            for _ in range(10):
                (trial,) = yield [self.clip(point.theta + step)]
                if np.isfinite(trial.value) and trial.value >= point.value + 1e-4 * (grad @ step) - 1e-9 * abs(point.value):
                    break
                step = 0.35 * step
            else:
                return point, bool(gain < 1e-3), it
            # A log dispersion whose slope a step does not lower, as on a likelihood that rises to its bound, goes twice as far the next time.
            steep = self.has_disp and free[-1] and (trial.theta - point.theta)[-1] * point.grad[-1] > 0
            reach = 2.0 * reach if steep and trial.grad[-1] * point.grad[-1] >= 0.9 * point.grad[-1] ** 2 else 1.0
            pairs = [*pairs, (trial.theta - point.theta, point.grad - trial.grad)][-8:]
            point = trial
        return point, False, max_iter

    def hessian(self, point: Point) -> Ascent:
        """Negative second derivatives by differences of the exact gradient; bound parameters are held."""
        free = np.flatnonzero(self.free(point))
        h = 0.01 * np.minimum(1.0 / np.sqrt(np.maximum(np.diag(point.info), 1e-8)), self.unit())
        moved, rows = [], []
        for i in free:
            moved.append(point.theta.copy())
            moved[-1][i] += h[i]
        for k in range(0, len(free), AT_ONCE):  # they do not depend on each other
            points = yield moved[k:k + AT_ONCE]
            rows += [(point.grad[free] - at.grad[free]) / h[i] for i, at in zip(free[k:k + AT_ONCE], points, strict=True)]
        return 0.5 * (np.array(rows) + np.array(rows).T)

    def fixed_cov(self, point: Point, how: str) -> Ascent:
        """Covariance of the scaled fixed effects: from the full Hessian, or from the information alone; and which it is."""
        if how == "hessian":
            cov = np.linalg.pinv((yield from self.hessian(point)))
            if (np.diag(cov)[:self.p] > 0).all():
                return cov[:self.p, :self.p], True
        return np.linalg.pinv(point.info[:self.p, :self.p]), False

    def run(self, how: str, max_iter: int, tol: float) -> Ascent:
        point, converged, iterations = yield from self.maximise(max_iter, tol)
        cov, full = yield from self.fixed_cov(point, how)
        return point, converged, iterations, cov, full


class Batch:
    """The prepared rows of models of one family, and the passes over them that all models share."""

    def __init__(self, jobs: Sequence[tuple[DataFrame, ModelSpec]], hot_rows: int = HOT_ROWS):
        (self.family,) = {spec.family for _, spec in jobs}
        self.leaves_only = self.family in ("poisson", "gaussian")  # passes read sums per leaf; those of other families read the rows
        bases: dict[int, tuple[DataFrame, list[int]]] = {}
        for number, (df, _) in enumerate(jobs):
            bases.setdefault(id(df), (df, []))[1].append(number)
        specs = {}
        for df, own in bases.values():
            specs |= zip(own, levels_of(df, [jobs[k][1] for k in own]), strict=True)
        self.models = [Model(k, specs[k]) for k in range(len(jobs))]
        self.p, self.levels = max(m.p for m in self.models), max(1, *[m.levels for m in self.models], 1)
        self.keys = ["m", *[f"g{k}" for k in range(1, self.levels + 1)]]
        self.nodes = ["m", "t", *self.keys[1:]]  # t: number of the theta
        self.scratch = Scratch(jobs[0][0].sparkSession, f"fit-{self.family}")
        self.spark = self.scratch.spark
        raw = self.scratch.keep(reduce(DataFrame.union, [self._tagged(df, own) for df, own in bases.values()]))
        self._standardise(raw)
        self._lay_out(hot_rows)

    def _tagged(self, df: DataFrame, numbers: Sequence[int]) -> DataFrame:
        """One scan of a base: m, path, y, off, x, n of all its models, equal rows collapsed before the shuffle."""
        kinds = []
        for number in numbers:
            model = self.models[number]
            spec, missing = model.spec, self.levels - model.levels
            x = [c for _, c in design(spec)] + [F.lit(0.0)] * (self.p - model.p)
            path = [F.lit("")] * missing + [F.col(g).cast("string") for g in spec.groups]
            row = F.struct(
                F.lit(number).alias("m"), *[g.alias(f"g{k}") for k, g in enumerate(path, 1)], F.col(spec.response).cast("double").alias("y"),
                log_offset(spec).alias("off"), F.array(*x).alias("x"),
            )
            whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNotNull() for c in spec.variables()])
            kinds.append(F.when(whole, row))
        rows = df.select(F.explode(F.filter(F.array(*kinds), lambda r: r.isNotNull())).alias("r")).select("r.*")
        return rows.groupBy(*self.keys, "y", "off", "x").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def _standardise(self, raw: DataFrame) -> None:
        n = F.col("n")
        columns = {"y": F.col("y"), **{str(j): F.col("x")[j] for j in range(1, self.p)}}
        means = raw.groupBy("m").agg(
            F.count(F.lit(1)).alias("rows"), _sum(n, "n"), F.sum(n * F.exp("off")).alias("exposure"), F.sum(n * F.col("off")).alias("off"),
            *[(F.sum(n * c) / F.sum(n)).alias(f"m{name}") for name, c in columns.items()],
        )
        known = {r["m"]: r.asDict() for r in means.collect()}  # a row per model
        centre = self._table([(m, [one["my"], *[one[f"m{j}"] for j in range(1, self.p)]]) for m, one in known.items()], "m int, centre array<double>")
        about = raw.join(F.broadcast(centre), "m")
        spreads = about.groupBy("m").agg(*[
            (F.sum(n * F.pow(c - F.col("centre")[k], F.lit(2.0))) / F.sum(n)).alias(f"v{name}") for k, (name, c) in enumerate(columns.items())
        ])
        for r in spreads.collect():
            known[r["m"]] |= r.asDict()
        for model in self.models:
            model.standardise(known.get(model.number, {}))
        self.n_rows = sum(one["rows"] for one in known.values())
        fill = [0.0] * self.p
        scales = self._table([
            (m.number, [*map(float, m.mean), *fill][:self.p], [*map(float, m.scale), *[1.0] * self.p][:self.p]) for m in self.models
        ], "m int, mean array<double>, scale array<double>")
        self.scaled = raw.join(F.broadcast(scales), "m").select(
            *self.keys, "y", "off", "n", *[((F.col("x")[j] - F.col("mean")[j]) / F.col("scale")[j]).alias(f"x{j}") for j in range(self.p)]
        )

    def _lay_out(self, hot_rows: int) -> None:
        """Gaussian rows to leaf means; split hot leaves; rows bucketed by path, and the start of the intercepts."""
        rows = self._leaf_means() if self.family == "gaussian" else self.scaled
        leaves = rows.groupBy(*self.keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).cast("int").alias("parts"))
        zero = [F.lit(0.0).alias(f"b{k}") for k in range(1, self.levels + 1)]
        few = self.n_rows if self.leaves_only else None
        self.state = self.scratch.keep_bucketed(leaves.select(*self.keys, "parts", *zero), self.keys, few)
        paths = [F.count_distinct(F.struct(*self.keys[:k + 1])).alias(str(k)) for k in range(1, self.levels)]
        counted = self.state.agg(F.count(F.lit(1)).alias(str(self.levels)), *paths).first().asDict()
        self.n_nodes = {int(k): n for k, n in counted.items()}
        self.sums = ["y", *[f"e{i}_{j}" for i in range(self.p) for j in range(i, self.p)]] if self.family == "poisson" else []
        hot = self.state.where(F.col("parts") > 1).select(*self.keys, "parts")
        self.split, self.place = not hot.isEmpty(), self.keys
        if self.split:
            spread = F.pmod(F.xxhash64("y", "off", *[f"x{j}" for j in range(self.p)]), F.coalesce("parts", F.lit(1)))
            rows = rows.join(hot, self.keys, "left").withColumn("part", spread.cast("int")).drop("parts")
            self.place = [*self.keys, "part"]
        self.rows = self.scratch.keep_bucketed(rows, self.place, few)
        if self.family == "poisson":
            y = F.col("n") * F.col("y")
            one = F.expr(f"sum(n*(y*off - {lgamma('(y + 1D)')})) AS one")
            for r in self.rows.groupBy("m").agg(one, *[F.sum(y * F.col(f"x{j}")).alias(f"xy{j}") for j in range(self.p)]).collect():  # a row per model
                self.models[r["m"]].across = np.array([r["one"], *[r[f"xy{j}"] for j in range(self.models[r["m"]].p)]])

    def _leaf_means(self) -> DataFrame:
        """A row per leaf with the means of its rows; each model gets the sums of squares and products about them."""
        names = [*[f"x{j}" for j in range(self.p)], "y"]
        y = F.col("y") - F.col("off")
        rows = self.scaled.withColumn("y", y).withColumn("off", F.lit(0.0))
        means = rows.groupBy(*self.keys).agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in names], _sum(F.col("n"), "n"))
        means = self.scratch.keep(means.withColumn("off", F.lit(0.0)))
        pairs = [(i, j) for i in range(self.p + 1) for j in range(i, self.p + 1)]

        def products(df: DataFrame) -> dict[int, np.ndarray]:
            sums = df.groupBy("m").agg(*[F.sum(F.col("n") * F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs])
            out = {}
            for r in sums.collect():  # a row per model
                full = np.zeros((self.p + 1, self.p + 1))
                for i, j in pairs:
                    full[i, j] = full[j, i] = r[f"s{i}_{j}"]
                out[r["m"]] = full
            return out

        whole, between = products(rows), products(means)
        for model in self.models:
            own = [*range(model.p), self.p]
            model.within = (whole[model.number] - between[model.number])[np.ix_(own, own)]
        return means.select(*self.keys, "y", "off", "n", *names[:-1])

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        """A row per model, from numbers that the driver holds: as an Arrow table it is part of the plan, and no job reads it."""
        names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
        arrow = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        columns = [pa.array(values, arrow[kind]) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return self.spark.createDataFrame(pa.table(columns, names=list(names)))

    def close(self) -> None:
        self.scratch.clear()

    # -- passes over the rows -----------------------------------------------------------------------------

    def _parameters(self, thetas: Mapping[int, Sequence[np.ndarray]]) -> DataFrame:
        rows, names = [], []
        for number, own in thetas.items():
            for t, theta in enumerate(own):
                beta, precision, fixed = self.models[number].parameters(theta, self.p, self.levels)
                names = list(fixed)
                rows.append((number, t, beta, precision, *fixed.values()))
        return self._table(rows, ", ".join(["m int", "t int", "beta array<double>", "pr array<double>", *[f"{c} double" for c in names]]))

    def _small(self, table: DataFrame, level: int, thetas: int) -> DataFrame:
        """Marked for broadcast when the nodes of this level, counted beforehand, are few."""
        return F.broadcast(table) if self.n_nodes[level] * thetas <= FEW_NODES else table

    def _top(self, thetas: int) -> int:
        """The deepest level that one task takes, with those above it: its nodes, counted beforehand, are few. 0 if there is none."""
        return max((
            k for k, n in self.n_nodes.items()
            if n * thetas <= FEW_NODES and (k < self.levels or self.leaves_only or not self.split and self.n_rows * thetas <= FEW_NODES)
        ), default=0)

    def _with_terms(self, state: DataFrame, par: DataFrame, want: Sequence[str], one_task: bool = False) -> DataFrame:
        """Rows joined with the intercepts of their leaf, with the wanted row terms at ``eta``."""
        if self.split:
            state = state.withColumn("part", F.expr("explode(sequence(0, parts - 1))"))
        rows = self.rows
        if one_task:
            rows, state = rows.coalesce(1), state.coalesce(1)
        rows = rows.join(state.join(F.broadcast(par), ["m", "t"]), self.place)
        eta = " + ".join(["off", *[f"x{j}*beta[{j}]" for j in range(self.p)], *[f"b{k}" for k in range(1, self.levels + 1)]])
        keep = [c for c in rows.columns if c not in ("beta", "pr", "part")]
        rows = rows.selectExpr(*keep, f"{eta} AS eta")
        for step in row_terms(self.family):
            rows = rows.withColumns({name: F.expr(text) for name, text in step.items()})
        return rows.select(*keep, *want)

    def _leaf_sums(self, state: DataFrame, par: DataFrame, thetas: int) -> DataFrame:
        """The intercepts, with what the rows of a leaf add to a Poisson pass: an intercept is a factor of all their means, so these are read once a theta."""
        mean = " + ".join(["off", *[f"x{j}*beta[{j}]" for j in range(self.p)]])
        rows = self.rows.join(F.broadcast(par.select("m", "t", "beta")), "m").withColumn("e", F.expr(f"n*exp({mean})"))
        sums = rows.groupBy(*self.nodes).agg(
            F.expr("sum(n*y) AS y"), *[F.expr(f"sum(e*x{i}*x{j}) AS e{i}_{j}") for i in range(self.p) for j in range(i, self.p)]
        )
        state = state.select(*self.nodes, "parts", *[f"b{k}" for k in range(1, self.levels + 1)])
        if self._top(thetas) == self.levels:
            state, sums = state.coalesce(1), sums.coalesce(1)
        return state.join(sums, self.nodes)

    def _newton_step(self, state: DataFrame, par: DataFrame, thetas: int = 1) -> DataFrame:
        """One Newton step for all intercepts of all models at once, with the pivots and variances the gradient needs and ``move``, the leaf's largest step.

        Levels with many nodes are tables that are joined with their parents on the way down. From the level on that one task takes, a node
        carries its children as an array: no table is read twice and no stage waits for another there.
        """
        depth, keys, top = self.levels, self.nodes, self._top(thetas)
        precision = F.broadcast(par.select("m", "t", "pr"))
        # On the log scale a first step can overshoot; a gaussian step is exact.
        cap = num(3.0 if LOG_LINK[self.family] else math.inf)
        b = [f"b{k}" for k in range(1, depth + 1)]
        if self.family == "poisson":
            table = (state.coalesce(1) if top == depth else state).selectExpr(
                *keys, "parts", *self.sums, *b, f"e0_0*exp({' + '.join(b)}) AS wt", f"y - e0_0*exp({' + '.join(b)}) AS sc"
            )
        else:
            rows = self._with_terms(state.select(*keys, "parts", *b), par, ["weight", "score"], top == depth)
            table = rows.groupBy(*keys, "parts", *b).agg(F.expr("sum(n*weight) AS wt"), F.expr("sum(n*score) AS sc"))
        tables = {}
        for k in range(depth, 0, -1):
            extra = ["parts", *self.sums] if k == depth else []
            below = ["nodes"] if k < top else []
            table = table.join(precision, ["m", "t"]).withColumn("own", F.expr(f"pr[{k - 1}]")).selectExpr(
                *keys[:k + 2], *extra, *below, *b[:k], f"own AS own{k}", f"wt AS wt{k}", "sc", f"greatest(wt + own, 1e-3D*own) AS d{k}",
                f"sc - own*b{k} AS res{k}",
            )
            if k > top:
                tables[k] = table.drop("sc", *b[:k - 1])
            # d - wt is taken apart from d, where a small precision would be lost beside a large weight.
            sums = [
                F.expr(f"sum(wt{k}*own{k}/d{k}) AS wt"),
                F.expr(f"sum((sc*greatest(own{k}, 1e-3D*own{k} - wt{k}) + wt{k}*own{k}*b{k})/d{k}) AS sc"),
            ]
            if k <= top:
                node = F.struct(keys[k + 1], *extra, *below, f"b{k}", *[f"{c}{k}" for c in ("own", "wt", "d", "res")])
                table = table.groupBy(*keys[:k + 1], *b[:k - 1]).agg(*sums, F.collect_list(node).alias("nodes"))
            elif k > 1:
                table = table.groupBy(*keys[:k + 1], *b[:k - 1]).agg(*sums)
                if k - 1 == top:
                    table = table.coalesce(1)
        zero = {"up": F.lit(0.0), "v": F.lit(0.0), "move": F.lit(0.0)}
        above = (table.select("m", "t", "nodes") if top else tables[1]).withColumns(zero)
        for k in range(1, depth + 1):
            own = f"own{k}"
            if k <= top:
                above = above.selectExpr(*[c for c in above.columns if c != "nodes"], "inline(nodes)")
            elif k > 1:
                above = tables[k].join(self._small(above, k - 1, thetas), keys[:k + 1])
            kept = [c for c in above.columns if c not in (f"b{k}", f"res{k}", own, "up", "v", "move")]
            above = above.selectExpr(
                *kept, own, f"b{k}", "up", "v", "move",
                f"greatest(least(res{k}/d{k} - wt{k}/d{k}*up, {cap}), -{cap}) AS step",
            ).selectExpr(
                *kept, f"b{k} + step AS b{k}", "up + step AS up", "greatest(move, abs(step)) AS move",
                f"wt{k}*wt{k}/(d{k}*d{k})*v + 1D/d{k} AS V_{k}", f"{own}*{own}/(d{k}*d{k})*v + 1D/d{k} AS v",
            )
        return above.drop("up")

    def _newton_pass(self, state: DataFrame, par: DataFrame, numbers: Sequence[int], thetas: int = 1) -> tuple[DataFrame, dict[int, float]]:
        """The step, kept as a table, and the largest move of each model."""
        seen = Observation()
        moves = [F.max(F.when(F.col("m") == k, F.col("move"))).alias(f"m{k}") for k in numbers]
        new = self.scratch.keep(self._newton_step(state, par, thetas).observe(seen, *moves).drop("move"))
        return new, {k: seen.get[f"m{k}"] for k in numbers}

    def _sweep(self, state: DataFrame, par: DataFrame, thetas: int = 1) -> dict[tuple[int, int], dict]:
        """Objective, gradient and approximate information of each model and theta, in one pass up the tree."""
        p, depth, keys, top = self.p, self.levels, self.nodes, self._top(thetas)
        has_disp = HAS_DISPERSION[self.family]
        precision = F.broadcast(par.select("m", "t", "pr"))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = {"val": "n*loglik"}
        sums |= {f"gx{j}": f"n*x{j}*(score + pull)" for j in range(p)}
        sums |= {f"h{i}_{j}": f"n*weight*x{i}*x{j}" for i, j in pairs}
        if has_disp:
            sums |= {"gd": "n*(d_loglik - 0.5D*v*d_weight)", "hd": "n*d_loglik*d_loglik"}
        if self.family == "poisson":  # the other parts are sums over all rows of a model, see ``Model.read``
            sums = {"val": "y*level - mu*e0_0"} | {f"gx{j}": f"-mu*(1D + 0.5D*v)*e0_{j}" for j in range(p)} | {f"h{i}_{j}": f"mu*e{i}_{j}" for i, j in pairs}
        totals = list(sums)
        # Vectors eliminated along with the weights: a (from the log determinant) and the sensitivities.
        vectors = {"a": "n*pull", **{f"cx{j}": f"n*weight*x{j}" for j in range(p)}}
        if has_disp:
            vectors["cd"] = "n*d_score"
        if self.family == "poisson":
            vectors = {"a": "-0.5D*v*mu*e0_0", **{f"cx{j}": f"mu*e0_{j}" for j in range(p)}}

        def carried(k: int) -> list[str]:
            return [f"{c}{q}" for q in range(1, k + 1) for c in ("b", "d", "wt", "V_")]

        if self.family == "poisson":
            leaves = state.coalesce(1) if top == depth else state
            leaves = leaves.withColumn("level", F.expr(" + ".join(f"b{k}" for k in range(1, depth + 1)))).withColumn("mu", F.expr("exp(level)"))
            table = leaves.selectExpr(*keys, *carried(depth), *[f"{t} AS {c}" for c, t in {**sums, **vectors}.items()])
        else:
            rows = self._with_terms(state, par, DERIVED, top == depth).withColumn("pull", F.expr("-0.5D*weight_eta*v"))
            table = rows.groupBy(*keys, *carried(depth)).agg(*[F.expr(f"sum({t}) AS {c}") for c, t in {**sums, **vectors}.items()])
        for k in range(depth, 0, -1):
            own, d = "own", f"d{k}"
            out = {c: c for c in totals}
            out["val"] = f"val - 0.5D*{own}*b{k}*b{k} + 0.5D*ln({own}) - 0.5D*ln({d})"
            out |= {f"gx{j}": f"gx{j} - a*cx{j}/{d}" for j in range(p)}
            out |= {f"h{i}_{j}": f"h{i}_{j} - cx{i}*cx{j}/{d}" for i, j in pairs}
            if has_disp:
                out["gd"] = f"gd + a*cd/{d}"
            out |= {f"gs{q}": f"gs{q} + a*cs{q}/{d}" for q in range(k + 1, depth + 1)}
            out[f"gs{k}"] = f"{own}*b{k}*b{k} - (1D - {own}*V_{k}) + 2D*{own}*a*b{k}/{d}"
            out[f"hs{k}"] = f"2D*(1D - {own}*V_{k})*(1D - {own}*V_{k})"
            passed = [*vectors, *[f"cs{q}" for q in range(k + 1, depth + 1)]]
            up = {c: f"{c}*{own}/{d}" for c in passed}
            up[f"cs{k}"] = f"-2D*wt{k}/{d}*{own}*b{k}"
            table = table.join(precision, ["m", "t"]).withColumn("own", F.expr(f"pr[{k - 1}]")).groupBy(*keys[:k + 1], *carried(k - 1)).agg(
                *[F.expr(f"sum({t}) AS {c}") for c, t in {**out, **up}.items()]
            )
            if k - 1 == top > 0:
                table = table.coalesce(1)
            totals = list(out)
        return {(r["m"], r["t"]): r.asDict() for r in table.collect()}  # a row per model and theta

    def evaluate(self, thetas: Mapping[int, Sequence[np.ndarray]], tol: Mapping[int, float], rounds: int = 40) -> dict[int, list[Point]]:
        """Intercepts at their mode for each theta of each model, then objective and gradient."""
        par, numbers, most = self._parameters(thetas), list(thetas), max(map(len, thetas.values()))
        state = self.state.join(F.broadcast(par.select("m", "t")), "m")
        if self.family == "gaussian":  # one step from anywhere is exact, so it is a part of the sweep's job
            state = self._newton_step(state, par, most).drop("move")
        else:
            if self.family == "poisson":
                state = self.scratch.keep(self._leaf_sums(state, par, most))
            for _ in range(rounds):
                state, moves = self._newton_pass(state, par, numbers, most)
                if all(moves[k] < tol[k] for k in numbers):
                    break
        found = self._sweep(state, par, most)
        first = state.where("t = 0").drop("t")
        if self.family != "gaussian":
            self.state = first  # a model's next search begins where its first theta's ended; ended models are not asked for again
        return {k: [self.models[k].read(theta, found[k, t], self.levels, first) for t, theta in enumerate(own)] for k, own in thetas.items()}

    def run(self, how: str, max_iter: int, tol: float) -> list[tuple]:
        """All models side by side: each asks for its next evaluations, and one set of passes answers them all."""
        going = {m.number: m.run(how, max_iter, tol) for m in self.models}
        asked = {k: next(ascent) for k, ascent in going.items()}
        ended = {}
        while asked:
            points = self.evaluate(asked, dict.fromkeys(asked, SETTLED))
            asked = {}
            for k, found in points.items():
                try:
                    asked[k] = going[k].send(found)
                except StopIteration as stop:
                    ended[k] = stop.value
        return [ended[m.number] for m in self.models]

    def effects(self, model: Model, point: Point) -> DataFrame | None:
        """Random intercepts per deepest path, under the names of the grouping columns."""
        if not model.levels:
            return None
        above = self.levels - model.levels
        names = [F.col(f"g{k + above}").alias(g) for k, g in enumerate(model.spec.groups, 1)]
        own = point.state.where(F.col("m") == model.number)
        return materialize(own.select(*names, *[F.col(f"b{k + above}").alias(f"b{k}") for k in range(1, model.levels + 1)]))

    def fit(self, model: Model, point: Point, converged: bool, iterations: int, cov: np.ndarray, full: bool) -> Fit:
        back, theta, p, depth = model.unscale(), point.theta, model.p, model.levels
        sds = theta[p:p + depth]
        low = tuple(bool(v <= SD_BOUNDS[0] * model.unit() * (1 + 1e-9)) for v in sds)
        return Fit(
            model.spec, model.terms, back @ theta[:p], back @ cov @ back.T, point.value, model.n,
            tuple(0.0 if at else float(v) for v, at in zip(sds, low, strict=True)), float(math.exp(theta[-1])) if model.has_disp else None,
            converged, iterations, self.effects(model, point), low, full,
        )


def fit_many(
    jobs: Sequence[tuple[DataFrame, ModelSpec]], se: str = "hessian", hot_rows: int = HOT_ROWS, max_iter: int = 60, tol: float = 1e-5
) -> list[Fit]:
    """Fit each (base, model) by Laplace maximum likelihood, the models of a family together, the families side by side.

    Families are poisson, nb2, nb1 and gaussian, with any number of nested levels, none included. ``se="information"`` skips the
    differenced Hessian and takes standard errors from the fixed-effect block of the information, given the variance
    parameters. ``tol`` is what the log-likelihood may still gain at the end. A fit that did not converge says so.
    """
    def fitted(family: str) -> dict[int, Fit]:
        own = [k for k, (_, spec) in enumerate(jobs) if spec.family == family]
        batch = Batch([jobs[k] for k in own], hot_rows)
        try:
            return {k: batch.fit(model, *ended) for k, model, ended in zip(own, batch.models, batch.run(se, max_iter, tol), strict=True)}
        finally:
            batch.close()

    families = dict.fromkeys(spec.family for _, spec in jobs)
    out = reduce(dict.__or__, side_by_side(jobs[0][0].sparkSession, [partial(fitted, family) for family in families]), {})
    return [out[k] for k in range(len(jobs))]


def fit_glmm(df: DataFrame, spec: ModelSpec, **options) -> Fit:
    """One model, as in ``fit_many``."""
    return fit_many([(df, spec)], **options)[0]


def variance_components(fit: Fit) -> Sequence[tuple[str, float, bool]]:
    """Variance of each random intercept, named by its path, and whether it ended at the lower bound."""
    groups = fit.spec.groups
    return [(":".join(groups[:k]), sd * sd, at) for k, (sd, at) in enumerate(zip(fit.sds, fit.at_bound, strict=True), 1)]


__all__ = ["Batch", "Fit", "fit_glmm", "fit_many", "variance_components", "INTERCEPT"]
