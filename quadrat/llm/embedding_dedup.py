"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors of one label and length are unit vectors o; a random rotation P gives a code, the signs of P o, and its stored
correction factor f = <P o, code> / sqrt(dim). For another unit vector q, <P q, code> / sqrt(dim) / f is an unbiased
estimate of <o, q>, off by more than ``epsilon * sqrt((1 - f^2) / f^2 / (dim - 1))`` only with odds that fall off
exponentially in epsilon^2. Pairs whose upper bound reaches the threshold are computed exactly in double precision.

Who meets whom: the first bits of several codes name buckets, and vectors in one bucket meet. Bits and the number of
codes follow from the number of vectors, so that buckets stay small and a pair at the threshold meets in at least one with
the odds asked for (closer pairs more often). Equal vectors are one vector with a weight. Buckets of more than BLOCK vectors
are compared block by block. A pair counts in its first common bucket only, so no pair table is needed: a task returns, for each
vector, how many it links to and the smallest vector linked through the pairs it has seen.

Defined cases: a null label, a null, empty or zero vector and one with null or non-finite components link with nothing;
rows with the same ``vec_id`` are one node for components; a null ``vec_id`` links with nothing; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.components import components
from quadrat.llm.shared import Kept

BLOCK = 2048  # vectors compared with as many in one task
PER_BUCKET = 2048  # vectors in an average bucket


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation: the orthogonal factor of a seeded Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng([20, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_needed(n_vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a bucket's name, and codes so that a pair at the threshold shares a bucket with odds ``recall``."""
    bits = max(0, math.ceil(math.log2(max(1, n_vectors) / PER_BUCKET)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def bucket_names(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): the first ``bits`` signs under each table's rotation, in parts where a vector is shorter."""
    out = np.zeros((len(x), tables), np.int64)
    dim = x.shape[1]
    for t in range(tables):
        signs = x @ rotation(dim, t + 1)[:min(bits, dim)].T > 0
        for k in range(signs.shape[1]):
            out[:, t] = out[:, t] * 2 + signs[:, k]
    return out


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their codes (+1, -1) and correction factors."""
    rotated = x @ rotation(x.shape[1], 0).T
    sign = np.where(rotated >= 0, 1.0, -1.0)
    return rotated, sign, (rotated * sign).sum(axis=1) / math.sqrt(x.shape[1])


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of unit vectors with inner product of at least the threshold: estimates first, then exactly."""
    dim = x.shape[1]
    if dim == 1:
        return np.nonzero(x @ y.T >= threshold)
    rotated, _, _ = codes(x)
    _, sign, factor = codes(y)
    margin = epsilon * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / (dim - 1))
    hit_x, hit_y = [], []
    for low in range(0, len(x), 512):
        estimate = rotated[low:low + 512] @ sign.T / math.sqrt(dim) / factor
        i, j = np.nonzero(estimate + margin >= threshold)
        exact = np.einsum("ij,ij->i", x[i + low], y[j])
        good = exact >= threshold
        hit_x.append(i[good] + low)
        hit_y.append(j[good])
    return np.concatenate(hit_x), np.concatenate(hit_y)


def near_links(vectors: DataFrame, kept: Kept, threshold: float, epsilon: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep, copies) of every vector that can link, and (rep, links, root): links of each distinct vector."""
    usable = "label is not null and vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    distinct = kept.keep(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")))
    members = kept.keep(rows.join(distinct.hint("merge"), ["label", "embedding"]).select("vec_id", "rep", "copies").distinct())
    bits, tables = tables_needed(distinct.count(), threshold, recall)

    def name(batches):
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                x = np.stack(part["embedding"].to_numpy())
                x = x / np.abs(x).max(axis=1)[:, None]
                x = x / np.linalg.norm(x, axis=1)[:, None]
                names = bucket_names(x, bits, tables)
                for t in range(tables):
                    yield pd.DataFrame({
                        "label": part["label"].astype(str), "dim": dim, "table": t, "bucket": names[:, t], "rep": part["rep"],
                        "copies": part["copies"], "names": list(names[:, :t]), "unit": list(x),
                    })

    schema = "label string, dim int, table int, bucket long, rep long, copies long, names array<long>, unit array<double>"
    key = ["label", "dim", "table", "bucket"]
    named = kept.keep(distinct.mapInPandas(name, schema))
    sizes = named.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    named = named.join(kept.keep(sizes.where("blocks > 1")).hint("merge"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    named = named.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    named = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = named.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")

    def compare(part):
        part = part.sort_values("rep")
        x, rep, copies, own = np.stack(part["unit"].to_numpy()), part["rep"].to_numpy(), part["copies"].to_numpy(), part["own"].to_numpy()
        at = np.flatnonzero(own == part["low"].iloc[0])
        to = np.flatnonzero(own == part["high"].iloc[0])
        i, j = linked_pairs(x[at], x[to], threshold, epsilon)
        i, j = at[i], to[j]
        new = i < j if part["low"].iloc[0] == part["high"].iloc[0] else np.ones(len(i), bool)
        i, j = i[new], j[new]
        if part["table"].iloc[0]:
            names = np.stack(part["names"].to_numpy())
            seen = (names[i] == names[j]).any(axis=1)
        else:
            seen = np.zeros(len(i), bool)
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i[~seen], copies[j[~seen]])
        np.add.at(links, j[~seen], copies[i[~seen]])
        root = np.arange(len(rep))
        while len(i):
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        some = (links > 0) | (root < np.arange(len(rep)))
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[root[some]]})

    found = named.groupBy(*key, "low", "high").applyInPandas(compare, "rep long, links long, root long")
    return members, kept.keep(found)


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, epsilon: float = 4.0, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding, label."""
    kept = Kept(vectors.sparkSession, "embedding-dedup")
    members, found = near_links(vectors, kept, threshold, epsilon, recall)
    counts = kept.keep(found.groupBy("rep").agg(F.sum("links").alias("links")))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(members.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    joined = components(edges, kept).select(F.col("node").alias("vec_id"), "component").hint("merge")
    counted = members.join(counts.hint("merge"), "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    counted = kept.keep(counted.groupBy("vec_id").agg(F.max("n_links").alias("n_links")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = out.join(counted.hint("merge"), "vec_id", "left").join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
