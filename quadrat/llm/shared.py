"""Helpers of this subpackage: tables kept in the shared folder, fixed-size bitmaps, checks of ids."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.session import Scratch


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that functions run there import it from any working folder."""
    context = spark.sparkContext
    if getattr(context, "_quadrat_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quadrat-")) / "quadrat.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    context._quadrat_shipped = True


class Kept(Scratch):
    """Tables written below ``spark.checkpoint.dir``; each cuts the lineage, so a lost executor costs a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        super().__init__(spark, name)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{next(self.count)}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_dealt(self, df: DataFrame, key: str) -> DataFrame:
        """The same of rows that are dealt by ``key`` to as many partitions as a shuffle has: joins on it leave them where they lie."""
        name = f"scratch_{uuid.uuid4().hex}"
        out = df.write.bucketBy(shuffle_width(self.spark), key).sortBy(key).option("compression", "zstd")
        out.option("path", f"{self.path}/{next(self.count)}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit words: each output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def id_bitmap(ids: DataFrame, column: str, log2_bits: int = 25, hashed: bool = False) -> np.ndarray:
    """Bitmap of fixed size with a bit set for each id's hash: 4 MB at the default, whatever the number of ids.

    ``hashed``: the ids are hashes, whose low bits are taken.
    """
    code = F.col(column).cast("long")
    bit = F.pmod(code if hashed else F.xxhash64(code), F.lit(1 << log2_bits))
    words = (
        ids.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the hash positions are set."""
    at = bits.astype(np.int64)
    return ((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def only_in_bitmap(df: DataFrame, column: str, bitmap: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose id may be in the bitmap's set (a superset: an exact join has to follow), or the others."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    size = bitmap.size * 64
    position = F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size)))
    probe = df.withColumn("__bit", position)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            bits = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = in_bitmap(shared.value, np.maximum(bits, 0)) & (bits >= 0)
            yield batch.drop_columns(["__bit"]).filter(pa.array(hit == inside))

    return probe.mapInArrow(keep, df.schema)


def map_batches(df: DataFrame, schema: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``mapInPandas`` for functions of one batch."""

    def run(batches):
        for batch in batches:
            if len(batch):
                yield fn(batch)

    return df.mapInPandas(run, schema)
