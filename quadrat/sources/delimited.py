"""Delimited scans and the tidy table's source and sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_IN_TEXT = "\u0001"


def _by_name(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """All fields as text, bound by the names in the header; other columns are left out, a missing one is an error.

    All files must have the header of the first.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, **options)
    df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header: {', '.join(df.columns)}")
    return df.select(*(F.col(f"`{f.name}`") for f in schema))


def read_delim_eu(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """``;`` separated UTF-8 with a header, decimal comma and grouping point; blank and ``NA`` are missing.

    Columns are bound by name. A byte order mark is skipped. Numbers keep all their digits; what is none is missing.
    """
    df = _by_name(spark, path, schema, sep=";", encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    out = []
    for f in schema:
        c = F.nullif(F.col(f"`{f.name}`"), F.lit("NA"))
        if not isinstance(f.dataType, T.StringType):
            c = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if isinstance(f.dataType, T.FractionalType) else c
            c = c.try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_delim(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, sep: str = ";") -> DataFrame:
    """``sep`` separated with a header and decimal point, bound by name; ``NA`` is missing, blank text stays blank."""
    df = _by_name(spark, path, schema, sep=sep, nullValue=NOT_IN_TEXT)
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(F.coalesce(c, F.lit("")), F.lit("NA"))
        else:
            c = F.nullif(F.trim(c), F.lit("NA")).try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_tidy(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "year", sort_by: Sequence[str] = ()
) -> None:
    """Write the tidy table: Parquet by year, or comma CSV with a header and ``NA`` for missing values.

    With ``sort_by`` the rows are dealt to files by ranges of these columns and sorted within each, missing values first. The files
    in the order of their names hold the whole table in order, and no two of them overlap, so that the statistics of Parquet
    leave out all files but a few when a range is read back. A range is cut anew where one key holds many rows: the hash of
    the row comes last in the order.
    """
    if sort_by:
        order = [*[F.col(c).asc_nulls_first() for c in sort_by], F.xxhash64(*df.columns)]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.csv(path, header=True, nullValue="NA", encoding="UTF-8")


def load_tidy(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Read the tidy table; CSV needs its schema, in file order with the partition column last."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA", nanValue="NaN", enforceSchema=True)
