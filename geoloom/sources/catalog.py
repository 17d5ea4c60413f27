"""Parquet ingest and the catalog of stored datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.names import region_key
from geoloom.operators.prefix import row_numbers


class IngestError(ValueError):
    """Raised for sources that cannot be ingested."""


def read_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files unioned by column name; missing columns are null."""
    if not paths:
        raise IngestError("no Parquet files")
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*paths)


def embedding_dim(df: DataFrame, vector: str = "embedding", default: int | None = None) -> int:
    """Length of the first non-null vector; the default, or an error, if there is none."""
    if vector not in df.columns or not df.schema[vector].dataType.typeName() == "array":
        raise IngestError(f"{vector} is no array column")
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    if row is None and default is None:
        raise IngestError("all embeddings are null")
    return default if row is None else row["n"]


def external_id(df: DataFrame) -> str:
    """The column that names rows to the outside: source_id, tile_id or id."""
    return next((c for c in ("source_id", "tile_id", "id") if c in df.columns), "id")


def display_id(df: DataFrame) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in ("source_id", "tile_id", "id") if c in df.columns])


def surrogate_key(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """1..n in the given order without a global sort in one task; all columns stay."""
    return row_numbers(df, *order, name=name)


def ingest(df: DataFrame, dtype: str = "FLOAT", vector: str = "embedding") -> DataFrame:
    """The stored form: vectors as float, or 0..255 as short for INT8."""
    if dtype not in ("FLOAT", "INT8"):
        raise ValueError(f"unsupported dtype {dtype}")
    return df.withColumn(vector, F.col(vector).cast("array<float>" if dtype == "FLOAT" else "array<smallint>"))


def manifest(df: DataFrame) -> DataFrame:
    """Trimmed manifest entries with a canonical region and the display name `region / model`."""
    m = df.select(*[F.trim(c).alias(c) for c in ("region_name", "model_name", "model_path")])
    return m.withColumn("region", region_key(F.col("region_name"))).withColumn("display_name", F.concat_ws(" / ", "region", "model_name"))


def protocol(path: Column) -> Column:
    return F.when(path.startswith("s3://"), F.lit("s3")).when(path.startswith("gs://"), F.lit("gs"))


def https_url(path: Column) -> Column:
    return F.regexp_replace(path, r"^s3://([^/]+)/", "https://$1.s3.amazonaws.com/")
