"""Vectors as array columns: distances, means, quantisation; accumulations run in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + _d(v) * _d(v)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def usable(c: Column, dim: int = 64) -> Column:
    """True for a vector of exactly `dim` finite values that are not all zero; null vectors give false."""
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")).cast("float")))
    return F.coalesce((F.size(c) == dim) & fine & F.exists(c, lambda v: v != 0), F.lit(False))


def mean_by(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Element-wise mean per key as (keys..., pos, mean): map-side combined, no vector is ever gathered whole."""
    e = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    return e.groupBy(*keys, "pos").agg(F.avg(_d(F.col("v"))).alias("mean"))


def ranges(df: DataFrame, vector: str, dim: int = 64) -> DataFrame:
    """One row (lo, hi) of arrays: least and greatest value of each of the `dim` elements; vectors of other lengths don't count."""
    fine = df.where(F.size(vector) == dim).select(F.col(vector).alias("v"))
    lo, hi = ([f(F.get("v", F.lit(i))) for i in range(dim)] for f in (F.min, F.max))
    return fine.agg(F.array(*lo).cast("array<double>").alias("lo"), F.array(*hi).cast("array<double>").alias("hi"))


def quantize_sq8(df: DataFrame, vector: str, dim: int = 64, out: str = "codes") -> DataFrame:
    """Add the scalar quantisation 0..255 of each element between its least and greatest value; null for other lengths.

    One row stays one row: the ranges are a single row of 2 dim numbers, joined to all.
    """
    code = lambda v, i: F.when(
        F.get("__r.hi", i) > F.get("__r.lo", i), F.floor((_d(v) - F.get("__r.lo", i)) / (F.get("__r.hi", i) - F.get("__r.lo", i)) * 255 + 0.5)
    ).otherwise(F.lit(0)).cast("int")
    r = ranges(df, vector, dim).select(F.struct("lo", "hi").alias("__r"))
    return df.crossJoin(F.broadcast(r)).withColumn(out, F.when(F.size(vector) == dim, F.transform(vector, code))).drop("__r")  # one row
