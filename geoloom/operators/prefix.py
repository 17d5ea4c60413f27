"""Running totals, row numbers and first rows per key over tables of any size: no window spans a whole hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut

BEFORE = (Window.unboundedPreceding, -1)


def _offsets(sums: DataFrame, keys: list[str], value: str) -> Column:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum(value).over(w.orderBy("__bucket").rowsBetween(*BEFORE)), F.lit(0))


def _joined(df: DataFrame, sums: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    cond = F.col("a.__bucket") == F.col("b.__bucket")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return df.alias("a").join(sums.alias("b"), cond).select("a.*", *[F.col(f"b.{c}") for c in columns])


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], weight: str, out: str) -> DataFrame:
    """Add `out`, the total of `weight` over the rows before this one within `keys`, in order of bucket, then `order`.

    `bucket` is an int. The offsets are a window over the sums per key and bucket; the rows themselves are only ever
    sorted within one bucket of one key, so choose as many buckets as keep those small (see bucket_count).
    """
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy(*keys, "__bucket").agg(F.sum(weight).alias("__sum"))
    sums = sums.withColumn("__offset", _offsets(sums, keys, "__sum")).drop("__sum")
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(*BEFORE)
    return _joined(df, sums, keys, "__offset").withColumn(out, F.col("__offset") + F.coalesce(F.sum(weight).over(within), F.lit(0))).drop("__bucket", "__offset")


def bucket_count(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    """Buckets for a table of `rows`, so that even a key that holds all of it has about `per_bucket` rows in each."""
    return max(least, -(-rows // per_bucket))


def first_per_key(df: DataFrame, keys: list[str], limit: str, bucket: Column, order: list[Column], out: str = "rank") -> DataFrame:
    """The first `limit` (a column, constant per key) rows of every key in order of bucket, then `order`; `out` is 1, 2, ...

    Rows are counted per key and bucket map-side; only rows of buckets that can hold one of the first are shuffled, by
    key and bucket, so a hot key is spread over as many tasks as it has buckets and is never sorted whole.
    """
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"), F.max(limit).alias("__limit"))
    sums = sums.withColumn("__offset", _offsets(sums, keys, "__n")).where(F.col("__offset") < F.col("__limit")).drop("__n", "__limit")
    w = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    j = _joined(df, sums, keys, "__offset").withColumn(out, F.col("__offset") + F.row_number().over(w))
    return j.where(F.col(out) <= F.col(limit)).drop("__bucket", "__offset")


def hash_bucket(h: Column, bits: int = 12) -> Column:
    """Bucket of a 64-bit hash; use the hash as the order within the bucket."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def in_range_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows range-partitioned by `order` and written once, with their partition number in __bucket.

    Range bounds are sampled anew with every execution, so numbers counted in one must not meet rows of another: the
    written table fixes them.
    """
    return cut(df.repartitionByRange(*order).withColumn("__bucket", F.spark_partition_id()))


def row_numbers(df: DataFrame, *order: Column | str, name: str = "row_no") -> DataFrame:
    """Add 1..n in the given order (make it total for a result that never changes) without a sort in one task."""
    r = in_range_order(df, *order)
    sums = r.groupBy("__bucket").agg(F.count("*").alias("__n"))
    sums = F.broadcast(sums.select("__bucket", _offsets(sums, [], "__n").alias("__offset")))  # one row per partition
    n = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return r.join(sums, "__bucket").withColumn(name, (F.col("__offset") + n).cast("bigint")).drop("__bucket", "__offset")


def total_before(df: DataFrame, weight: str, *order: Column | str, out: str = "before") -> DataFrame:
    """Add the total of `weight` over all rows before this one in the given order, without a sort in one task."""
    r = in_range_order(df, *order)
    sums = r.groupBy("__bucket").agg(F.sum(weight).alias("__n"))
    sums = F.broadcast(sums.select("__bucket", _offsets(sums, [], "__n").alias("__offset")))  # one row per partition
    s = F.coalesce(F.sum(weight).over(Window.partitionBy("__bucket").orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    return r.join(sums, "__bucket").withColumn(out, F.col("__offset") + s).drop("__bucket", "__offset")
