"""Image-collection operations over long pixel tables (scene, x, y, t, band columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_filter(pixels: DataFrame, start: str, end: str, t: str = "t") -> DataFrame:
    """start <= t < end."""
    return pixels.where((F.col(t) >= F.lit(start).cast("timestamp_ntz")) & (F.col(t) < F.lit(end).cast("timestamp_ntz")))


def median_composite(pixels: DataFrame, value: str = "value", *extra: str) -> DataFrame:
    """Exact median over time per pixel; null (masked) observations are ignored."""
    return pixels.groupBy("x", "y", *extra).agg(F.percentile(value, 0.5).alias("median"))


def mosaic(pixels: DataFrame, value: str = "value", order: str = "t") -> DataFrame:
    """The latest unmasked observation of every pixel."""
    return pixels.where(F.col(value).isNotNull()).groupBy("x", "y").agg(F.max_by(value, order).alias("value"))


def normalized_difference(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, (a - b) / (a + b))


def masked(value: Column, keep: Column) -> Column:
    return F.when(keep, value)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in 0..1 of channels in 0..1."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = (
        F.when(d == 0, F.lit(0.0))
        .when(hi == r, F.pmod((g - b) / d + 6, F.lit(6.0)))
        .when(hi == g, (b - r) / d + 2)
        .otherwise((r - g) / d + 4)
    ) / 6
    return h, F.when(hi > 0, d / hi).otherwise(F.lit(0.0)), hi


def focal(mask: DataFrame, radius: int, how) -> DataFrame:
    """`how` (F.max or F.min) over the (2 radius + 1)^2 square of known pixels around every known pixel."""
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    spread = mask.withColumn("o", F.explode(off)).select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), "v")
    return spread.groupBy("x", "y").agg(how("v").alias("v")).join(mask.select("x", "y"), ["x", "y"], "left_semi")


def closing(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Morphological closing: dilation, then erosion."""
    return focal(focal(mask, radius, F.max), radius, F.min)
