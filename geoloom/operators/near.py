"""Points near other points: an equi-join on ground cells, refined by distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import WGS84_A, WGS84_E2, ecef, once

_M_PER_DEG_LAT = math.radians(1) * WGS84_A * (1 - WGS84_E2)  # the least on the ellipsoid, at the equator
_M_PER_DEG_LON = math.radians(1) * WGS84_A  # times cos(lat): a lower bound


def _band(lat: Column, h: float) -> Column:
    return F.floor((lat + 90) / h).cast("bigint")


def _columns_in(band: Column, h: float, radius: float) -> Column:
    """Cells around the globe in a band of latitude, each at least `radius` wide at the band's narrow edge."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band * h - 90), F.abs((band + 1) * h - 90)))
    n = F.floor(F.lit(360.0 * _M_PER_DEG_LON / (radius * 1.0001)) * F.cos(F.radians(far))).cast("bigint")
    return F.when(n < 4, F.lit(1).cast("bigint")).otherwise(n)


def _key(band: Column, col: Column) -> Column:
    return F.shiftleft(band, 32) + col


def ground_cells(df: DataFrame, radius: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add __home (the point's cell) and __probes (home and the cells ahead that can hold a point within `radius`).

    Two points within `radius` meet in exactly one way: one's home is among the other's probes. The cells follow
    longitude around the globe, so the 180 degree meridian and UTM zone borders need no special case.
    """
    h = radius * 1.0001 / _M_PER_DEG_LAT
    b = _band(F.col(lat), h)
    b1 = F.col("__b")
    n0, n1 = _columns_in(b1, h, radius), _columns_in(b1 + 1, h, radius)
    at = lambda n: F.least(n - 1, F.floor((F.col(lon) + 180) / 360 * n.cast("double")).cast("bigint"))
    one = F.lit(1).cast("bigint")
    return (
        once(df, "__b", b)
        .withColumns({"__n0": n0, "__n1": n1})
        .withColumns({"__c0": at(F.col("__n0")), "__c1": at(F.col("__n1"))})
        .withColumn("__home", _key(F.col("__b"), F.col("__c0")))
        .withColumn(
            "__probes",
            F.array_distinct(
                F.array(
                    F.col("__home"),
                    _key(F.col("__b"), (F.col("__c0") + 1) % F.col("__n0")),
                    _key(F.col("__b") + one, (F.col("__c1") - 1 + F.col("__n1")) % F.col("__n1")),
                    _key(F.col("__b") + one, F.col("__c1")),
                    _key(F.col("__b") + one, (F.col("__c1") + 1) % F.col("__n1")),
                )
            ),
        )
        .drop("__b", "__n0", "__n1", "__c0", "__c1")
    )


def near_pairs(points: DataFrame, radius: float, id_col: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(id_a, id_b, distance_m), id_a < id_b, of all points at most `radius` metres apart on the ground.

    Rows without a location or id take no part; an empty table gives an empty result; other columns are ignored, so
    clashing names do no harm. A point row that repeats an id is compared like any other but never with its own id.
    Each point goes to 5 cells, 40 bytes each; hot cells are split by adaptive skew-join handling.
    """
    x, y, z = ecef(F.col("__lon"), F.col("__lat"))
    p = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(lon).alias("__lon"), F.col(lat).alias("__lat"))
    p = ground_cells(p.where("id is not null and __lon is not null and __lat is not null"), radius, "__lon", "__lat")
    p = p.select("id", x.alias("x"), y.alias("y"), z.alias("z"), "__home", "__probes")
    a = p.select(F.explode("__probes").alias("cell"), *[F.col(c).alias(c + "1") for c in ("id", "x", "y", "z")], (F.col("cell") == F.col("__home")).alias("own"))
    b = p.select(F.col("__home").alias("cell"), *[F.col(c).alias(c + "2") for c in ("id", "x", "y", "z")])
    d2 = sum((F.col(c + "1") - F.col(c + "2")) * (F.col(c + "1") - F.col(c + "2")) for c in "xyz")
    close = (d2 <= radius * radius) & F.when(F.col("own"), F.col("id1") < F.col("id2")).otherwise(F.col("id1") != F.col("id2"))
    return a.join(b, "cell").where(close).select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b"), F.sqrt(d2).alias("distance_m"))


def clique_cell(lon: Column, lat: Column, radius: float) -> Column:
    """Key of a ground cell so small that any two of its points are at most `radius` metres apart."""
    side = radius / math.sqrt(2) * 0.999
    h = side / (_M_PER_DEG_LAT * 1.0102)  # a degree of latitude is 1.01 times longer at the poles
    b = _band(lat, h)
    wide = F.greatest(F.lit(0.0), F.least(F.abs(b * h - 90), F.abs((b + 1) * h - 90)))
    n = F.ceil(F.lit(360.0 * _M_PER_DEG_LON * 1.0034 / side) * F.cos(F.radians(wide))).cast("bigint") + 1
    return _key(b, F.least(n - 1, F.floor((lon + 180) / 360 * n.cast("double")).cast("bigint")))


def cell_links(points: DataFrame, radius: float, id_col: str, lon: str, lat: str, cell: str) -> DataFrame:
    """(cell_a, cell_b): clique cells that hold a pair of points at most `radius` apart, each pair of cells once.

    Together with "same cell" these links connect exactly the points that chains of near points connect, yet no pair
    within a cell is ever made and pairs between two cells are reduced to one row before the shuffle. Equal positions
    are compared once.
    """
    p = points.where(f"{lon} is not null and {lat} is not null").groupBy(lon, lat).agg(F.first(cell).alias("__cell"))
    x, y, z = ecef(F.col("__lon"), F.col("__lat"))
    p = ground_cells(p.select(F.col(lon).alias("__lon"), F.col(lat).alias("__lat"), "__cell"), radius, "__lon", "__lat")
    p = p.select("__cell", x.alias("x"), y.alias("y"), z.alias("z"), "__home", "__probes")
    a = p.select(F.explode("__probes").alias("cell"), *[F.col(c).alias(c + "1") for c in ("__cell", "x", "y", "z")])
    b = p.select(F.col("__home").alias("cell"), *[F.col(c).alias(c + "2") for c in ("__cell", "x", "y", "z")])
    d2 = sum((F.col(c + "1") - F.col(c + "2")) * (F.col(c + "1") - F.col(c + "2")) for c in "xyz")
    j = a.join(b, "cell").where((F.col("__cell1") != F.col("__cell2")) & (d2 <= radius * radius))
    return j.select(F.least("__cell1", "__cell2").alias("cell_a"), F.greatest("__cell1", "__cell2").alias("cell_b")).distinct()
