"""Geodesy and geometry as plain column expressions (no UDF, stays in whole-stage codegen).

WGS84 constants and the Krueger series are the published ones. All angles are degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
UTM_K0 = 0.9996
_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def utm_zone(lon: Column) -> Column:
    """UTM zone 1..60; longitude 180 belongs to zone 60."""
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the point's UTM zone: 326zz north, 327zz south."""
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def utm_forward(lon: Column, lat: Column, zone, south) -> tuple[Column, Column]:
    """Easting and northing in metres in the given zone and hemisphere."""
    c = 2 * math.sqrt(_N) / (1 + _N)
    phi = F.radians(lat)
    dl = F.radians(lon - (_c(zone) * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(c) * F.atanh(F.lit(c) * s))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    de, dn = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        de = de + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        dn = dn + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    k = UTM_K0 * _RECT
    return F.lit(500000.0) + F.lit(k) * de, F.when(_c(south), F.lit(1e7)).otherwise(F.lit(0.0)) + F.lit(k) * dn


def utm_conformal(easting: Column, northing: Column, south) -> Column:
    """struct<chi,dlon>: conformal latitude and longitude from the zone's middle, in radians."""
    k = UTM_K0 * _RECT
    xi = (northing - F.when(_c(south), F.lit(1e7)).otherwise(F.lit(0.0))) / k
    eta = (easting - 500000.0) / k
    x2, e2 = xi, eta
    for j, b in enumerate(_BETA, 1):
        x2 = x2 - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        e2 = e2 - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    return F.struct(F.asin(F.sin(x2) / F.cosh(e2)).alias("chi"), F.atan2(F.sinh(e2), F.cos(x2)).alias("dlon"))


def geodetic_of(conformal: Column, zone) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a utm_conformal struct."""
    lat = conformal["chi"]
    for j, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(conformal["chi"] * (2 * j))
    return F.degrees(conformal["dlon"]) + (_c(zone) * 6 - 183), F.degrees(lat)


def utm_inverse(easting: Column, northing: Column, zone, south) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM position."""
    return geodetic_of(utm_conformal(easting, northing, south), zone)


def _double_of_hex(h: Column) -> Column:
    """IEEE 754 double from 16 big-endian hex digits; NaN and infinities give null."""
    hi = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")
    e = F.shiftright(hi, 20).bitwiseAND(F.lit(0x7FF).cast("bigint"))
    m = (hi.bitwiseAND(F.lit(0xFFFFF).cast("bigint")).cast("double") * 4294967296.0 + lo.cast("double")) / 4503599627370496.0
    sign = F.when(F.shiftright(hi, 31).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(e == 2047, F.lit(None).cast("double"))
        .when(e == 0, sign * m * F.lit(2.0**-1022))
        .otherwise(sign * (1 + m) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    )


def _reverse_bytes(h: Column, n: int) -> Column:
    return F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(n, 0, -1)])


_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_WKT_POINT = rf"(?i)^(?:SRID\s*=\s*(\d+)\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*{_NUMBER}\s+{_NUMBER}[\s)]"
_JSON_POINT = rf'"coordinates"\s*:\s*\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*[,\]]'


def _parts_of_text(s: Column) -> Column:
    """struct<x,y,srid> of strings: decimal for WKT and GeoJSON, 16 big-endian hex digits for WKB."""
    js, hexed = s.startswith("{"), s.rlike(r"^(00|01)[0-9A-Fa-f]{40,}$")
    return (
        F.when(hexed, _parts_of_hex(s))
        .when(js, F.struct(F.regexp_extract(s, _JSON_POINT, 1).alias("x"), F.regexp_extract(s, _JSON_POINT, 2).alias("y"), F.lit("").alias("srid"), F.lit(False).alias("hex")))
        .otherwise(F.struct(F.regexp_extract(s, _WKT_POINT, 2).alias("x"), F.regexp_extract(s, _WKT_POINT, 3).alias("y"), F.regexp_extract(s, _WKT_POINT, 1).alias("srid"), F.lit(False).alias("hex")))
    )


def _parts_of_hex(s: Column) -> Column:
    little = s.startswith("01")
    kind = F.when(little, _reverse_bytes(F.substring(s, 3, 8), 4)).otherwise(F.substring(s, 3, 8))
    has_srid = F.upper(F.substring(kind, 1, 1)).isin("2", "3", "A", "B", "6", "7", "E", "F")
    off = F.when(has_srid, F.lit(19)).otherwise(F.lit(11))
    is_point = F.substring(kind, 7, 2) == "01"
    at = lambda pos, n: F.when(is_point, F.when(little, _reverse_bytes(s.substr(pos, F.lit(2 * n)), n)).otherwise(s.substr(pos, F.lit(2 * n))))
    srid = F.when(has_srid, F.conv(at(F.lit(11), 4), 16, 10)).otherwise(F.lit(""))
    return F.struct(at(off, 8).alias("x"), at(off + 16, 8).alias("y"), srid.alias("srid"), F.lit(True).alias("hex"))


def with_location(df, geometry: str = "geometry", lon: str = "lon", lat: str = "lat"):
    """Add lon/lat of a point text, null where it holds no location; existing columns of these names are replaced.

    Reads WKT in any letter case and spacing (also POINT Z), EWKT with SRID 4326 or a WGS84 UTM code, GeoJSON points
    and hex (E)WKB of either byte order. Longitudes come back in [-180, 180). Null, blank, EMPTY, NaN or unreadable
    text, other SRIDs, the 0/0 placeholder and latitudes beyond the poles are no locations.
    """
    t, p, m, q = F.col("__text"), F.col("__point"), F.col("__mercator"), F.col("__deg")
    df = once(df, "__text", _parts_of_text(F.trim(F.col(geometry))))
    number = lambda c: F.when(~t["hex"], t[c].try_cast("double")).when(F.length(t[c]) == 16, _double_of_hex(t[c]))
    df = once(df, "__point", F.struct(number("x").alias("x"), number("y").alias("y"), F.coalesce(t["srid"].try_cast("int"), F.lit(4326)).alias("srid")))
    is_utm = p["srid"].between(32601, 32660) | p["srid"].between(32701, 32760)
    df = once(df, "__mercator", F.when(is_utm, utm_conformal(p["x"], p["y"], p["srid"] > 32700)))
    ulon, ulat = geodetic_of(m, p["srid"] % 100)
    plain = (p["srid"] == 4326) & ~((p["x"] == 0) & (p["y"] == 0))
    df = once(df, "__deg", F.when(is_utm, F.struct(ulon.alias("lon"), ulat.alias("lat"))).when(plain, F.struct(p["x"].alias("lon"), p["y"].alias("lat"))))
    ok = ~F.isnan(q["lon"]) & ~F.isnan(q["lat"]) & q["lat"].between(-90, 90) & q["lon"].between(-360, 360)
    wrapped = F.when((q["lon"] >= -180) & (q["lon"] < 180), q["lon"]).otherwise(F.pmod(q["lon"] + 180, F.lit(360.0)) - 180)
    df = once(df, "__ok", F.when(ok, F.struct(wrapped.alias("lon"), q["lat"].alias("lat"))))
    return df.withColumns({lon: F.col("__ok.lon"), lat: F.col("__ok.lat")}).drop("__text", "__point", "__mercator", "__deg", "__ok")


def once(df, name: str, expression: Column):
    """Add a column that later steps cannot inline: large expressions used several times would multiply otherwise."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(expression)).alias(name))


def ecef(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Earth-centred metres of a point on the ellipsoid; chords of up to a few km equal ground distance to a millimetre."""
    lo, la = F.radians(lon), F.radians(lat)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.sin(la) * F.sin(la))
    return n * F.cos(la) * F.cos(lo), n * F.cos(la) * F.sin(lo), n * (1 - WGS84_E2) * F.sin(la)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against an array<struct<x,y>> ring (closed or not), evaluated with higher-order functions."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            ((F.element_at(ring, i)["y"] > y) != (F.element_at(ring, i % n + 1)["y"] > y))
            & (
                x
                < (F.element_at(ring, i % n + 1)["x"] - F.element_at(ring, i)["x"])
                * (y - F.element_at(ring, i)["y"])
                / (F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i)["y"])
                + F.element_at(ring, i)["x"]
            ),
            1,
        ).otherwise(0),
    )
    return F.when(n < 3, F.lit(False)).otherwise(crossings % 2 == 1)


def ring_literal(points: list[tuple[float, float]]) -> Column:
    """A constant ring for point_in_ring."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Point in a constant polygon; the bounding box comes first so that it reaches the Parquet scan."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            hit = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - y1) + x1)
            odd = odd != hit
    return box & odd


def slippy_index(lon: Column, lat: Column, zoom) -> tuple[Column, Column]:
    """Fractional web-mercator tile indices; floor them for the tile's x and y."""
    n = F.pow(F.lit(2.0), _c(zoom).cast("double"))
    t = F.tan(F.radians(lat))
    return (lon + 180) / 360 * n, (1 - F.log(t + F.sqrt(1 + t * t)) / math.pi) / 2 * n


def slippy_center(x: Column, y: Column, zoom) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's middle (mean of its edges)."""
    n = F.pow(F.lit(2.0), _c(zoom).cast("double"))
    edge = lambda yy: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * yy / n))))
    return (x + 0.5) / n * 360 - 180, (edge(y) + edge(y + 1)) / 2


METRES_PER_PIXEL_Z0 = 156543.03392  # web mercator, 256-pixel tiles, at the equator


def metres_per_pixel(lat: Column, zoom) -> Column:
    return F.lit(METRES_PER_PIXEL_Z0) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), _c(zoom).cast("double"))


def zoom_for_coverage(lat: Column, coverage_m: Column, tile_px: int = 256, zoom_max: int = 22) -> Column:
    """Zoom whose tile covers about `coverage_m` on the ground, half-even rounded, 0..zoom_max; null for bad input."""
    per_px = coverage_m / tile_px
    z = F.bround(F.log2(F.lit(METRES_PER_PIXEL_Z0) * F.cos(F.radians(lat)) / per_px), 0).cast("int")
    return F.when((coverage_m > 0) & (F.cos(F.radians(lat)) > 0), F.least(F.lit(zoom_max), F.greatest(F.lit(0), z)))
