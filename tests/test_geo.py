import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, names
from geoloom.operators.near import cell_links, clique_cell, near_pairs
from geoloom.operators.regions import locate, parse_areas, slabs_of

HEX = struct.pack("<BIdd", 1, 1, 10.5, -3.25).hex()
HEX_BIG = struct.pack(">BIdd", 0, 1, 10.5, -3.25).hex().upper()
EWKB = struct.pack("<BIIdd", 1, 0x20000001, 4326, 10.5, -3.25).hex()


@pytest.mark.parametrize(
    "text,lon,lat",
    [
        ("POINT (10.5 -3.25)", 10.5, -3.25), ("point(  10.5   -3.25 )", 10.5, -3.25), ("POINT Z (10.5 -3.25 7)", 10.5, -3.25),
        ("SRID=4326;POINT(10.5 -3.25)", 10.5, -3.25), ('{"type":"Point","coordinates":[10.5,-3.25]}', 10.5, -3.25),
        (HEX, 10.5, -3.25), (HEX_BIG, 10.5, -3.25), (EWKB, 10.5, -3.25), ("POINT (350.25 1)", -9.75, 1.0), ("POINT (180 1)", -180.0, 1.0),
        ("SRID=32617;POINT(630084.3 4833438.6)", -79.387139, 43.642567), ("SRID=32755;POINT(500000 5000000)", 147.0, None),
        (None, None, None), ("", None, None), ("  ", None, None), ("POINT EMPTY", None, None), ("POINT (nan nan)", None, None),
        ("POINT (0 0)", None, None), ('{"type":"Point","coordinates":[0,0]}', None, None), ("POINT (10 95)", None, None), ("no point", None, None),
        ("x" * 100_000, None, None), (struct.pack("<BIdd", 1, 1, math.nan, 1.0).hex(), None, None),
    ],
)
def test_locations(spark, text, lon, lat):
    r = geo.with_location(spark.createDataFrame([(text, 1)], "geometry string, lon int")).first()
    if lon is None:
        assert r["lon"] is None and r["lat"] is None
    else:
        assert r["lon"] == pytest.approx(lon, abs=1e-6)
        assert lat is None or r["lat"] == pytest.approx(lat, abs=1e-6)


def test_utm_round_trip(spark):
    pts = [(random.Random(i).uniform(-179, 179), random.Random(-i).uniform(-79, 79)) for i in range(300)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), geo.utm_zone(F.col("lon")), F.col("lat") < 0)
    df = geo.once(df, "u", F.struct(e.alias("e"), n.alias("n")))
    lon, lat = geo.utm_inverse(F.col("u.e"), F.col("u.n"), geo.utm_zone(F.col("lon")), F.col("lat") < 0)
    for r in df.select("lon", "lat", lon.alias("x"), lat.alias("y")).collect():
        assert abs(r.lon - r.x) < 1e-8 and abs(r.lat - r.y) < 1e-8


def ground(a, b):
    def xyz(lon, lat):
        lo, la = math.radians(lon), math.radians(lat)
        n = geo.WGS84_A / math.sqrt(1 - geo.WGS84_E2 * math.sin(la) ** 2)
        return n * math.cos(la) * math.cos(lo), n * math.cos(la) * math.sin(lo), n * (1 - geo.WGS84_E2) * math.sin(la)

    return math.dist(xyz(*a), xyz(*b))


@pytest.mark.parametrize("radius", [20.0, 100.0, 5000.0])
def test_near_pairs_against_brute_force(spark, radius):
    rnd = random.Random(7)
    spots = [(0.001, 0.0), (179.99995, 10.0), (-179.99995, 10.0), (5.99999, 60.0), (12.0, 89.9996), (-90.0, -89.9996), (30.0, 45.0)]
    d = radius / 111_000
    pts = [(x + rnd.uniform(-2, 2) * d / max(0.02, math.cos(math.radians(y))), max(-90.0, min(90.0, y + rnd.uniform(-2, 2) * d))) for x, y in spots for _ in range(25)]
    pts = [((x + 180) % 360 - 180, y) for x, y in pts]
    pts += pts[:3]  # repeated places
    rows = [(i, x, y, "extra") for i, (x, y) in enumerate(pts)] + [(1000, None, 1.0, "x"), (None, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "id bigint, lon double, lat double, cell string")
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if ground(pts[i], pts[j]) <= radius}
    got = [(r.id_a, r.id_b) for r in near_pairs(df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_cells_connect_like_pairs(spark):
    rnd = random.Random(3)
    pts = [(10 + rnd.uniform(0, 3e-3), 50 + rnd.uniform(0, 2e-3)) for _ in range(150)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id bigint, lon double, lat double")
    df = df.withColumn("c", clique_cell(F.col("lon"), F.col("lat"), 20.0))
    cell = {r.id: r.c for r in df.collect()}
    for i in range(150):
        for j in range(i):
            assert cell[i] != cell[j] or ground(pts[i], pts[j]) <= 20
    links = {(r.cell_a, r.cell_b) for r in cell_links(df, 20.0, "id", "lon", "lat", "c").collect()}
    want = {tuple(sorted((cell[i], cell[j]))) for i in range(150) for j in range(i) if cell[i] != cell[j] and ground(pts[i], pts[j]) <= 20}
    assert links == want


def test_near_pairs_of_nothing(spark):
    assert near_pairs(spark.createDataFrame([], "id bigint, lon double, lat double"), 100).count() == 0


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rnd, cx, cy, r, n=14):
    return [(cx + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def wkt(rings):
    return "(" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def test_regions_against_ray_casting(spark):
    rnd = random.Random(11)
    hole = [(5.1, 5.1), (5.3, 5.1), (5.3, 5.3), (5.1, 5.3)]
    a, b, c = star(rnd, 5, 5, 1), star(rnd, 5.4, 5.2, 1.2), star(rnd, 7, 5, 0.5)
    bow = [(4.0, 4.0), (6.0, 6.0), (6.0, 4.0), (4.0, 6.0)]  # crosses itself
    regions = [(1, "POLYGON " + wkt([a, hole])), (2, "polygon" + wkt([b[::-1]])), (3, "MULTIPOLYGON (" + wkt([c]) + ", " + wkt([hole]) + ")"), (4, "POLYGON " + wkt([bow])), (5, None), (6, "POLYGON EMPTY"), (None, "POLYGON " + wkt([a])), (7, '{"type":"Polygon","coordinates":[[[179.5,0],[-179.5,0],[-179.5,1],[179.5,1],[179.5,0]]]}')]
    pts = [(i, rnd.uniform(3, 8), rnd.uniform(3, 7)) for i in range(600)] + [(1000, 179.9, 0.5), (1001, -179.9, 0.5), (1002, 178.0, 0.5), (1003, None, None)]
    got = {(r.id, r.region_id) for r in locate(spark.createDataFrame(pts, "id bigint, lon double, lat double"), spark.createDataFrame(regions, "region_id bigint, geometry string")).collect()}
    want = {(1000, 7), (1001, 7)}
    for i, x, y in pts[:600]:
        want |= {(i, k) for k, rings in ((1, [a, hole]), (2, [b]), (3, [c]), (3, [hole]), (4, [bow])) if inside(rings, x, y)}
    assert got == want
    few = locate(spark.createDataFrame(pts, "id bigint, lon double, lat double"), spark.createDataFrame(regions, "region_id bigint, geometry string"), broadcast_bytes=0)
    assert {(r.id, r.region_id) for r in few.collect()} == want


def test_slabs_are_ordered():
    for x0, x1, edges in slabs_of([star(random.Random(5), 0, 0, 3, 40)]):
        assert x0 < x1 and len(edges) % 2 == 0
        assert all(p[0] <= q[0] + 1e-12 and p[1] <= q[1] + 1e-12 for p, q in zip(edges, edges[1:]))


@pytest.mark.parametrize("text", [None, "", "POINT (1 2)", "POLYGON ((1 2, 3))", '{"type":"Polygon"}', "{", "POLYGON ((a b, c d, e f))"])
def test_unreadable_areas(text):
    assert parse_areas(text) == []


def test_tile_keys(spark):
    t = ["39FUU_32_16_10_430_296", " 39fuu-032-16-10-0430-296  ", "3GUL0192009600", "", "  ", None, "39FUU_32_16_10_0_296", "39FUU_32_16_10_000_296"]
    k = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t string").orderBy("i").select(names.tile_key(F.col("t"))).collect()]
    assert k[0] == k[1] and k[2] == "3GUL0192009600" and k[3:6] == [None, None, None] and k[6] == k[7] == "39FUU_32_16_10_0_296"
