"""Which regions contain a point: trapezoidal decomposition into ordered slabs, then a bisection inside the slab."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import cut

Ring = list[tuple[float, float]]


def parse_areas(text: str | None) -> list[list[Ring]]:
    """Polygons (each a list of rings) of WKT, EWKT or GeoJSON (multi)polygon text; [] if the text holds none."""
    s = (text or "").strip()
    try:
        if s.startswith("{"):
            g = json.loads(s)
            g = g.get("geometry", g)
            polys = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[g["type"]](g["coordinates"])
        else:
            m = re.match(r"(?is)(?:SRID\s*=\s*4326\s*;)?\s*(MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", s)
            if not m:
                return []
            points = re.sub(r"([^\s(),]+)\s+([^\s(),]+)[^(),]*", r"[\1,\2]", m[2])
            c = json.loads(points.replace("(", "[").replace(")", "]"))
            polys = c if m[1] else [c]
        out = []
        for poly in polys:
            rings = []
            for ring in poly:
                pts = [(float(p[0]), float(p[1])) for p in ring]
                pts = [p for p in pts if all(map(math.isfinite, p))]
                pts = [p for i, p in enumerate(pts) if i == 0 or p != pts[i - 1]]
                if len(pts) > 1 and pts[0] == pts[-1]:
                    pts.pop()
                if len(pts) >= 3:
                    rings.append(_unwrapped(pts, rings[0][0][0] if rings else None))
            if rings:
                out.append(rings)
        return out
    except (ValueError, KeyError, TypeError, IndexError):
        return []


def _unwrapped(pts: Ring, near: float | None) -> Ring:
    """The ring without jumps of a full turn, so that an area across the 180 degree meridian is one piece."""
    out = [pts[0]]
    for x, y in pts[1:]:
        out.append((x + 360 * round((out[-1][0] - x) / 360), y))
    if near is not None:
        turn = 360 * round((near - out[0][0]) / 360)
        out = [(x + turn, y) for x, y in out]
    return out


def slabs_of(rings: list[Ring]) -> list[tuple[float, float, list[tuple[float, float]]]]:
    """Ordered vertical slabs (x0, x1, edges) of one polygon; edges are (y at x0, y at x1) from bottom to top.

    Slab borders are all vertex longitudes and all crossings of edges, so edges keep their order within a slab and a
    point is inside if an odd number of them lies below it. Vertical edges bound slabs and carry no entry.
    """
    edges = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if x1 != x2:
                edges.append((x1, y1, x2, y2) if x1 < x2 else (x2, y2, x1, y1))
    xs = {e[0] for e in edges} | {e[2] for e in edges}
    edges.sort()
    for i, (ax1, ay1, ax2, ay2) in enumerate(edges):
        ka = (ay2 - ay1) / (ax2 - ax1)
        for bx1, by1, bx2, by2 in edges[i + 1 :]:
            if bx1 >= ax2:
                break
            kb = (by2 - by1) / (bx2 - bx1)
            if ka != kb:
                x = (by1 - ay1 + ka * ax1 - kb * bx1) / (ka - kb)
                if max(ax1, bx1) < x < min(ax2, bx2):
                    xs.add(x)
    cuts, out, active, k = sorted(xs), [], [], 0
    for x0, x1 in zip(cuts, cuts[1:]):
        while k < len(edges) and edges[k][0] <= x0:
            active.append(edges[k])
            k += 1
        active = [e for e in active if e[2] > x0]
        at = lambda e, x: e[1] + (e[3] - e[1]) * (x - e[0]) / (e[2] - e[0])
        here = sorted(((at(e, x0), at(e, x1)) for e in active), key=lambda p: (p[0] + p[1], p[0]))
        if here:
            out.append((x0, x1, here))
    return out


def region_slabs(regions: DataFrame, id_col: str = "region_id", geometry: str = "geometry") -> DataFrame:
    """(region_id, x0, x1, ylow, yhigh, edges) of all regions; one region is decomposed per call, regions in parallel.

    Null or unreadable geometries and null ids give no slabs.
    """

    def decompose(batches):
        for pdf in batches:
            rows = []
            for rid, text in zip(pdf["region_id"], pdf["geometry"]):
                for rings in parse_areas(text):
                    for x0, x1, edges in slabs_of(rings):
                        low, high = min(map(min, edges)), max(map(max, edges))
                        for turn in (0, *(-360 for _ in [0] if x1 > 180), *(360 for _ in [0] if x0 < -180)):
                            rows.append((rid, x0 + turn, x1 + turn, low, high, [{"a": a, "b": b} for a, b in edges]))
            yield pd.DataFrame(rows, columns=["region_id", "x0", "x1", "ylow", "yhigh", "edges"])

    r = regions.select(F.col(id_col).cast("bigint").alias("region_id"), F.col(geometry).alias("geometry")).where("region_id is not null and geometry is not null")
    return r.mapInPandas(decompose, "region_id bigint, x0 double, x1 double, ylow double, yhigh double, edges array<struct<a:double,b:double>>")


def locate(points: DataFrame, regions: DataFrame, id_col: str = "id", lon: str = "lon", lat: str = "lat", region_id: str = "region_id", geometry: str = "geometry", cell_x: float = 0.0625, cell_y: float = 0.5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, region_id) of each point and each region that contains it, once per pair.

    The slabs are distributed by the cells they touch and joined with the points of the same cell: broadcast while
    their measured size is within `broadcast_bytes`, else both sides are shuffled and hot cells split by adaptive
    skew-join handling. In its slab a point bisects the ordered edges. Points on an outline may
    count either way. Points without location and empty tables give no rows; overlapping regions give several.
    """
    s = cut(region_slabs(regions, region_id, geometry))
    cells = lambda a, b, size: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    s = s.withColumn("cx", F.explode(cells("x0", "x1", cell_x))).withColumn("cy", F.explode(cells("ylow", "yhigh", cell_y)))
    p = points.select(F.col(id_col).alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat")).where("id is not null and lon is not null and lat is not null")
    p = p.withColumn("cx", F.floor(F.col("lon") / cell_x)).withColumn("cy", F.floor(F.col("lat") / cell_y))
    size = s.agg(F.coalesce(F.sum(F.size("edges") * 16 + 80), F.lit(0)).alias("b")).first()["b"]
    s = F.broadcast(s) if size <= broadcast_bytes else s.hint("merge")
    j = p.join(s, ["cx", "cy"]).where("lon >= x0 and lon < x1 and lat >= ylow and lat <= yhigh")
    n, t = F.size("edges"), (F.col("lon") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    mid = lambda acc: F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
    edge = lambda acc: F.element_at("edges", mid(acc) + 1)
    below = lambda acc: edge(acc)["a"] + (edge(acc)["b"] - edge(acc)["a"]) * t <= F.col("lat")
    found = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int")),
        F.struct(F.lit(0).alias("lo"), n.alias("hi")),
        lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc)
        .when(below(acc), F.struct((mid(acc) + 1).alias("lo"), acc["hi"].alias("hi")))
        .otherwise(F.struct(acc["lo"].alias("lo"), mid(acc).alias("hi"))),
        lambda acc: acc["lo"],
    )
    return j.where(found % 2 == 1).select("id", "region_id").distinct()
