"""Nearest tiles, exclusion by distance, clusters of positives and spatially blocked folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import ecef, geodetic_of, once, utm_conformal, utm_forward, utm_zone
from geoloom.operators.graph import connected_components
from geoloom.operators.near import near_pairs
from geoloom.operators.prefix import row_numbers
from geoloom.session import cut


def nearest_point(tiles: DataFrame, lon: float, lat: float) -> DataFrame:
    """The tile nearest to a click in planar degrees (smallest id on ties); a per-task top 1."""
    d = F.sqrt((F.col("lon") - lon) * (F.col("lon") - lon) + (F.col("lat") - lat) * (F.col("lat") - lat))
    return tiles.where("lon is not null and lat is not null").withColumn("distance_deg", d).orderBy("distance_deg", "id").limit(1)


def _utm_distance(zone: Column, south: Column) -> Column:
    ax, ay = utm_forward(F.col("p_lon"), F.col("p_lat"), zone, south)
    bx, by = utm_forward(F.col("lon"), F.col("lat"), zone, south)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def nearest_tile_join(points: DataFrame, tiles: DataFrame, within_deg: float | None = 0.005, retry_deg: float | None = 0.02) -> DataFrame:
    """(pid, tile_id, distance_m): each point's nearest tile by UTM distance in the point's zone.

    Points (pid, lon, lat) meet the tiles of their own and the adjacent cells of `within_deg` degrees (disk around the
    point); those without a tile are tried again with `retry_deg`. Unmatched points are absent. With
    within_deg=None the nearest tile on the ground is found however far it is (see nearest_join). Ties go to the
    smaller tile_id.
    """
    p = points.select("pid", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")).where("pid is not null and p_lon is not null and p_lat is not null")
    t = tiles.where("lon is not null and lat is not null").select("tile_id", "lon", "lat")
    if within_deg is None:
        return _with_utm_distance(nearest_join(points, tiles, "tile_id"))
    first = _closest(_cell_join(p, t, within_deg))
    if retry_deg is None:
        return first
    rest = p.join(first.select("pid"), "pid", "left_anti")
    return first.unionByName(_closest(_cell_join(rest, t, retry_deg)))


def _with_utm_distance(j: DataFrame) -> DataFrame:
    d = _utm_distance(utm_zone(F.col("p_lon")), F.col("p_lat") < 0)
    return j.withColumn("distance_m", d).select("pid", "tile_id", "distance_m")


RINGS_M = (1_000.0, 16_000.0, 256_000.0)


def nearest_join(points: DataFrame, tiles: DataFrame, tie: str, *keep: str, rings: tuple[float, ...] = RINGS_M) -> DataFrame:
    """(pid, p_lon, p_lat, chord_m, tie, keep..., lon, lat): each point's nearest tile on the ground, however far.

    Rings of growing radius: a point meets the tiles of the cells its ring covers and is done once its best lies within
    the ring. From the second ring on, points first meet the *occupied cells* of the ring before; bounds on the
    distance to a cell leave the few whose tiles can be nearest. Beyond the last ring all occupied cells of its size
    are compared (the globe has fewer than 20,000 of them), so no join multiplies points by tiles. Distances are
    straight through the earth, rounded to a micrometre; ties go to the smaller `tie`. Rows without location or pid
    take no part.
    """
    p = points.select("pid", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")).where("pid is not null and p_lon is not null and p_lat is not null")
    t = tiles.where("lon is not null and lat is not null").select(*dict.fromkeys((tie, *keep, "lon", "lat")))
    chosen = F.min(F.struct("chord_m", *[c for c in t.columns])).alias("m")
    found = None
    for i, r in enumerate((*rings, None)):
        if i == 0:
            j = _latlon_cells(t, r / 110_000.0, r).join(_latlon_probes(p, r / 110_000.0, r), ["b", "c"])
        else:
            j = _through_cells(p, t, rings[i - 1], r)
        j = j.withColumn("chord_m", F.round(F.sqrt(_chord2()), 6))
        best = cut((j if r is None else j.where(F.col("chord_m") <= r)).groupBy("pid", "p_lon", "p_lat").agg(chosen))
        found = best if found is None else found.unionByName(best)
        p = p.join(best.select("pid"), "pid", "left_anti")
        if r is None or p.isEmpty():
            break
    return found.select("pid", "p_lon", "p_lat", "m.*")


def _chord2() -> Column:
    a, b = ecef(F.col("p_lon"), F.col("p_lat")), ecef(F.col("lon"), F.col("lat"))
    return sum((x - y) * (x - y) for x, y in zip(a, b))


def _through_cells(p: DataFrame, t: DataFrame, fine: float, coarse: float | None) -> DataFrame:
    """Points with the tiles of those occupied cells of size `fine` that can hold their nearest tile."""
    h = fine / 110_000.0
    tiles = _latlon_cells(t, h, fine).withColumnsRenamed({"b": "fb", "c": "fc"})
    lat, n = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), (F.col("fb") + 0.5) * h)), _columns(F.col("fb"), h, fine)
    cells = tiles.select("fb", "fc").distinct().withColumns({"lat": lat, "lon": (F.col("fc") + 0.5) / n * 360 - 180})
    # a cell's centre is at most this far from its points: half its height and half its greatest width, the next band's at most
    low = F.greatest(F.lit(0.0), F.least(F.abs(F.col("fb") * h), F.abs((F.col("fb") + 1) * h)) - 0.001)
    reach = F.lit(h / 2 * 112_000.0) + 180 * 111_400.0 * F.cos(F.radians(F.least(F.lit(90.0), low))) / n
    cells = cells.withColumn("reach", F.least(reach, F.lit(1.3e7)))
    if coarse is None:
        j = p.crossJoin(F.broadcast(cells))  # fewer than 20,000 cells: see nearest_join
    else:
        wide = coarse + 4 * fine
        j = _latlon_cells(cells, wide / 110_000.0, wide).join(_latlon_probes(p, wide / 110_000.0, wide), ["b", "c"]).drop("b", "c")
    j = j.withColumn("d", F.sqrt(_chord2())).select("pid", "p_lon", "p_lat", "fb", "fc", (F.col("d") - F.col("reach")).alias("least"), (F.col("d") + F.col("reach")).alias("most"))
    bound = j.groupBy("pid").agg(F.min("most").alias("bound"))
    can = j.join(bound, "pid").where("least <= bound").select("pid", "p_lon", "p_lat", "fb", "fc")
    return can.join(tiles, ["fb", "fc"]).drop("fb", "fc")


def _cell_join(p: DataFrame, t: DataFrame, r: float) -> DataFrame:
    cx, cy = F.floor(F.col("p_lon") / r), F.floor(F.col("p_lat") / r)
    cells = F.array(*[F.struct((cx + i).alias("x"), (cy + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = p.withColumn("c", F.explode(cells)).select("pid", "p_lon", "p_lat", "c.x", "c.y")
    t = t.withColumns({"x": F.floor(F.col("lon") / r), "y": F.floor(F.col("lat") / r)})
    dx, dy = F.col("lon") - F.col("p_lon"), F.col("lat") - F.col("p_lat")
    return p.join(t, ["x", "y"]).where(dx * dx + dy * dy <= r * r).drop("x", "y")


def _closest(j: DataFrame) -> DataFrame:
    d = _utm_distance(utm_zone(F.col("p_lon")), F.col("p_lat") < 0)
    best = j.withColumn("distance_m", d).groupBy("pid").agg(F.min(F.struct("distance_m", "tile_id")).alias("b"))
    return best.select("pid", "b.tile_id", "b.distance_m")


def far_from(tiles: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """Tiles farther than `metres` from every point: an anti join over ground cells, no buffers are dissolved.

    Tiles without a location stay. Points are spread over the cells their disk can touch.
    """
    lat_cell = metres / 110_000.0
    tagged = _latlon_cells(tiles.where("lon is not null and lat is not null").select("id", "lon", "lat"), lat_cell, metres)
    p = _latlon_probes(points.where("lon is not null and lat is not null").select(F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")), lat_cell, metres)
    a, b = ecef(F.col("lon"), F.col("lat")), ecef(F.col("p_lon"), F.col("p_lat"))
    d2 = sum((x - y) * (x - y) for x, y in zip(a, b))
    near = tagged.join(p, ["b", "c"]).where(d2 <= metres * metres).select("id").distinct()
    return tiles.join(near, "id", "left_anti")


def _columns(b: Column, h: float, metres: float) -> Column:
    far = F.least(F.lit(89.9), F.greatest(F.abs(b * h), F.abs((b + 1) * h)))
    return F.greatest(F.lit(1), F.floor(360 * 111_319.0 * F.cos(F.radians(far)) / metres)).cast("bigint")


def _latlon_cells(df: DataFrame, h: float, metres: float) -> DataFrame:
    b = F.floor(F.col("lat") / h)
    return df.withColumn("b", b).withColumn("c", F.floor((F.col("lon") + 180) / 360 * _columns(F.col("b"), h, metres)))


def _latlon_probes(df: DataFrame, h: float, metres: float) -> DataFrame:
    df = df.withColumn("b", F.explode(F.array(*[F.floor(F.col("p_lat") / h) + i for i in (-1, 0, 1)])))
    n = _columns(F.col("b"), h, metres)
    c = F.floor((F.col("p_lon") + 180) / 360 * n)
    return df.withColumn("c", F.explode(F.array_distinct(F.array(*[F.pmod(c + i, n) for i in (-1, 0, 1)]))))


def clusters_of(points: DataFrame, buffer_m: float, id_col: str = "id") -> DataFrame:
    """(id, cluster): points whose disks of radius buffer_m overlap, directly or in a chain; cluster = smallest id."""
    e = near_pairs(points, 2 * buffer_m, id_col).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    own = points.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("u"))
    return connected_components(e.unionByName(own.select("u", F.col("u").alias("v")))).select(F.col("vertex").alias("id"), F.col("component").alias("cluster"))


def _deals(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, last, order): ranks first..last-1 among the clusters of a size go around the folds of `order`.

    The greedy rule for equal sizes is a sequence of round-robin phases: folds less than one size above the lightest
    take turns, in order of load, until the next fold is as light as they are.
    """
    load, out = [0] * folds, []
    for n, m in sizes:
        at = 0
        while at < m:
            by = sorted(range(folds), key=lambda f: (load[f], f))
            turn = [f for f in by if load[f] < load[by[0]] + n]
            rest = [load[f] for f in by if load[f] >= load[by[0]] + n]
            left = m - at
            rounds = (min(rest) - load[turn[-1]] - 1) // n + 1 if rest else left // len(turn)
            take = min(left, rounds * len(turn)) if rounds else left
            out.append((n, at, at + take, turn))
            for i, f in enumerate(turn):
                load[f] += n * ((take - i + len(turn) - 1) // len(turn))
            at += take
    return out


def greedy_folds(clusters: DataFrame, folds: int) -> DataFrame:
    """(cluster, n, fold): clusters from large to small (smallest id first on ties), each to the lightest fold so far.

    The rule is sequential, but clusters of one size follow a few round-robin phases. Only the number of clusters per
    size comes to the driver (with N rows there are fewer than sqrt(2 N) different sizes); clusters are ranked over
    range partitions and look their fold up.
    """
    c = cut(clusters.groupBy("cluster").agg(F.count("*").alias("n")))
    sizes = [(r["n"], r["m"]) for r in c.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.col("n").desc()).collect()]
    starts, total = {}, 0
    for n, m in sizes:
        starts[n], total = total, total + m
    rows = [(n, starts[n] + a, starts[n] + b, order) for n, a, b, order in _deals(sizes, folds)]
    deals = clusters.sparkSession.createDataFrame(rows, "n bigint, first bigint, last bigint, turn array<int>")
    ranked = row_numbers(c, F.col("n").desc(), F.col("cluster"), name="r").withColumn("r", F.col("r") - 1)
    j = ranked.join(F.broadcast(deals), "n").where("r >= first and r < last")  # at most `folds` rows per size
    return j.select("cluster", "n", F.get("turn", ((F.col("r") - F.col("first")) % F.size("turn")).cast("int")).alias("fold"))


def spatial_folds(samples: DataFrame, folds: int = 5, buffer_m: float = 500.0) -> DataFrame:
    """(id, label, fold): positives fold by cluster, every negative follows its nearest positive (smallest id on ties).

    Samples without a location belong to no fold; without positives there are no rows.
    """
    pos = samples.where("label = 1 and lon is not null and lat is not null").select("id", "lon", "lat")
    cl = clusters_of(pos, buffer_m)
    cf = cl.join(greedy_folds(cl, folds).select("cluster", "fold"), "cluster").select("id", "fold")
    neg = samples.where("label = 0").select(F.col("id").alias("pid"), "lon", "lat")
    near = nearest_join(neg, pos, "id").select(F.col("pid").alias("nid"), "id").join(cf, "id")
    return cf.select("id", F.lit(1).alias("label"), "fold").unionByName(near.select(F.col("nid").alias("id"), F.lit(0).alias("label"), "fold"))


def tile_squares(df: DataFrame, half_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add `square`, the array<struct<x,y>> corners (SE, NE, NW, SW) of the square of side 2 half_m around each point.

    The square is made in the point's UTM zone and turned back to degrees; null where the point is null.
    """
    z, s = utm_zone(F.col(lon)), F.col(lat) < 0
    e, n = utm_forward(F.col(lon), F.col(lat), z, s)
    df = once(df, "__u", F.struct(e.alias("e"), n.alias("n")))
    u = F.col("__u")
    for i, (dx, dy) in enumerate(((1, -1), (1, 1), (-1, 1), (-1, -1))):
        df = once(df, f"__c{i}", utm_conformal(u["e"] + dx * half_m, u["n"] + dy * half_m, s))
    corner = lambda i: geodetic_of(F.col(f"__c{i}"), z)
    square = F.array(*[F.struct(corner(i)[0].alias("x"), corner(i)[1].alias("y")) for i in range(4)])
    return df.withColumn("square", F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), square)).drop("__u", *[f"__c{i}" for i in range(4)])


def polygonal_disk(dx: Column, dy: Column, radius: float, sides: int) -> Column:
    """Is (dx, dy) inside the regular polygon that stands for a buffer of `radius`?"""
    step = 2 * math.pi / sides
    d = F.sqrt(dx * dx + dy * dy)
    return d * F.cos(F.pmod(F.atan2(dy, dx) + 2 * math.pi, F.lit(step)) - step / 2) <= radius * math.cos(step / 2)
