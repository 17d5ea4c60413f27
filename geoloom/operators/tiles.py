"""Tile grids: chips of an MGRS square, image windows, web-mercator neighbours, detection squares and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.graph import connected_components


def chip_grid(squares: DataFrame, size_px: int = 32, overlap_px: int = 16, resolution: float = 10.0) -> DataFrame:
    """(mgrs_id, j, i, cx, cy, tile_id) of chips over squares (mgrs_id, x0, y0, x1, y1 in UTM metres).

    Centres lie at the south-west corner plus multiples of (size - overlap) * resolution, round(extent / spacing) + 1
    of them each way (half-even); a chip counts if its square meets the square of the tile.
    """
    step, half = (size_px - overlap_px) * resolution, size_px * resolution / 2
    count = lambda a, b: (F.bround((F.col(b) - F.col(a)) / step, 0) + 1).cast("int")
    g = squares.withColumn("i", F.explode(F.sequence(F.lit(0), count("x0", "x1") - 1)))
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0), count("y0", "y1") - 1)))
    g = g.withColumns({"cx": F.col("x0") + F.col("i") * step, "cy": F.col("y0") + F.col("j") * step})
    g = g.where((F.col("cx") - half <= F.col("x1")) & (F.col("cx") + half >= F.col("x0")) & (F.col("cy") - half <= F.col("y1")) & (F.col("cy") + half >= F.col("y0")))
    res = f"{resolution:g}"
    return g.select("mgrs_id", "j", "i", "cx", "cy", F.concat_ws("_", "mgrs_id", F.lit(size_px), F.lit(overlap_px), F.lit(res), F.col("j"), F.col("i")).alias("tile_id"))


def image_windows(images: DataFrame, size: int, overlap: float) -> DataFrame:
    """(image, row, col, height, width) windows with stride int((1 - overlap) size), clipped to the image."""
    stride = int((1 - overlap) * size)
    w = images.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("h") - 2, F.lit(stride)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w") - 2, F.lit(stride))))
    return w.select("image", "row", "col", F.least(F.lit(size), F.col("h") - F.col("row")).alias("height"), F.least(F.lit(size), F.col("w") - F.col("col")).alias("width"))


def neighbour_tiles(tiles: DataFrame) -> DataFrame:
    """The 3 x 3 tiles around (zoom, x, y): x wraps around the globe, rows beyond the poles are left out."""
    n = F.pow(F.lit(2.0), F.col("zoom").cast("double")).cast("bigint")
    t = tiles.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    t = t.withColumns({"nx": F.pmod(F.col("x") + F.col("dx"), n), "ny": F.col("y") + F.col("dy")})
    return t.where((F.col("ny") >= 0) & (F.col("ny") < n)).drop("dx", "dy")


def geo_to_pixel(lon: Column, lat: Column, west: float, south: float, east: float, north: float, width: int, height: int) -> tuple[Column, Column]:
    """Pixel column and row in an image of a box; rows count from the north."""
    return (lon - west) / (east - west) * width, (F.lit(north) - lat) / (north - south) * height


def union_components(boxes: DataFrame, cell: float) -> DataFrame:
    """(id, component): axis-aligned boxes (id, x0, y0, x1, y1) that touch or overlap, directly or in a chain.

    Boxes meet in the cells of side `cell` they cover; the component is the polygon a dissolve would give.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    c = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    o = c.select("cx", "cy", *[F.col(k).alias("o_" + k) for k in ("id", "x0", "y0", "x1", "y1")])
    e = c.join(o, ["cx", "cy"]).where("id < o_id and x0 <= o_x1 and o_x0 <= x1 and y0 <= o_y1 and o_y0 <= y1").select(F.col("id").alias("u"), F.col("o_id").alias("v"))
    e = e.unionByName(boxes.select(F.col("id").alias("u"), F.col("id").alias("v")))
    return connected_components(e).select(F.col("vertex").alias("id"), "component")
