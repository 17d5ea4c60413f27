"""Problem 5: splits that keep related records together.

Rows are related if they share a tile or a place, directly or through further rows. Tiles and ground cells are the
vertices; rows only link them. Random-mate contraction (geoloom.operators.graph) labels the components, which are then
dealt to the splits along a running total of their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import with_location
from geoloom.functions.names import tile_key
from geoloom.operators.graph import connected_components
from geoloom.operators.near import cell_links, clique_cell
from geoloom.operators.prefix import bucket_count, running_total
from geoloom.session import cut


def related_groups(df: DataFrame, id_col: str = "id", tile_col: str = "tile_id", geometry: str = "geometry", metres: float = 20.0, seed: int = 17) -> DataFrame:
    """(id, group_id, group_size) for every row with an id; group_id is the smallest id of the group.

    Same tile: equal canonical tile ids (see names.tile_key). Same place: at most `metres` apart on the ground. A row
    without tile and location is a group of its own; so is a row that shares neither. Repeated ids share one group
    row each. Empty tables give an empty result. Only tiles held by several rows and cells that are shared or linked
    enter the graph; a hot tile is one vertex however many rows it has.
    """
    g = with_location(df.select(F.col(id_col).alias("id"), F.col(tile_col).alias("tile"), F.col(geometry).alias("geometry")), "geometry")
    cell = F.when(F.col("lon").isNotNull(), clique_cell(F.col("lon"), F.col("lat"), metres))
    r = cut(g.where("id is not null").select("id", tile_key(F.col("tile")).alias("t"), "lon", "lat").withColumn("c", cell))
    tiles = r.where("t is not null").groupBy("t").agg(F.count("*").alias("n"), F.min("id").alias("v")).where("n > 1")
    tiles = tiles.select("t", F.concat(F.lit("t"), F.col("v").cast("string")).alias("tv"))
    links = cut(cell_links(r, metres, "id", "lon", "lat", "c"))
    shared = r.where("c is not null").groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    cells = shared.union(links.select("cell_a")).union(links.select("cell_b")).distinct()
    vertex = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    cells = cells.select("c", vertex("c").alias("cv"))
    m = r.select("id", "t", "c").join(tiles, "t", "left").join(cells, "c", "left").select("id", "tv", "cv")
    m = cut(m)
    edges = m.where("tv is not null and cv is not null").select(F.col("tv").alias("u"), F.col("cv").alias("v"))
    comp = connected_components(edges.union(links.select(vertex("cell_a"), vertex("cell_b"))), seed=seed)
    m = m.select("id", F.coalesce("tv", "cv").alias("vertex"))
    j = m.where("vertex is not null").join(comp, "vertex", "left").select("id", F.coalesce("component", "vertex").alias("component"))
    sizes = j.groupBy("component").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    grouped = j.join(sizes, "component").select("id", "group_id", "group_size")
    return grouped.unionByName(m.where("vertex is null").select("id", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size")))


def grouped_splits(groups: DataFrame, shares: dict[str, float], seed: int = 17, large: float = 0.001) -> DataFrame:
    """(id, group_id, split): whole groups dealt to splits so that the rows have the given shares.

    Groups are laid out along a line, largest first where they hold at least `large` of all rows (at most 1/large
    groups), the rest by a hash; a group belongs to the split in whose stretch its middle lies. Shares are scaled to
    sum to 1, so a split differs from its share by at most half a group at each end.
    """
    total_share = sum(shares.values())
    if not shares or total_share <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must be positive")
    g = cut(groups.groupBy("group_id").agg(F.count("*").alias("n")))
    buckets = bucket_count(g.count())
    total = g.agg(F.sum("n").alias("total"))
    g = g.crossJoin(F.broadcast(total))  # one row
    h = F.xxhash64("group_id", F.lit(seed))
    bucket = F.when(F.col("n") >= F.lit(large) * F.col("total"), F.lit(0)).otherwise(F.pmod(h, F.lit(buckets - 1)).cast("int") + 1)
    g = running_total(g, [], bucket, [F.col("n").desc(), h, F.col("group_id")], "n", "before")
    mid = (F.col("before") + F.col("n") / 2) / F.col("total")
    split, edge, names = F.lit(None).cast("string"), 0.0, list(shares)
    for name in names:
        edge += shares[name] / total_share
        split = F.coalesce(split, F.when(mid < (edge if name != names[-1] else 2.0), F.lit(name)))
    return groups.select("id", "group_id").join(g.select("group_id", split.alias("split")), "group_id").select("id", "group_id", "split")
