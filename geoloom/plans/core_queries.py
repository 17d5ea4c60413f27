"""Queries of the core library with production parameters, each over its whole tables.

`geo` is the stand-in of SURVEY 7.2: the embeddings table with ids, tile ids and a lattice of locations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import geo as G
from geoloom.functions import names, vec
from geoloom.operators import ann, labels, learning, raster, search, spatial, tiles
from geoloom.operators.near import near_pairs
from geoloom.operators.regions import locate
from geoloom.session import cut, table
from geoloom.sources import catalog, geojson

NEAR_M = 100.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def geo(spark: SparkSession, sf: str) -> DataFrame:
    five = F.lpad(F.col("vec_id").cast("string"), 5, "0")
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).cast("bigint").alias("id"), F.concat(F.lit("16SBH"), five, five).alias("tile_id"), "embedding", "label",
        (F.lit(-86.5) + (F.col("vec_id") % 25) * F.lit(1e-2)).alias("lon"), (F.lit(33.0) + F.floor(F.col("vec_id") / F.lit(25.0)) * F.lit(1e-2)).alias("lat"),
    )


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Label 0 are positives, label 1 negatives."""
    return geo(spark, sf).where("label in (0, 1)").withColumn("label", 1 - F.col("label"))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "geo_embeddings")
    return g.where(vec.usable(F.col("embedding")))


def first_vector(g: DataFrame) -> DataFrame:
    return g.orderBy("id").limit(1).select(F.col("embedding").cast("array<double>").alias("q"))


def r6(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


# tiles near one another and regions ----------------------------------------------------------------------------------
@query
def p6_found(spark, sf):
    """Pairs of tiles at most 100 m apart, and tiles with the regions that contain them."""
    g = cut(G.with_location(table(spark, sf, "geo_embeddings").select("id", "geometry")).where("lon is not null").select("id", "lon", "lat"))
    near = near_pairs(g, NEAR_M).select(F.lit("near").alias("relation"), "id_a", "id_b").distinct()
    inside = locate(g, table(spark, sf, "roi_areas")).select(F.lit("inside").alias("relation"), F.col("id").alias("id_a"), F.col("region_id").alias("id_b"))
    return near.unionByName(inside)


# search --------------------------------------------------------------------------------------------------------------
@query
def search_topk(spark, sf):
    g, ex = geo(spark, sf), examples(spark, sf)
    hits = search.top_k(g, search.as_row(search.query_vector(ex)), 20, exclude=ex.select("id"))
    return search.with_metadata(hits, g, "tile_id").select("id", "tile_id", r6("distance").alias("distance"), "rank")


@query
def query_vector(spark, sf):
    return search.query_vector(examples(spark, sf)).select("pos", r6("value").alias("value"))


@query
def topk_l2(spark, sf):
    g = stored(spark, sf)
    return search.top_k(g, first_vector(g), 1000).select("id", F.round("distance", 5).alias("distance"))


@query
def topk_cosine(spark, sf):
    g = stored(spark, sf)
    return search.top_k(g, first_vector(g), 1000, "cosine").select("id", F.round("distance", 5).alias("distance"))


@query
def search_overfetch(spark, sf):
    g, ex = geo(spark, sf), examples(spark, sf)
    return search.overfetch_top_k(g, search.as_row(search.query_vector(ex)), 100, ex).select("id", r6("distance").alias("distance"), "rank")


def _hits(spark, sf) -> DataFrame:
    g, ex = geo(spark, sf), examples(spark, sf)
    return search.top_k(g, search.as_row(search.query_vector(ex)), 200, exclude=ex.select("id"))


@query
def highlight_cutoff(spark, sf):
    return search.highlight_cutoff(_hits(spark, sf)).select(*[r6(c).alias(c) for c in ("cutoff", "low", "high")])


@query
def color_fraction(spark, sf):
    h = _hits(spark, sf)
    j = h.crossJoin(F.broadcast(search.highlight_cutoff(h)))  # one row
    return j.select("id", F.round(search.color_fraction(F.col("distance"), F.col("low"), F.col("high"), F.col("cutoff")), 5).alias("fraction"))


@query
def page_slice(spark, sf):
    h = _hits(spark, sf)
    pages = [search.page(h, i).withColumn("page", F.lit(i)) for i in range(4)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3]).select("page", "rank", "id")


@query
def dissimilar_order(spark, sf):
    return search.display_order(_hits(spark, sf), "Dissimilar").select("id", "position")


@query
def probability_fraction(spark, sf):
    d = table(spark, sf, "detections").where("probability is null or probability between 0 and 1")
    return search.with_probability_fraction(d.select("detection_id", "probability")).select("detection_id", r6("fraction").alias("fraction"))


@query
def embedding_dims(spark, sf):
    return table(spark, sf, "geo_embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).select("dim", "n")


@query
def sq8_quantize(spark, sf):
    return vec.quantize_sq8(geo(spark, sf).select("id", "embedding"), "embedding").select("id", F.posexplode("codes").alias("pos", "code"))


@query
def mean_by_label(spark, sf):
    return vec.mean_by(geo(spark, sf), "embedding", "label").select("label", "pos", r6("mean").alias("mean"))


@query
def ivf_pq_search(spark, sf):
    """The 100 tiles nearest to the first: 400 by asymmetric distances over all cells, reranked by exact distances."""
    g = stored(spark, sf)
    model, q = ann.train_ivf_pq(g, 64, 64, 8), first_vector(g).first()["q"]
    found = ann.search(ann.encode(g, model), model, q, 400)
    return ann.reranked(found, g, q, 100).select("id", r6("distance").alias("distance"))


# lookups, joins, unions ----------------------------------------------------------------------------------------------
def _label_ids(spark, sf) -> DataFrame:
    return table(spark, sf, "labeled").select(F.col("id").try_cast("bigint").alias("id")).where("id is not null").distinct()


@query
def id_lookup(spark, sf):
    return table(spark, sf, "geo_embeddings").select("id", "tile_id", "scene_id").join(_label_ids(spark, sf), "id", "left_semi")


@query
def metadata_join(spark, sf):
    d = table(spark, sf, "detections").select("detection_id", "id", "probability")
    return d.join(table(spark, sf, "geo_embeddings").select("id", "tile_id", "model_name"), "id")


@query
def label_embedding_join(spark, sf):
    l = table(spark, sf, "labeled").select("feature_id", F.col("id").try_cast("bigint").alias("id"), "label")
    g = table(spark, sf, "geo_embeddings").select("id", F.size("embedding").alias("dim"))
    return l.join(g, "id", "left").select("feature_id", "id", "label", "dim")


@query
def missing_embeddings(spark, sf):
    g = table(spark, sf, "geo_embeddings").where("embedding is not null").select("id")
    return _label_ids(spark, sf).join(g, "id", "left_anti")


@query
def exclude_ids(spark, sf):
    l = table(spark, sf, "labeled").select(names.tile_key(F.col("tile_id")).alias("t")).where("t is not null")
    g = table(spark, sf, "geo_embeddings").select("id", names.tile_key(F.col("tile_id")).alias("t"))
    return g.join(l, "t", "left_anti").select("id", "t")


@query
def external_id(spark, sf):
    g = table(spark, sf, "geo_embeddings").select("id", "tile_id")
    return g.select("id", catalog.display_id(g).alias("display"))


@query
def tile_keys(spark, sf):
    """Canonical tiles stored more than once."""
    g = table(spark, sf, "geo_embeddings").select("id", names.tile_key(F.col("tile_id")).alias("tile")).where("tile is not null")
    return g.groupBy("tile").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query
def mgrs_parts(spark, sf):
    m = names.mgrs_parts(names.tile_key(F.col("tile_id")))
    g = table(spark, sf, "geo_embeddings").select(m.alias("m")).where("m is not null")
    north = F.col("m.band") >= "N"
    g = g.groupBy("m.zone", "m.band", "m.square", (F.when(north, 32600).otherwise(32700) + F.col("m.zone")).alias("epsg"))
    return g.agg(F.count("*").alias("n"))


@query
def class_counts(spark, sf):
    return table(spark, sf, "labeled").groupBy(names.class_key(F.col("class")).alias("class")).agg(F.count("*").alias("n"))


@query
def label_counts(spark, sf):
    l = table(spark, sf, "labeled").withColumn("source", F.coalesce("source", F.lit("manual")))
    return labels.label_counts(l, "source")


@query
def correction_weights(spark, sf):
    l = table(spark, sf, "labeled").where("label in (0, 1)").withColumn("w", labels.correction_weight(names.class_key(F.col("class")), 3.0))
    return l.groupBy("dataset_id").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))


@query
def union_datasets(spark, sf):
    l = table(spark, sf, "labeled").select("id", "label", F.coalesce("class", F.lit("unknown")).alias("class"))
    d = table(spark, sf, "detections").select(F.col("id").cast("string").alias("id"), F.coalesce("class", F.lit("unknown")).alias("class"))
    u = l.unionByName(d, allowMissingColumns=True)
    return u.groupBy("class").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.countDistinct("id").alias("ids"))


@query
def augmented_labels(spark, sf):
    """Manual labels and reviews of detections (probability of a half and more is a confirmation), counted four ways."""
    m = table(spark, sf, "labeled").where("label in (0, 1)").select(F.lit(None).cast("string").alias("tile_id"), "label")
    r = table(spark, sf, "detections").where("probability between 0 and 1").select("tile_id", F.when(F.col("probability") >= 0.5, 1).otherwise(0).alias("label"))
    return labels.label_counts(labels.augmented(m, r), "source", "class")


@query
def surrogate_key(spark, sf):
    g = table(spark, sf, "geo_embeddings").withColumnRenamed("id", "source_id")
    return catalog.surrogate_key(g, "source_id", name="row_no").select("source_id", "scene_id", "geometry", "row_no")


@query
def distinct_scenes(spark, sf):
    return table(spark, sf, "geo_embeddings").select(F.coalesce("scene_id", F.lit("")).alias("scene_id"), F.coalesce("model_name", F.lit("")).alias("model_name")).distinct()


# geodesy and tiles ---------------------------------------------------------------------------------------------------
@query
def utm_project(spark, sf):
    e, n = G.utm_forward(F.col("lon"), F.col("lat"), G.utm_zone(F.col("lon")), F.col("lat") < 0)
    return geo(spark, sf).select("id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query
def utm_zone_epsg(spark, sf):
    return geo(spark, sf).select("id", G.utm_zone(F.col("lon")).alias("zone"), G.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query
def nearest_point(spark, sf):
    return spatial.nearest_point(geo(spark, sf), -86.4333, 33.0871).select("id", "tile_id", r6("distance_deg").alias("distance_deg"))


def _probes(spark, sf, shift: float) -> DataFrame:
    return geo(spark, sf).where("label = 3").select(F.col("id").alias("pid"), (F.col("lon") + shift).alias("lon"), (F.col("lat") + shift / 2).alias("lat"))


def _targets(spark, sf) -> DataFrame:
    return geo(spark, sf).where("label <> 3")


@query
def nearest_tile_join(spark, sf):
    return spatial.nearest_tile_join(_probes(spark, sf, 0.0031), _targets(spark, sf), None).select("pid", "tile_id", F.round("distance_m", 3).alias("distance_m"))


@query
def nearest_tile_buffered(spark, sf):
    return spatial.nearest_tile_join(_probes(spark, sf, 0.0061), _targets(spark, sf), 0.005, None).select("pid", "tile_id", F.round("distance_m", 3).alias("distance_m"))


@query
def nearest_retry(spark, sf):
    return spatial.nearest_tile_join(_probes(spark, sf, 0.0061), _targets(spark, sf)).select("pid", "tile_id", F.round("distance_m", 3).alias("distance_m"))


@query
def match_stats(spark, sf):
    m = spatial.nearest_tile_join(_probes(spark, sf, 0.0061), _targets(spark, sf))
    return m.agg(F.count("*").alias("n"), F.round(F.avg("distance_m"), 3).alias("mean_m"), F.round(F.max("distance_m"), 3).alias("max_m"), F.count_if(F.col("distance_m") > 500).alias("far"))


LASSO = [(-86.497, 33.003), (-86.402, 33.011), (-86.317, 33.113), (-86.431, 33.187), (-86.483, 33.091)]


@query
def points_in_polygon(spark, sf):
    return geo(spark, sf).where(G.in_polygon(F.col("lon"), F.col("lat"), LASSO)).select("id", "tile_id")


@query
def points_in_ring(spark, sf):
    """The same lasso as a column of rings."""
    return geo(spark, sf).where(G.point_in_ring(F.col("lon"), F.col("lat"), G.ring_literal(LASSO))).select("id", "tile_id")


@query
def roi_tile_counts(spark, sf):
    """Stored tiles by region of interest, however their locations are written."""
    g = G.with_location(table(spark, sf, "geo_embeddings").select("id", "geometry"))
    return locate(g, table(spark, sf, "roi_areas")).groupBy("region_id").agg(F.count("*").alias("tiles"))


@query
def box_tile_intersect(spark, sf):
    g = geo(spark, sf).select("id", (F.col("lon") - 0.002).alias("x0"), (F.col("lon") + 0.002).alias("x1"), (F.col("lat") - 0.002).alias("y0"), (F.col("lat") + 0.002).alias("y1"))
    return g.where("x0 <= -86.4 and x1 >= -86.45 and y0 <= 33.1 and y1 >= 33.05").select("id")


@query
def filter_near_positives(spark, sf):
    g = geo(spark, sf)
    return spatial.far_from(g.where("label <> 0"), g.where("label = 0"), 1500.0).select("id", "tile_id")


@query
def tile_polygon_corners(spark, sf):
    g = spatial.tile_squares(geo(spark, sf).select("id", "lon", "lat"), 160.0)
    g = g.select("id", F.posexplode("square").alias("corner", "p"))
    return g.select("id", F.col("corner").alias("corner"), F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


@query
def detection_boxes(spark, sf):
    """Bounding box and centroid of every detection square."""
    p = F.regexp_extract_all(F.col("geometry"), F.lit(r"(-?[\d.]+) (-?[\d.]+)"), F.lit(0))
    c = lambda i: F.transform(p, lambda s: F.split(s, " ")[i].cast("double"))
    d = table(spark, sf, "detections").select("detection_id", c(0).alias("x"), c(1).alias("y"))
    mid = lambda k: F.aggregate(F.slice(k, 1, 4), F.lit(0.0), lambda a, v: a + v) / 4
    return d.select("detection_id", F.array_min("x").alias("west"), F.array_max("x").alias("east"), F.array_min("y").alias("south"), F.array_max("y").alias("north"), r6(mid("x")).alias("cx"), r6(mid("y")).alias("cy"))


@query
def detection_threshold(spark, sf):
    d = table(spark, sf, "detections")
    p = F.coalesce("probability", F.lit(0.0))
    return d.where(p.between(0.5, 1)).groupBy(F.coalesce("class", F.lit("unknown")).alias("class")).agg(F.count("*").alias("n"), F.min("probability").alias("low"), F.max("probability").alias("high"))


@query
def detection_tiles(spark, sf):
    """Detections at or above the threshold with their stored tile, which tile ids in another letter case must not hide."""
    d = table(spark, sf, "detections").where("probability between 0.5 and 1").select("detection_id", names.tile_key(F.col("tile_id")).alias("tile"), "probability")
    g = table(spark, sf, "geo_embeddings").select(names.tile_key(F.col("tile_id")).alias("tile"), "id")
    return d.join(g.where("tile is not null").groupBy("tile").agg(F.min("id").alias("first_id"), F.count("*").alias("stored")), "tile")


@query
def dissolve_components(spark, sf):
    """Polygons that a union of the detection squares gives, by squares per polygon."""
    b = cut(detection_boxes(spark, sf).select(F.col("detection_id").alias("id"), F.col("west").alias("x0"), F.col("south").alias("y0"), F.col("east").alias("x1"), F.col("north").alias("y1")))
    c = tiles.union_components(b, 0.01)
    return c.groupBy("component").agg(F.count("*").alias("squares"))


@query
def chip_grid(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("16SB"), F.substring("n_name", 1, 1)).alias("mgrs_id"), F.col("n_nationkey").cast("double").alias("k"))
    s = n.groupBy("mgrs_id").agg((F.min("k") * 1000 + 500000).alias("x0"), (F.min("k") * 2000 + 3600000).alias("y0"))
    s = s.select("mgrs_id", "x0", "y0", (F.col("x0") + 3250).alias("x1"), (F.col("y0") + 2410).alias("y1"))
    return tiles.chip_grid(s).select("tile_id", "cx", "cy")


@query
def image_windows(spark, sf):
    i = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 20 + 100).cast("int").alias("h"), (F.col("p_size") * 10 + 300).cast("int").alias("w"))
    return tiles.image_windows(i, 224, 0.25).groupBy("image").agg(F.count("*").alias("n"), F.sum("height").alias("heights"), F.sum("width").alias("widths"))


@query
def slippy_tile(spark, sf):
    x, y = G.slippy_index(F.col("lon"), F.col("lat"), 14)
    return geo(spark, sf).select("id", F.floor(x).cast("bigint").alias("x"), F.floor(y).cast("bigint").alias("y"), F.round(x, 4).alias("fx"), F.round(y, 4).alias("fy"))


@query
def tile_center(spark, sf):
    x, y = G.slippy_index(F.col("lon"), F.col("lat"), 14)
    g = geo(spark, sf).select("id", F.floor(x).alias("x"), F.floor(y).alias("y"))
    lon, lat = G.slippy_center(F.col("x"), F.col("y"), 14)
    return g.select("id", F.concat_ws("_", F.lit("14"), "x", "y").alias("tile"), r6(lon).alias("lon"), r6(lat).alias("lat"))


@query
def zoom_for_coverage(spark, sf):
    return geo(spark, sf).select("id", G.zoom_for_coverage(F.col("lat"), F.lit(40.0) * (F.col("id") % 97)).alias("zoom"))


@query
def metres_per_pixel(spark, sf):
    return geo(spark, sf).select("id", r6(G.metres_per_pixel(F.col("lat"), F.col("id") % 20)).alias("mpp"))


@query
def neighbour_tiles(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("x"), (F.col("n_nationkey") % 8).cast("int").alias("y"), F.lit(5).alias("zoom"))
    return tiles.neighbour_tiles(t).select("x", "y", F.col("nx").cast("bigint").alias("nx"), F.col("ny").cast("bigint").alias("ny"))


@query
def geo_to_pixel(spark, sf):
    c, r = tiles.geo_to_pixel(F.col("lon"), F.col("lat"), -86.6, 32.9, -86.2, 34.1, 800, 600)
    return geo(spark, sf).select("id", F.round(c, 4).alias("col"), F.round(r, 4).alias("row"))


# learning data -------------------------------------------------------------------------------------------------------
def _classed(spark, sf) -> DataFrame:
    return geo(spark, sf).select("id", "tile_id", "lon", "lat", "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("class"), F.when(F.col("label") < 3, 1).otherwise(0).alias("label"))


@query
def stratified_split(spark, sf):
    return learning.stratified_split(_classed(spark, sf)).select("id", "class", "part")


@query
def spatial_clusters(spark, sf):
    return spatial.clusters_of(geo(spark, sf).where("label = 0"), 500.0)


@query
def spatial_folds(spark, sf):
    return spatial.spatial_folds(examples(spark, sf)).select("id", "label", F.col("fold").cast("int").alias("fold"))


@query
def fold_counts(spark, sf):
    return learning.valid_folds(spatial.spatial_folds(examples(spark, sf))).select(F.col("fold").cast("int").alias("fold"), "test_pos", "test_neg")


@query
def random_negatives(spark, sf):
    g = geo(spark, sf)
    return learning.random_negatives(g, g.where("label = 0"), 40, buffer_m=1200.0).select("id", "tile_id", "label", "class")


@query
def lulc_stratified(spark, sf):
    g = geo(spark, sf).withColumn("land", F.col("label").cast("int"))
    s = learning.stratified_sample(g, {2: 5, 4: 5, 5: 2, 6: 2, 9: 3})
    name = learning.remap(F.col("land"), {2: "trees", 4: "flooded_vegetation", 5: "crops", 6: "shrub", 9: "snow"})
    return s.select("id", "land", name.alias("name"))


def _scored(spark, sf) -> DataFrame:
    g = geo(spark, sf).select("id", (F.col("label") < 5).cast("int").alias("label"), F.round(F.lit(0.5) + F.element_at("embedding", 1).cast("double"), 3).alias("probability"), (F.col("id") % 5).alias("fold"))
    return g


@query
def classifier_metrics(spark, sf):
    return learning.binary_metrics(_scored(spark, sf)).select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def roc_auc(spark, sf):
    return learning.roc_auc(_scored(spark, sf)).select(r6("auc").alias("auc"))


@query
def cv_mean_std(spark, sf):
    m = learning.binary_metrics(_scored(spark, sf), by=["fold"])
    return learning.mean_and_std(m, "accuracy", "f1").select(*[r6(c).alias(c) for c in ("accuracy_mean", "accuracy_std", "f1_mean", "f1_std")])


@query
def gbt_detections(spark, sf):
    """Train on labels 0 and 1, score every tile, keep what reaches the threshold."""
    model = learning.fit_boosted_trees(examples(spark, sf))
    return learning.score(model, geo(spark, sf), 0.5).select("id", "tile_id", r6("probability").alias("probability"))


# label log -----------------------------------------------------------------------------------------------------------
def _events(spark, sf) -> DataFrame:
    return labels.delivered_once(table(spark, sf, "label_events"))


@query
def label_fold(spark, sf):
    return labels.toggled(cut(_events(spark, sf)), ["session_id", "point_id"])


@query
def label_last_wins(spark, sf):
    return labels.last_label(_events(spark, sf), ["session_id", "point_id"])


@query
def epoch_reset(spark, sf):
    """The fold again, but an event of a point whose id is divisible by 50 stands for a mode switch of its session."""
    e = cut(_events(spark, sf).withColumn("reset", F.coalesce(F.col("point_id").try_cast("bigint") % 50 == 0, F.lit(False))))
    return labels.last_label(labels.since_reset(e, "session_id", F.col("reset")), ["session_id", "point_id"])


@query
def session_labels(spark, sf):
    return labels.label_counts(labels.last_label(_events(spark, sf), ["session_id", "point_id"]), "session_id")


# names, files --------------------------------------------------------------------------------------------------------
@query
def tile_spec_parse(spark, sf):
    m = catalog.manifest(table(spark, sf, "manifest")).withColumn("s", names.tile_spec(F.col("model_name")))
    return m.select("model_name", "s.size_px", "s.overlap_px", "s.resolution").distinct()


@query
def manifest_catalog(spark, sf):
    m = catalog.manifest(table(spark, sf, "manifest"))
    return m.select("display_name", catalog.protocol(F.col("model_path")).alias("protocol"), catalog.https_url(F.col("model_path")).alias("url"), F.lower(F.col("model_name")).rlike(r"_\d+$").alias("numbered"))


@query
def manifest_regions(spark, sf):
    """Regions of interest with the models that cover them, names matched in any spelling."""
    m = catalog.manifest(table(spark, sf, "manifest")).groupBy("region").agg(F.countDistinct("model_name").alias("models"))
    r = table(spark, sf, "roi_areas").select("region_id", names.region_key(F.col("region_name")).alias("region"))
    return r.join(m, "region").select("region_id", "region", "models")


@query
def format_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.human_size(F.col("n_chars") * F.col("n_chars") * 37).alias("size"))


@query
def sha_key(spark, sf):
    d = table(spark, sf, "manifest").select(F.trim("model_path").alias("p"), names.region_key(F.col("region_name")).alias("region"))
    return d.groupBy("region").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("key"))


@query
def geojson_export(spark, sf):
    g = geo(spark, sf).withColumn("class", F.concat(F.lit("c"), F.col("label").cast("string")))
    return geojson.point_features(g, "id", "tile_id", "label", "class")


@query
def geojson_roundtrip(spark, sf):
    g = geo(spark, sf).select(F.col("id").cast("string").alias("id"), "tile_id", F.col("label").cast("double").alias("label"), "lon", "lat")
    f = geojson.features(geojson.collection(geojson.point_features(g, "id", "tile_id", "label")))
    return f.select(F.col("id").cast("bigint").alias("id"), "tile_id", "label", "class", "geometry_type")


# pixels --------------------------------------------------------------------------------------------------------------
def _pixels(spark, sf) -> DataFrame:
    """The events as observations of a 40 x 25 image: time, value, and a cloud score."""
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 40).cast("int").alias("x"), (F.floor(F.col("user_id") / 40) % 25).cast("int").alias("y"), F.col("ts").alias("t"), F.col("value"), (F.col("event_id") % 100).cast("int").alias("qa"), "event_id")


@query
def median_composite(spark, sf):
    p = _pixels(spark, sf).withColumn("value", raster.masked(F.col("value"), F.col("qa") >= 60))
    return raster.median_composite(p.where("value is not null")).select("x", "y", r6("median").alias("median"))


@query
def latest_mosaic(spark, sf):
    m = _pixels(spark, sf).where("value is not null").groupBy("x", "y").agg(F.max(F.struct("t", "event_id", "value")).alias("m"))
    return m.select("x", "y", F.col("m.value").alias("value"))


@query
def normalized_difference(spark, sf):
    l = table(spark, sf, "lineitem")
    nd = raster.normalized_difference(F.col("l_extendedprice"), F.col("l_quantity") * 900)
    return l.groupBy("l_suppkey").agg(F.round(F.avg(nd), 6).alias("ndvi"), F.count("*").alias("n"))


@query
def rgb_to_hsv(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", *[((F.col("p_partkey") * m) % 10001 / 10000.0).alias(c) for c, m in (("r", 7), ("g", 131), ("b", 1009))])
    h, s, v = raster.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return p.select("p_partkey", r6(h).alias("h"), r6(s).alias("s"), r6(v).alias("v"))


@query
def morph_close(spark, sf):
    m = _pixels(spark, sf).groupBy("x", "y").agg(F.max((F.col("qa") > 92).cast("int")).alias("v"))
    return raster.closing(m).select("x", "y", "v")


from geoloom.plans.core_sql import ORACLE_SQL  # noqa: E402,F401
