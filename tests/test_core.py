import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import vec
from geoloom.operators import ann, labels, learning, raster, search, spatial, tiles
from geoloom.plans import core_queries
from geoloom.sources import catalog, geojson
from geoloom.streaming import label_stream
from tests.conftest import CHECKED, SMALL


def test_query_vector_without_negatives_doubles_the_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "id int, embedding array<float>, label int")
    assert search.as_row(search.query_vector(df)).first()["q"] == [2.0, 4.0, 6.0]
    none = search.as_row(search.query_vector(df.withColumn("label", F.lit(0))))
    assert none.count() == 0
    assert search.top_k(df, none, 3).count() == 0


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    assert [r.id for r in df.where(vec.usable(F.col("v"), 2)).collect()] == [0]


def fold(events):
    state = {}
    for seq, point, label in sorted(events):
        state[point] = None if label == -100 or state.get(point) == label else label
    return {(p, v) for p, v in state.items() if v is not None}


@pytest.mark.parametrize("seed", range(4))
def test_toggle_fold(spark, seed):
    rnd = random.Random(seed)
    ev = [(i, f"p{rnd.randrange(12)}", rnd.choice([0, 1, 1, 0, -100])) for i in range(150)]
    df = spark.createDataFrame(ev, "seq bigint, point_id string, label int")
    assert {tuple(r) for r in labels.toggled(df, ["point_id"]).collect()} == fold(ev)


def test_events_delivered_again_count_once(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [(1, "p", 1, t), (1, "p", 1, t), (2, "p", None, t), (3, "q", 0, t)]
    df = spark.createDataFrame(ev, "seq bigint, point_id string, label int, arrived_at timestamp_ntz")
    assert {tuple(r) for r in labels.toggled(labels.delivered_once(df), ["point_id"]).collect()} == {("p", 1), ("q", 0)}


def test_stream_agrees_with_the_batch_fold(spark, tmp_path):
    rnd = random.Random(9)
    t = dt.datetime(2024, 1, 1)
    ev = [(i, "s", f"p{rnd.randrange(5)}", rnd.choice([0, 1, -100]), t, t) for i in range(60)]
    for k in range(3):
        part = ev[20 * k : 20 * k + 20] + ev[20 * k : 20 * k + 2]
        spark.createDataFrame(part, label_stream.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = label_stream.toggled_stream(label_stream.read_events(spark, str(tmp_path / "in")))
    q = s.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("folded").groupBy("point_id").agg(F.max_by("label", "last_seq").alias("label")).where("label is not null")
    assert {tuple(r) for r in last.collect()} == fold([(s, p, l) for s, _, p, l, _, _ in ev])


def test_folds_keep_clusters_together(spark):
    pos = [(i, -86.5 + 0.0001 * i, 33.0, 1) for i in range(5)] + [(10 + i, -86.0, 33.0 + 0.1 * i, 1) for i in range(4)]
    neg = [(100 + i, -86.0 + 0.001, 33.0 + 0.1 * i, 0) for i in range(4)]
    f = {r.id: r.fold for r in spatial.spatial_folds(spark.createDataFrame(pos + neg, "id bigint, lon double, lat double, label int"), 3, 500.0).collect()}
    assert len({f[i] for i in range(5)}) == 1 and all(f[100 + i] == f[10 + i] for i in range(4))
    assert [f[0], f[10], f[11], f[12], f[13]] == [0, 1, 2, 1, 2]


def test_random_negatives(spark):
    t = spark.createDataFrame([(i, f"TILE{i:04d}", -86.5 + (i % 10) * 0.01, 33.0 + (i // 10) * 0.01) for i in range(50)], "id bigint, tile_id string, lon double, lat double")
    pos = t.where("id < 5")
    pick = lambda seed, **k: [r.tile_id for r in learning.random_negatives(t, pos, 10, seed, **k).collect()]
    assert pick(1) == pick(1) != pick(2) and len(pick(1)) == 10
    assert not {f"TILE{i:04d}" for i in range(5)} & set(pick(1, buffer_m=2000.0))
    assert "TILE0010" not in pick(1, buffer_m=2000.0)
    assert len(pick(1, buffer_m=1e7)) == 10  # nothing is far enough: ids only


def test_split_and_metrics(spark):
    rows = [(i, "a" if i < 15 else "b", 1) for i in range(30)] + [(100 + i, "n" if i < 4 else "m", 0) for i in range(24)]
    s = learning.stratified_split(spark.createDataFrame(rows, "id bigint, class string, label int"))
    n = {(r["class"], r.part): r["count"] for r in s.groupBy("class", "part").count().collect()}
    assert n[("a", "test")] == n[("b", "test")] == 3 and n[("n", "test")] == n[("m", "test")] == 1
    p = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "label int, probability double")
    assert learning.roc_auc(p).first()["auc"] == pytest.approx(0.875)
    assert learning.roc_auc(p.where("label = 1")).first()["auc"] is None
    assert learning.binary_metrics(p.where("label = 0")).first()["f1"] == 0


def test_missing_vectors_fail(spark):
    t = spark.createDataFrame([("x", [1.0])], "tile_id string, embedding array<float>")
    l = spark.createDataFrame([("x", 1), ("y", 0)], "tile_id string, label int")
    assert [r.tile_id for r in learning.missing_vectors(l, t).collect()] == ["y"]
    with pytest.raises(Exception, match="no embedding"):
        learning.labelled_vectors(l, t).collect()


def test_boosted_trees_separate_and_cross_validate(spark):
    r = np.random.default_rng(42)
    rows = [(i, f"t{i}", [float(x) for x in r.normal(2 if i < 30 else -2, 1, 8)], int(i < 30), i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, tile_id string, embedding array<float>, label int, fold int")
    model = learning.fit_boosted_trees(df, 3, 2)
    assert {x.id for x in learning.score(model, df, 0.5).collect()} == set(range(30))
    cv = learning.mean_and_std(learning.cross_validate(df, 2, 2), "f1").first()
    assert cv["f1_mean"] > 0.5
    with pytest.raises(ValueError, match="no valid folds"):
        learning.cross_validate(df.withColumn("fold", F.col("label")))


def test_registered_boosted_trees_are_the_operators_default(spark, monkeypatch):
    made, fit = [], learning.fit_boosted_trees
    monkeypatch.setattr(learning, "fit_boosted_trees", lambda *a, **kw: made.append(fit(*a, **kw)) or made[-1])
    assert core_queries.gbt_detections(spark, SMALL).count() > 0
    assert made[0].getNumTrees == 100 and made[0].getMaxDepth() == 6


def test_product_quantised_search_recall(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, embedding array<float>")
    m = ann.train_ivf_pq(df, 16, 8, 8, dim=16, sample=2000)
    lists = ann.encode(df, m, dim=16)
    got = {g.id for g in ann.search(lists, m, x[0], 20).collect()}
    true = set(np.argsort(((x - x[0]) ** 2).sum(axis=1))[:10].tolist())
    assert len(got & true) >= 9
    assert ann.search(lists, m, x[0], 20, nprobe=4).count() == 20
    assert ann.training_size(5_000_000) == 2_000_000 and ann.training_size(100) == 100


def test_registered_index_search_recall(spark):
    g = {r.id: np.array(r.embedding, float) for r in core_queries.stored(spark, CHECKED).select("id", "embedding").collect()}
    q = g[min(g)]
    true = sorted(g, key=lambda i: (((g[i] - q) ** 2).sum(), i))[:100]
    got = core_queries.ivf_pq_search(spark, CHECKED).collect()
    assert len(got) == 100 and len({r.id for r in got} & set(true)) >= 95
    assert all(abs(r.distance - ((g[r.id] - q) ** 2).sum()) < 1e-4 for r in got)


def test_union_of_touching_squares(spark):
    b = [(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 0.5, 2.0, 1.5), (3, 5.0, 5.0, 6.0, 6.0)]
    got = tiles.union_components(spark.createDataFrame(b, "id bigint, x0 double, y0 double, x1 double, y1 double"), 0.7)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_tile_square_is_320_m_wide(spark):
    from tests.test_geo import ground

    r = spatial.tile_squares(spark.createDataFrame([(-86.5, 33.0), (None, None)], "lon double, lat double"), 160.0).orderBy("lon").collect()
    assert r[0].square is None
    c = [(p.x, p.y) for p in r[1].square]
    assert all(abs(ground(p, q) - 320) < 0.4 for p, q in zip(c, c[1:] + c[:1]))


def test_closing_fills_a_hole(spark):
    m = [(x, y, int((x, y) != (3, 3) and 2 <= x <= 4 and 2 <= y <= 4)) for x in range(7) for y in range(7)]
    got = {(r.x, r.y): r.v for r in raster.closing(spark.createDataFrame(m, "x int, y int, v int")).collect()}
    assert got[(3, 3)] == 1 and got[(1, 1)] == got[(0, 0)] == 0 and sum(got.values()) == 9 and len(got) == 49


def test_geojson_kinds_and_broken_documents(spark):
    docs = [('{"features":[{"properties":{"label":1,"embedding":[1]}}]}', "labeled"), ('{"features":[{"properties":{"probability":0.4}}]}', "detections"), ('{"features":[{"properties":{"label":1}}]}', "vector_layer"), ('{"features":[]}', "vector_layer"), ("not json", "vector_layer"), (None, "vector_layer")]
    df = spark.createDataFrame([(d,) for d, _ in docs], "value string")
    assert [r[0] for r in df.select(geojson.kind(F.col("value"))).collect()] == [k for _, k in docs]
    assert geojson.features(df).count() == 3


def test_ingest_errors_and_names(spark):
    df = spark.createDataFrame([(None,)], "embedding array<float>")
    with pytest.raises(catalog.IngestError):
        catalog.embedding_dim(df)
    assert catalog.embedding_dim(df, default=384) == 384
    with pytest.raises(catalog.IngestError):
        catalog.embedding_dim(spark.createDataFrame([(1.0,)], "embedding float"))
    with pytest.raises(catalog.IngestError):
        catalog.read_by_name(spark)
    with pytest.raises(ValueError):
        catalog.ingest(df, "HALF")
    assert catalog.external_id(df.withColumn("tile_id", F.lit("a"))) == "tile_id"


def test_files_union_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(2, 3)], "id int, y int").write.parquet(str(tmp_path / "two"))
    got = {(r.id, r.x, r.y) for r in catalog.read_by_name(spark, str(tmp_path)).collect()}
    assert got == {(1, "a", None), (2, None, 3)}
