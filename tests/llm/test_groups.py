import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import proportions, splits
from geoloom.operators import prefix

ROWS = "id bigint, tile_id string, geometry string, c string, u bigint"


def brute(rows):
    from tests.test_geo import ground

    p = {i: i for i, *_ in rows}

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for x, (i, t, g) in enumerate(rows):
        for j, s, h in rows[:x]:
            if (t and s and t.strip().upper() == s.strip().upper()) or (g and h and ground(g, h) <= 20):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return {i: find(i) for i in p}


def test_related_groups_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(220):
        t = rnd.choice([None, "", f"16SBH_{rnd.randrange(60)}_1", f" 16sbh_{rnd.randrange(60)}_1", "16SBH_7_7"]) if rnd.random() < 0.6 else f"16SBH_{1000 + i}_1"
        g = (10 + rnd.uniform(0, 0.02), 50 + rnd.uniform(0, 0.02)) if rnd.random() < 0.9 else None
        rows.append((i + 5, t, g))
    df = spark.createDataFrame([(i, t, f"POINT ({g[0]!r} {g[1]!r})" if g else "POINT EMPTY", "x", 1) for i, t, g in rows] + [(None, "16SBH_7_7", None, "x", 1)], ROWS)
    got = splits.related_groups(df)
    assert {r.id: r.group_id for r in got.collect()} == brute(rows)
    assert got.groupBy("group_id").agg(F.count("*").alias("n"), F.max("group_size").alias("m")).where("n <> m").count() == 0
    s = splits.grouped_splits(got, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert s.count() == 220 and s.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_split_shares_and_bad_shares(spark):
    g = spark.range(10_000).select("id", F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.floor(F.col("id") / 3)).cast("bigint").alias("group_id"))
    n = {r.split: r["count"] for r in splits.grouped_splits(g, {"train": 8, "test": 1, "other": 1}).groupBy("split").count().collect()}
    assert abs(n["train"] - 8000) < 10 and abs(n["test"] - 1000) < 10
    with pytest.raises(ValueError):
        splits.grouped_splits(g, {"train": -1, "test": 1})
    assert splits.grouped_splits(g.limit(0), {"train": 1}).count() == 0
    assert splits.related_groups(spark.createDataFrame([], ROWS)).count() == 0


def test_running_total(spark):
    rows = [(k, i, i % 7) for k in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, w int")
    got = prefix.running_total(df, ["k"], (F.col("i") / 10).cast("int"), [F.col("i")], "w", "before").collect()
    assert len(got) == 150 and all(r.before == sum(j % 7 for j in range(r.i)) for r in got)


T = dt.datetime(2024, 1, 1)
LABELED = "feature_id bigint, dataset_id string, id string, label int, class string, source string, labeled_at timestamp_ntz, received_at timestamp_ntz, available int"
MIX = "plan_id bigint, dataset_id string, sample_size bigint, class string, target_share double, min_rows bigint"


def labeled(spark, rows):
    return spark.createDataFrame([(i, d, p, l, c, s, T + dt.timedelta(hours=h), T, 0) for i, (d, p, l, c, s, h) in enumerate(rows)], LABELED)


def test_latest_row_counts(spark):
    rows = [("d", "1", 1, "A-b", "m", 0), ("d", "1", -100, "A-b", "m", 1), ("d", "2", 0, " a B ", "m", 0), ("d", "2", 0, " a B ", "m", 0), ("d", "3", None, "x", "m", 2), ("d", "4", 1, "", None, 0), ("d", "5", 1, None, "m", 0), (None, "6", 1, "x", "m", 0), ("d", None, 1, "x", "m", 0), ("e", "1", 1, "x", "m", 0)]
    got = sorted((r.dataset_id, r.id, r["class"]) for r in proportions.available_points(labeled(spark, rows)).collect())
    assert got == [("d", "2", "a_b"), ("d", "4", "unknown"), ("d", "5", "unknown"), ("e", "1", "x")]


def test_sample_meets_targets_minimums_and_margins(spark):
    rnd = random.Random(1)
    rows = [("d", str(i), rnd.randrange(2), "big" if i < 900 else "rare" if i < 906 else "mid", rnd.choice(["m", "m", "m", "r"]), 0) for i in range(1000)]
    mix = spark.createDataFrame([(1, "d", 100, "big", 0.6, 0), (1, "d", 100, "mid", 0.35, 0), (1, "d", 100, "rare", 0.05, 20), (2, "none", 10, "big", 1.0, 0), (3, "d", 10, "absent", 1.0, 2), (4, "d", 0, "big", 1.0, 0), (5, "d", 50, "big", 0.9, 0), (5, "d", 50, "mid", 0.1, 15), (6, "d", 4, "big", 0.5, 9), (6, "d", 4, "mid", 0.5, 0), (None, "d", 9, "big", 1.0, 0)], MIX)
    l = labeled(spark, rows)
    s = proportions.sample_plans(l, mix).collect()
    n = {}
    for r in s:
        n[(r.plan_id, r["class"])] = n.get((r.plan_id, r["class"]), 0) + 1
    assert n == {(1, "big"): 59, (1, "mid"): 35, (1, "rare"): 6, (5, "big"): 35, (5, "mid"): 15, (6, "big"): 9}
    assert len({(r.plan_id, r.id) for r in s}) == len(s)
    big = [r.source for r in s if r["class"] == "big" and r.plan_id == 1]
    assert 0.55 < big.count("m") / len(big) < 0.95  # the source margin keeps its share of three quarters
    report = proportions.sample_report(l, mix)
    assert {(r.plan_id, r["class"]): r.gap for r in report.where("unmet").collect()} == {(1, "rare"): 14, (2, "big"): 10, (3, "absent"): 10}
    assert {(r.plan_id, r["class"]): r.gap for r in report.where("gap > 0 and not unmet").collect()} == {(1, "big"): 1, (5, "big"): 10, (6, "mid"): 2}
    m = {(r.plan_id, r.margin, r.value): r for r in proportions.margin_report(l, mix).collect()}
    assert m[1, "class", "big"].sampled == 59 and m[1, "class", "big"].gap == 0 and m[1, "class", "big"].converged
    assert abs(m[1, "source", "m"].raked - m[1, "source", "m"].target) < 0.1 and m[1, "source", "m"].sampled + m[1, "source", "r"].sampled == 100
    assert proportions.sample_plans(l.limit(0), mix).count() == 0 and proportions.sample_plans(l, mix.limit(0)).count() == 0


def test_unmet_without_plan_id_as_in_the_sql(spark):
    l = labeled(spark, [("d", str(i), 1, "big" if i < 9 else "rare", "m", 0) for i in range(12)])
    mix = spark.createDataFrame([(None, "d", 9, "rare", 1.0, 0), (None, "d", 9, "big", 1.0, 0), (1, "d", 4, "rare", 1.0, 0), (None, "d", 3, "rare", 1.0, 0)], MIX)
    got = sorted((r.plan_id or 0, r["class"], r.sampled, r.gap, r.unmet) for r in proportions.sample_report(l, mix).collect())
    assert got == [(0, "big", 0, 0, False), (0, "rare", 0, 0, False), (0, "rare", 0, 6, True), (1, "rare", 3, 1, True)]


def test_bounds_change_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [("d", str(i), rnd.randrange(2), "big" if i < 2500 else "mid", rnd.choice("mr"), 0) for i in range(3000)]
    mix = spark.createDataFrame([(p, "d", 40 + p, c, s, 0) for p in range(3) for c, s in (("big", 0.7), ("mid", 0.3))], MIX)
    l = labeled(spark, rows)
    key = lambda: sorted((r.plan_id, r.id, r.drawn) for r in proportions.sample_plans(l, mix).collect())
    a = key()
    assert any(d == "repair" for *_, d in a) or len(a) == 123
    monkeypatch.setattr(proportions, "_bound", lambda n, weight, rows: float("inf"))
    assert key() == a
    monkeypatch.setattr(proportions, "_bound", lambda n, weight, rows: 1e-9)  # far too low: drawn again
    assert key() == a


@pytest.mark.parametrize("size, want", [(100, [59, 35, 6]), (10, [4, 0, 6]), (3, [0, 0, 6]), (0, [0, 0, 6])])
def test_allotment(size, want):
    got = proportions.allotted(np.array([900, 94, 6]), np.array([60, 35, 5]) if size == 100 else np.array([round(size * 0.6), 0, 0]), np.array([0, 0, 20]), size)
    assert got.tolist() == want


def test_raking_reports_contradictions():
    n = np.array([5.0, 5.0])
    w, _, ok = proportions.rake(n, [(np.array([0, 1]), np.array([5.0, 5.0])), (np.array([0, 0]), np.array([4.0]))])
    assert w.sum() == pytest.approx(4) and ok
    w, rounds, ok = proportions.rake(np.array([8.0, 1.0]), [(np.array([0, 1]), np.array([1.0, 1.0])), (np.array([0, 0]), np.array([6.0]))], rounds=50)
    assert not ok and rounds == 50 or w.sum() < 6.1
