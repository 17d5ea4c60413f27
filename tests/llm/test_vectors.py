import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import clusters, neighbours, subset
from geoloom.llm.vectors import hadamard, packed, pseudo_rotation, unpacked

SCHEMA = "id bigint, embedding array<float>, task string, v int"


def frame(spark, x, ids=None, extra=()):
    rows = [(int(i), [float(v) for v in r], "t", 0) for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows + list(extra), SCHEMA).repartition(3)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


NAN, INF = float("nan"), float("inf")
BAD = [(9001, None, "t", 0), (9002, [], "t", 0), (9003, [1.0], "t", 0), (9004, [0.0] * 16, "t", 0), (9005, [NAN] * 16, "t", 0), (9006, [INF] + [1.0] * 15, "t", 0), (9007, [None] + [1.0] * 15, "t", 0), (None, [1.0] * 16, "t", 0)]


def clumps(seed, sizes, dim=16, noise=0.08, loose=60):
    r = np.random.default_rng(seed)
    out = [unit(r.normal(size=(1, dim)))[0] + r.normal(size=(n, dim)) * noise for n in sizes]
    return unit(np.concatenate([*out, r.normal(size=(loose, dim))]))


def test_rotation_keeps_lengths_and_packing_is_exact():
    x = np.random.default_rng(0).normal(size=(50, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    assert np.allclose(pseudo_rotation(x, 3) @ pseudo_rotation(x, 3).T, x @ x.T, atol=1e-3)
    assert (unpacked(packed(x), 64) == x).all() and (unpacked(packed(x).slice(7, 9), 64) == x[7:16]).all()


def exact_neighbours(x, k, floor):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: {int(j) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= floor} for i in range(len(x))}


@pytest.mark.parametrize("kw", [{}, {"tile": 60}, {"target_bucket": 1, "margin": 0.3}])
def test_close_neighbours_recall(spark, kw):
    x = clumps(1, [120, 40, 20, 5, 2, 2])
    want = exact_neighbours(x, 5, 0.9)
    got = neighbours.similar_vectors(frame(spark, x, extra=BAD), 5, 0.9, dim=16, **({"margin": 0.15} | kw)).collect()
    pairs = {(r.id, r.neighbour_id) for r in got}
    true = {(i, j) for i, js in want.items() for j in js}
    assert len(pairs) == len(got) and len(pairs & true) >= 0.97 * len(true)
    assert all(r.similarity >= 0.9 and r.id != r.neighbour_id and 1 <= r["rank"] <= 5 and r.id < 9000 for r in got)


@pytest.mark.parametrize("kw", [{"target_bucket": 1}, {"brute": 0}, {"target_bucket": 1, "brute": 0}])
def test_switches_by_size_keep_the_recall(spark, kw):
    r = np.random.default_rng(9)
    p, q = unit(r.normal(size=(4000, 64))), r.normal(size=(4000, 64))
    q = unit(q - (q * p).sum(axis=1, keepdims=True) * p)
    x = np.concatenate((p, 0.956 * p + np.sqrt(1 - 0.956**2) * q))  # pairs that are barely similar enough
    got = {(r.id, r.neighbour_id) for r in neighbours.similar_vectors(frame(spark, x), 5, 0.95, **kw).collect()}
    assert len(got & {(i, i + 4000) for i in range(4000)}) >= 0.99 * 4000


def test_neighbours_do_not_depend_on_the_number_of_rows(spark):
    r = np.random.default_rng(12)
    axis = pseudo_rotation(np.eye(64, dtype=np.float32), 11)[:, 5]
    p, q = unit(r.normal(size=(1200, 64))), r.normal(size=(1200, 64))
    p = unit(0.6 * axis + 0.8 * p)  # all in one bucket
    q = unit(q - (q * p).sum(axis=1, keepdims=True) * p)
    q = 0.951 * p + np.sqrt(1 - 0.951**2) * q
    find = lambda i: {(r.id, r.neighbour_id) for r in neighbours.similar_vectors(frame(spark, np.concatenate((p[i], q[i])), np.concatenate((i, i + 1200))), 5, 0.95, margin=0.02).collect()}
    whole = find(np.arange(1200))
    assert whole == set().union(*(find(np.arange(a, a + 600)) for a in (0, 600))) and len(whole) == 2400


@pytest.mark.parametrize("floor, both", [(0.9, True), (-1.5, False)])
def test_dropping_beaten_candidates_changes_nothing(monkeypatch, floor, both):
    x = clumps(4, [1500, 300, 20], noise=0.06).astype(np.float32)
    x[100:160] = x[99]  # copies: ties go to the smaller id
    ids, asks = np.arange(len(x)) * 3, np.ones(len(x), bool) if both else np.arange(len(x)) % 10 == 0
    home = np.arange(len(x)) % 7 > 0 if both else np.ones(len(x), bool)
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -2)
    want = {i: {int(j) for j in np.argsort(-np.round(s[i], 6) - 10 * home, kind="stable")[:5] if home[j] and s[i, j] >= floor} for i in np.flatnonzero(asks)}
    monkeypatch.setattr(neighbours, "_HELD", 200)
    i, j, sims = neighbours._bucket_search(x, ids, home, asks, 5, floor, False)
    got = {(a // 3, b // 3) for a, b in zip(i.tolist(), j.tolist())}
    true = {(a, b) for a, bs in want.items() for b in bs}
    assert len(got) == len(true) and all(abs(np.sort([s[a, b] for b in bs])[0] - np.sort([s[a, b] for c, b in got if c == a])[0]) < 1e-6 for a, bs in want.items() if bs)
    if home[:104].all():
        assert {b for a, b in got if a == 130} == set(range(99, 104))
    if both:  # a pair is found from either side
        one = neighbours._bucket_search(x, ids, home, asks, 5, floor, True)
        monkeypatch.setattr(neighbours, "_HELD", 1 << 30)
        two = neighbours._bucket_search(x, ids, home, asks, 5, floor, True)
        assert all((a == b).all() for a, b in zip(one[:2], two[:2]))


def test_queries_only_recall(spark):
    x = clumps(2, [50, 20], loose=400)
    got = {(r.id, r.neighbour_id) for r in neighbours.similar_vectors(frame(spark, x), 10, queries=F.col("id") % 10 == 0, dim=16, tables=2, margin=None, ranks=16).collect()}
    true = {(i, j) for i, js in exact_neighbours(x, 10, -2).items() for j in js if i % 10 == 0}
    assert len(got & true) >= 0.9 * len(true) and {i % 10 for i, _ in got} == {0}


def test_queries_find_the_same_at_any_size(spark):
    x = clumps(2, [50, 20], loose=400)
    one, many = ({(r.id, r.neighbour_id) for r in neighbours.similar_vectors(frame(spark, x), 10, queries=F.col("id") % 10 == 0, dim=16, tables=2, margin=None, ranks=10, **kw).collect()} for kw in ({}, {"target_bucket": 1}))
    assert one == many


def test_copies_and_scaled_copies_are_neighbours(spark):
    x = np.repeat(np.eye(16)[:1], 9, axis=0) * np.array([1, 2, 3, 250, 1e-6, 1, 1, 1, 1])[:, None]
    got = neighbours.similar_vectors(frame(spark, x), 3, 0.95, dim=16).collect()
    assert len(got) == 27 and all(r.similarity == pytest.approx(1) for r in got)
    assert {r.neighbour_id for r in got if r.id == 8} == {0, 1, 2}  # ties by id


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.similar_vectors(empty, 3, 0.9, dim=16).count() == 0
    assert clusters.linked_groups(empty, dim=16).count() == 0
    assert clusters.described_clusters(empty, dim=16).count() == 0
    assert subset.varied_subset(empty, 5, dim=16).count() == 0
    bad = spark.createDataFrame(BAD, SCHEMA)
    assert clusters.linked_groups(bad, dim=16, min_size=1).count() == 0
    assert subset.varied_subset(bad, 5, dim=16).count() == 0


def linkage(x, t):
    p = list(range(len(x)))

    def find(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for i, j in zip(*np.nonzero(x @ x.T >= t)):
        a, b = find(int(i)), find(int(j))
        p[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(x))])


def chain(n, dim=16, step=0.5):
    a = np.arange(n) * step
    x = np.zeros((n, dim))
    x[:, 0], x[:, 1] = np.cos(a), np.sin(a)
    return x


@pytest.mark.parametrize("kw", [{}, {"rows_per_cluster": 40}, {"rows_per_cluster": 100, "block": 50}])
def test_groups_equal_single_linkage(spark, kw):
    x = np.concatenate((clumps(3, [150, 60, 30, 9, 8, 7, 3]), chain(12), chain(12)[:3]))  # a chain, and repeated vectors
    roots = linkage(x, 0.85)
    size = np.bincount(roots, minlength=len(x))
    want = {(i, int(roots[i])) for i in range(len(x)) if size[roots[i]] >= 8}
    got = {(r.id, r.group_id) for r in clusters.linked_groups(frame(spark, x, extra=BAD), dim=16, margin=0.2, **kw).collect()}
    assert got == want


@pytest.mark.parametrize("noise", [0, 0.01])
@pytest.mark.parametrize("more", [0, 30])
def test_group_of_one_heavy_leaf_beyond_a_block(spark, noise, more):
    r = np.random.default_rng(8)
    x = np.repeat(np.eye(16)[:1], 201, axis=0) + r.normal(size=(201, 16)) * noise
    y = np.repeat(-np.eye(16)[1:2], more, axis=0)
    got = clusters.linked_groups(frame(spark, np.concatenate((x, y))), dim=16, block=50).collect()
    assert sorted((r.id, r.group_id, r.group_size) for r in got) == [(i, 0, 201) for i in range(201)] + [(201 + i, 201, more) for i in range(more)]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.5, 0.95), st.booleans())
def test_linkage_in_memory_is_exact(seed, t, hubs):
    x = clumps(seed, [25, 10, 5], dim=8, noise=0.15, loose=20).astype(np.float32)
    hub = np.full(len(x), -1)
    want = linkage(x, np.float32(t))
    if hubs:
        hub[want == want[0]] = 0
    got = clusters._link(x, hub, np.float32(t))
    assert (np.unique(got, return_inverse=True)[1] == np.unique(want, return_inverse=True)[1]).all()


def test_feature_trees_keep_sums_when_merged_and_condensed():
    x = clumps(4, [200, 100], loose=300)
    trees = [clusters.FeatureTree(16, 40) for _ in range(2)]
    for t, part in zip(trees, (x[:250], x[250:])):
        t.add(part, np.ones(len(part)))
    trees[0].add(trees[1].s, trees[1].n)
    assert len(trees[0].n) <= 40
    assert trees[0].n.sum() == len(x) and np.allclose(trees[0].s.sum(axis=0), x.sum(axis=0))


def test_ward_joins_what_is_near():
    x = np.array([[0.0, 0], [0.1, 0], [5, 5], [5.1, 5], [9, 0]])
    lab = clusters.ward(np.array([1.0, 2, 3, 1, 1]), x * np.array([1.0, 2, 3, 1, 1])[:, None], 3)
    assert lab[0] == lab[1] and lab[2] == lab[3] and len(set(lab)) == 3


def test_described_clusters(spark):
    x = clumps(5, [100, 50], loose=0)
    rows = clusters.described_clusters(frame(spark, x, extra=BAD), clusters=2, dim=16, typical=3).collect()
    assert len(rows) == 150 and {r.group_size for r in rows} == {100, 50} and {r.group_id for r in rows} == {0, 100}
    assert sorted(r.typical_rank for r in rows if r.typical_rank) == [1, 1, 2, 2, 3, 3]


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4), st.integers(1, 60)), min_size=1, max_size=20), st.integers(0, 300))
@settings(max_examples=60, deadline=None)
def test_quotas_fit_supply_and_size(cells, size):
    counts = {}
    for a, b, n in cells:
        counts[(a, b)] = counts.get((a, b), 0) + n
    q = subset.quotas(counts, size)
    assert sum(q.values()) == min(size, sum(counts.values())) and all(0 < n <= counts[k] for k, n in q.items())


def test_quotas_are_balanced():
    q = subset.quotas({(0, 0): 10_000, (1, 1): 100, (2, 2): 100, (3, 3): 5}, 100)
    assert q[(3, 3)] == 5 and max(q.values()) <= 36 and min(q[(i, i)] for i in range(3)) >= 25


def cost(flow, supply, size):
    """The convex cost of a flow, unit by unit."""
    def of(n, target, weight):
        at, total = max(1, round(target)), 0.0
        for share, price in (*subset.STRETCHES, (1e9, subset.BEYOND)):
            step = max(1, round(target * share))
            total += weight * price * min(max(0, n - at), step)
            at += step
        return total
    cells = size / max(1, np.count_nonzero(supply))
    return sum(of(n, size / len(flow), 1) for n in flow.sum(axis=1)) + sum(of(n, size / flow.shape[1], 1) for n in flow.sum(axis=0)) + sum(of(n, cells, 0.5) for n in flow.ravel())


@given(st.integers(0, 10_000), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_no_exchange_makes_the_flow_cheaper(seed, size):
    r = np.random.default_rng(seed)
    supply = r.integers(0, 12, (3, 4))
    supply[r.random((3, 4)) < 0.3] = 0
    supply = supply[supply.sum(axis=1) > 0][:, supply.sum(axis=0) > 0]
    if not supply.size:
        return
    size = min(size, int(supply.sum()))
    f = subset.balanced_flow(supply, size)
    assert f.sum() == size and (f >= 0).all() and (f <= supply).all()
    best = cost(f, supply, size)
    for a in np.argwhere(f > 0):
        for b in np.argwhere(f < supply):
            g = f.copy()
            g[tuple(a)] -= 1
            g[tuple(b)] += 1
            assert cost(g, supply, size) >= best - 1e-9


def test_large_group_does_not_crowd_out(spark):
    x = clumps(6, [900, 10, 10, 10, 10], noise=0.03, loose=60)
    got = subset.varied_subset(frame(spark, x, extra=BAD), 100, kinds=8, textures=4, dim=16).collect()
    ids = [r.id for r in got]
    assert len(ids) == len(set(ids)) == 100 and max(ids) < 9000
    assert sum(i < 900 for i in ids) < 60  # 90 % of the rows
    assert all(any(900 + 10 * g <= i < 910 + 10 * g for i in ids) for g in range(4))
    again = subset.varied_subset(frame(spark, x, extra=BAD), 100, kinds=8, textures=4, dim=16).collect()
    assert sorted(ids) == sorted(r.id for r in again)
    cover = subset.coverage(frame(spark, x, extra=BAD), 100, kinds=8, textures=4, dim=16).collect()
    assert sum(r.rows for r in cover) == len(x) and sum(r.quota for r in cover) == 100
    assert max(r.share_after for r in cover) < max(r.share_before for r in cover)
    assert subset.varied_subset(frame(spark, x[:7]), 100, dim=16).count() == 7
