"""Problem 3: similarity clusters by mergeable cluster-feature trees.

Every partition condenses its vectors into a cluster-feature tree of bounded size; the leaf summaries (count, linear
sum) are merged pairwise up a tree of tasks; Ward agglomeration joins the final leaves; one pass assigns all rows.
Groups of rows linked by a minimum similarity are then verified exactly inside the clusters (see linked_groups).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.vectors import UnionFind, packed, unit_rows, unpacked
from geoloom.operators.graph import connected_components
from geoloom.session import cut


def _unit(s: np.ndarray) -> np.ndarray:
    return (s / np.maximum(np.sqrt(np.einsum("ij,ij->i", s, s)), 1e-12)[:, None]).astype(np.float32)


class FeatureTree:
    """Cluster features of unit vectors: leaves (count, linear sum) under branches, at most `leaves` of them.

    A row is absorbed by the nearest leaf of the nearest branch if its cosine to the leaf's mean is at least the
    threshold, else it opens a leaf. When the leaves are too many, the threshold is lowered and leaves merge: sums and
    counts add up, so trees over different rows merge without looking at the rows again.
    """

    def __init__(self, dim: int, leaves: int, threshold: float = 0.95):
        self.limit, self.threshold = leaves, threshold
        self.n, self.s = np.zeros(0), np.zeros((0, dim))
        self._index()

    def _index(self) -> None:
        self.c = _unit(self.s)
        self.branch = np.zeros(len(self.n), np.int64)
        self.top = np.zeros((0, self.s.shape[1]), np.float32)
        if len(self.n) > 64:  # branches: the heaviest leaves attract the others
            heads = np.argsort(-self.n, kind="stable")[: int(math.sqrt(len(self.n)))]
            self.branch = (self.c @ self.c[heads].T).argmax(axis=1)
            sums = np.zeros((len(heads), self.s.shape[1]))
            np.add.at(sums, self.branch, self.s)
            self.top = _unit(sums)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaf, sim = np.zeros(len(x), np.int64), np.full(len(x), -2, np.float32)
        if not len(self.n):
            return leaf, sim
        groups = (x @ self.top.T).argmax(axis=1) if len(self.top) else np.zeros(len(x), np.int64)
        for g in np.unique(groups):
            rows, own = np.nonzero(groups == g)[0], np.nonzero(self.branch == g)[0] if len(self.top) else np.arange(len(self.n))
            if len(own):
                s = x[rows] @ self.c[own].T
                best = s.argmax(axis=1)
                leaf[rows], sim[rows] = own[best], s[np.arange(len(rows)), best]
        return leaf, sim

    def add(self, s: np.ndarray, n: np.ndarray) -> None:
        """Insert features: rows (n = 1) or the leaves of another tree."""
        for a in range(0, len(n), 2048):
            self._add(s[a : a + 2048], n[a : a + 2048])

    def _add(self, s: np.ndarray, n: np.ndarray) -> None:
        x = _unit(s)
        leaf, sim = self._nearest(x)
        old = sim >= self.threshold
        np.add.at(self.s, leaf[old], s[old])
        np.add.at(self.n, leaf[old], n[old])
        rest = np.nonzero(~old)[0]
        rest = rest[np.argsort(-n[rest], kind="stable")]
        new_s, new_n = [], []
        if len(rest):
            sims = x[rest] @ x[rest].T
            free = np.ones(len(rest), bool)
            for i in range(len(rest)):
                if free[i]:
                    m = np.nonzero(free & (sims[i] >= self.threshold))[0]
                    m = m if len(m) else np.array([i])
                    free[m] = False
                    free[i] = False
                    new_s.append(s[rest[m]].sum(axis=0))
                    new_n.append(n[rest[m]].sum())
            self.s = np.concatenate((self.s, np.array(new_s)))
            self.n = np.concatenate((self.n, np.array(new_n)))
        while len(self.n) > self.limit:
            self._condense()
        self._index()

    def _condense(self) -> None:
        c = _unit(self.s)
        sims = c @ c.T
        np.fill_diagonal(sims, -2)
        nearest = sims.max(axis=1)
        self.threshold = float(min(self.threshold, np.quantile(nearest, 0.5))) - 1e-6
        free, keep_s, keep_n = np.ones(len(c), bool), [], []
        for i in np.argsort(-self.n, kind="stable"):
            if free[i]:
                m = free & (sims[i] >= self.threshold)
                m[i] = True
                free &= ~m
                keep_s.append(self.s[m].sum(axis=0))
                keep_n.append(self.n[m].sum())
        self.s, self.n = np.array(keep_s), np.array(keep_n)


def leaf_summaries(df: DataFrame, dim: int, leaves: int, id_col: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """(counts, linear sums) of at most `leaves` leaves over all usable rows."""
    schema = "slot int, n double, s binary"

    def emit(tree: FeatureTree, slot: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(tree.n), slot, np.int32)), pa.array(tree.n.astype(float)), packed(tree.s)], names=["slot", "n", "s"])

    def build(batches):
        from pyspark import TaskContext

        tree = FeatureTree(dim, leaves)
        for b in batches:
            _, x = unit_rows(b.column(0), b.column(1), dim)
            if len(x):
                tree.add(x.astype(np.float64), np.ones(len(x)))
        if len(tree.n):
            yield emit(tree, TaskContext.get().partitionId())

    def merge(tbl: pa.Table) -> pa.Table:
        s, n = unpacked(tbl["s"], dim).astype(np.float64), tbl["n"].to_numpy()
        o = np.lexsort((*s.T[:4], -n))
        tree = FeatureTree(dim, leaves)
        tree.add(s[o], n[o])
        return pa.Table.from_batches([emit(tree, tbl["slot"][0].as_py())])

    f = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(build, schema)
    width = df.rdd.getNumPartitions()
    while width > 1:  # 8 trees into one, round by round, so that no task sees more than 8 x leaves
        width = -(-width // 8)
        f = f.withColumn("slot", (F.col("slot") / 8).cast("int")).groupBy("slot").applyInArrow(merge, schema)
    rows = f.select("n", "s").collect()  # at most `leaves` rows of dim floats
    if not rows:
        return np.zeros(0), np.zeros((0, dim))
    return np.array([r["n"] for r in rows]), np.stack([np.frombuffer(bytes(r["s"]), np.float32) for r in rows]).astype(np.float64)


def ward(n: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Cluster number of each leaf: Ward agglomeration (nearest-neighbour chain) of weighted leaf means down to k."""
    m = len(n)
    if m <= k:
        return np.arange(m)
    n, mean = n.astype(float).copy(), s / n[:, None]
    alive, merges, chain = np.ones(m, bool), [], []
    size = n.copy()
    for _ in range(m - 1):
        if not chain:
            chain = [int(np.nonzero(alive)[0][0])]
        while True:
            a = chain[-1]
            d = ((mean - mean[a]) ** 2).sum(axis=1) * size * size[a] / (size + size[a])
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        merges.append((float(d[b]), a, b))
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    uf = UnionFind(m)
    for _, a, b in sorted(merges, key=lambda t: t[0])[: m - k]:
        uf.union(a, b)
    return np.unique(uf.roots(), return_inverse=True)[1]


class Model:
    """Unit centroids of the clusters and of the leaves."""

    def __init__(self, n: np.ndarray, s: np.ndarray, k: int):
        label = ward(n, s, k)
        sums = np.zeros((label.max() + 1 if len(label) else 0, s.shape[1]))
        np.add.at(sums, label, s)
        self.clusters, self.leaves, self.weight = _unit(sums), _unit(s), n


def fit(df: DataFrame, clusters: int, dim: int = 64, leaves: int = 1024, id_col: str = "id", vector: str = "embedding") -> Model:
    """Cluster-feature trees, tree-reduced, then Ward down to `clusters`; reads every row once."""
    return Model(*leaf_summaries(df, dim, leaves, id_col, vector), clusters)


def assigned(df: DataFrame, model: Model, dim: int = 64, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, similarity): the nearest cluster of every usable row and the cosine to its centroid."""
    c = model.clusters

    def go(batches):
        for b in batches:
            ids, x = unit_rows(b.column(0), b.column(1), dim)
            if len(ids) and len(c):
                s = x @ c.T
                best = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best.astype(np.int32)), pa.array(s[np.arange(len(ids)), best].astype(float))], names=["id", "cluster", "similarity"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(go, "id bigint, cluster int, similarity double")


def described_clusters(df: DataFrame, clusters: int = 256, dim: int = 64, typical: int = 5, leaves: int = 1024, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, group_id, group_size, similarity, typical_rank) of every usable row.

    group_id is the smallest id of the cluster; typical_rank is 1.. for the `typical` rows nearest to its centroid (ties
    by id), else null. Unusable vectors and null ids take no part; an empty table gives no rows.
    """
    a = cut(assigned(df, fit(df, clusters, dim, leaves, id_col, vector), dim, id_col, vector))
    sizes = a.groupBy("cluster").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    w = Window.partitionBy("cluster").orderBy(F.col("similarity").desc(), "id")
    best = a.withColumn("typical_rank", F.row_number().over(w)).where(F.col("typical_rank") <= typical)
    best = best.select("cluster", "id", "typical_rank").groupBy("cluster", "id").agg(F.min("typical_rank").alias("typical_rank"))
    # both sides have a bounded number of rows: clusters, and clusters x typical
    j = a.join(F.broadcast(sizes), "cluster").join(F.broadcast(best), ["cluster", "id"], "left")
    return j.select("id", "group_id", "group_size", "similarity", "typical_rank")


def _link(x: np.ndarray, hub: np.ndarray, t: float, tight: float = 0.93) -> np.ndarray:
    """Exact single linkage at cosine >= t of the rows in memory: the component number of each row.

    Rows with the same hub (>= 0) are known to be linked. Leaders stand for the rows within `tight` of them; rows
    linked to a leader join its component; pairs that only other members can link are compared exactly, but only where
    the angles allow a link and the components still differ.
    """
    n, uf, tight = len(x), UnionFind(len(x)), max(tight, float(t))
    for h in np.unique(hub[hub >= 0]):
        m = np.nonzero(hub == h)[0]
        uf.parent[m] = m[0]
    leaders, owner = [], np.full(n, -1)
    for a in range(0, n, 512):
        rows = np.arange(a, min(n, a + 512))
        if leaders:
            s = x[rows] @ x[leaders].T
            best = s.argmax(axis=1)
            ok = s[np.arange(len(rows)), best] >= tight
            owner[rows[ok]] = best[ok]
        rest = rows[owner[rows] < 0]
        if len(rest):
            s = x[rest] @ x[rest].T
            free = np.ones(len(rest), bool)
            for i in range(len(rest)):
                if free[i]:
                    m = free & (s[i] >= tight)
                    m[i] = True
                    free &= ~m
                    owner[rest[m]] = len(leaders)
                    leaders.append(int(rest[i]))
    leaders = np.array(leaders)
    for i, o in enumerate(owner):
        uf.union(i, int(leaders[o]))
    own = np.einsum("ij,ij->i", x, x[leaders[owner]])
    radius = np.zeros(len(leaders))
    np.maximum.at(radius, owner, np.arccos(np.clip(own, -1, 1)))
    reach = np.cos(np.minimum(np.pi, np.arccos(t) + radius + 1e-3)).astype(np.float32)  # per leader: less can't link
    order = np.argsort(owner, kind="stable")
    start = np.searchsorted(owner[order], np.arange(len(leaders) + 1))
    step = lambda width: int(max(64, min(2048, 8_000_000 // max(width, 1))))  # bounds a matrix in memory

    def meet(rows: np.ndarray, heads: np.ndarray, exact: bool) -> None:
        """Union rows with the leaders (by number) they link to; if `exact`, also through the leaders' members."""
        pending, size = [], 0
        for a in range(0, len(rows), step(len(heads))):
            part = rows[a : a + step(len(heads))]
            s = x[part] @ x[leaders[heads]].T
            roots = uf.roots()
            hit = s >= reach[heads][None, :]
            if np.count_nonzero(hit) > hit.size // 20:  # within a large component most pairs are joined already
                hit &= roots[part][:, None] != roots[leaders[heads]][None, :]
            if not hit.any():
                continue
            r, c = np.nonzero(hit)
            sure, apart = s[r, c] >= t, roots[part[r]] != roots[leaders[heads[c]]]
            while (sure & apart).any():  # a partner for every row and every leader that has one, until all are joined
                new = np.nonzero(sure & apart)[0]
                for e in np.union1d(new[np.unique(r[new], return_index=True)[1]], new[np.unique(c[new], return_index=True)[1]]):
                    uf.union(int(part[r[e]]), int(leaders[heads[c[e]]]))
                roots = uf.roots()
                apart = roots[part[r]] != roots[leaders[heads[c]]]
            if exact:
                keep = apart & ~sure & (count[heads[c]] > 1)  # a leader alone is compared above
                pending.append((part[r[keep]], heads[c[keep]]))
                size += int(keep.sum())
                if size > 2_000_000:
                    through(pending)
                    pending, size = [], 0
        through(pending)

    def through(pending: list) -> None:
        if not pending:
            return
        r, c = np.concatenate([q[0] for q in pending]), np.concatenate([q[1] for q in pending])
        o = np.argsort(c, kind="stable")
        r, c = r[o], c[o]
        for leader in np.unique(c):
            members = order[start[leader] : start[leader + 1]]
            roots = uf.roots()
            asks = r[np.searchsorted(c, leader) : np.searchsorted(c, leader, side="right")]
            asks = asks[roots[asks] != roots[members[0]]]
            for a in range(0, len(asks), 2048):
                for b in range(0, len(members), 8192):
                    near = x[asks[a : a + 2048]] @ x[members[b : b + 8192]].T >= t
                    if near.any():  # mostly not, and cheaper to ask than to list
                        i, j = np.nonzero(near)
                        _, firsts = np.unique(uf.roots()[asks[a : a + 2048][i]], return_index=True)
                        for f in firsts:
                            uf.union(int(asks[a : a + 2048][i[f]]), int(members[b : b + 8192][j[f]]))

    count = np.diff(start)
    meet(leaders, np.arange(len(leaders)), exact=False)
    # rows of a large component need not meet its own leaders
    roots = uf.roots()
    kinds, sizes = np.unique(roots, return_counts=True)
    large = kinds[sizes >= 512]
    for root in large:
        meet(np.nonzero(roots == root)[0], np.nonzero(roots[leaders] != root)[0], exact=True)
    meet(np.nonzero(~np.isin(roots, large))[0], np.arange(len(leaders)), exact=True)
    return uf.roots()


def linked_groups(
    df: DataFrame, similarity: float = 0.85, min_size: int = 8, dim: int = 64, id_col: str = "id", vector: str = "embedding",
    leaves: int = 1024, rows_per_cluster: int = 8000, max_clusters: int = 4096, margin: float = 0.06, block: int = 131_072,
) -> DataFrame:
    """(id, group_id, group_size): groups of at least `min_size` usable rows that links of `similarity` or more connect.

    The clusters of the feature trees are where links are looked for: a row goes to its nearest cluster and to those
    whose centroid is at most `margin` farther. Linked rows miss each other only if the line between them leans more
    than 2 margin along the line between their centroids; linked unit vectors differ by at most sqrt(2 - 2 similarity),
    of which a share of about 1/sqrt(dim) lies along any one line, and a group is held together by many links. Within a
    cluster links are found exactly. Rows close to a heavy leaf's mean (half the linking angle) are linked with one
    another for sure; they are one vertex, never compared among themselves. Clusters beyond `block` rows are tiled;
    tiles of one heavy leaf meet only the other rows, or stay alone where there are none. Groups that reach over clusters are joined through shared rows.
    Unusable vectors and null ids take no part; equal vectors and repeated ids are in one group.
    """
    n = df.count()
    k = max(8, min(max_clusters, n // rows_per_cluster))
    model = fit(df, k, dim, max(leaves, min(2 * k, 4096)), id_col, vector)
    cent, src = model.clusters, df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    heavy = np.nonzero(model.weight >= max(block / 4, 1))[0]
    hubs, sure = model.leaves[heavy], math.cos(math.acos(similarity) / 2) + 1e-4

    def places(batches):
        for b in batches:
            ids, x = unit_rows(b.column(0), b.column(1), dim)
            if len(ids) and len(cent):
                s = x @ cent.T
                r, c = np.nonzero(s >= s.max(axis=1)[:, None] - np.float32(margin))
                hub = np.full(len(ids), -1)
                if len(hubs):
                    t = x @ hubs.T
                    best = t.argmax(axis=1)
                    hub = np.where(t[np.arange(len(ids)), best] >= sure, best, -1)
                yield ids, x, r, c, hub

    def histogram(batches):
        total: dict[tuple[int, int], int] = {}
        for _ids, _x, r, c, hub in places(batches):
            keys, m = np.unique(np.stack((c, hub[r])), axis=1, return_counts=True)
            for cc, hh, v in zip(*keys, m):
                total[(int(cc), int(hh))] = total.get((int(cc), int(hh)), 0) + int(v)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in total], pa.int32()), pa.array([q[1] for q in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["cluster", "hub", "n"])

    # counts per cluster and heavy leaf: at most clusters x heavy leaves rows come back
    counts = {}
    for row in src.mapInArrow(histogram, "cluster int, hub int, n bigint").groupBy("cluster", "hub").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(row["cluster"], {})[row["hub"]] = row["n"]
    tiles = {}  # cluster -> [(hub, slices)] and the pairs of tiles to compare
    for c, by in counts.items():
        if sum(by.values()) > block:
            parts = [(h, i, -(-v // (block // 2))) for h, v in sorted(by.items()) for i in range(-(-v // (block // 2)))]
            alone = len(by) == 1  # slices of one heavy leaf only: nothing to compare, but their rows belong to its group
            pairs = [(a, b) for a in range(len(parts)) for b in range(a, len(parts)) if (a == b and (parts[a][0] < 0 or alone)) or (a != b and (parts[a][0] != parts[b][0] or parts[a][0] < 0))]
            tiles[c] = (parts, pairs)

    def spread(batches):
        for ids, x, r, c, hub in places(batches):
            plain = ~np.isin(c, np.fromiter(tiles, np.int64, len(tiles)))
            keys, rows = [c[plain].astype(np.int64) << 32], [r[plain]]
            for cc in np.unique(c[~plain]):
                parts, pairs = tiles[int(cc)]
                m = r[c == cc]
                mix = (ids[m] * 2654435761) >> 9
                for no, (a, b) in enumerate(pairs):
                    take = np.zeros(len(m), bool)
                    for h, i, of in {parts[a], parts[b]}:
                        take |= (hub[m] == h) & (mix % of == i)
                    keys.append(np.full(take.sum(), (int(cc) << 32) + no + 1))
                    rows.append(m[take])
            keys, rows = np.concatenate(keys), np.concatenate(rows)
            for s in range(0, len(rows), 8192):
                p = rows[s : s + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + 8192], pa.int64()), pa.array(ids[p]), pa.array(hub[p].astype(np.int32)), packed(x[p])], names=["task", "id", "hub", "v"])

    def link(tbl: pa.Table) -> pa.Table:
        ids, hub, x = tbl["id"].to_numpy(), tbl["hub"].to_numpy(), unpacked(tbl["v"], dim)
        comp = _link(x, hub, np.float32(similarity))
        size = np.bincount(comp, minlength=len(ids))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, ids)
        m = (size[comp] > 1) | (hub >= 0)  # a heavy leaf's row alone here is linked to the leaf's rows elsewhere
        out_ids, out_rep = ids[m], least[comp[m]]
        return pa.table({"id": pa.array(out_ids, pa.int64()), "rep": pa.array(out_rep, pa.int64()), "hub": pa.array(hub[m].astype(np.int32))})

    local = src.mapInArrow(spread, "task bigint, id bigint, hub int, v binary").groupBy("task").applyInArrow(link, "id bigint, rep bigint, hub int")
    local = cut(local)
    # rows of one heavy leaf are linked across tiles and clusters even where no single task saw two of them
    hub_rep = local.where("hub >= 0").groupBy("hub").agg(F.min("rep").alias("hub_rep"))
    hub_links = local.where("hub >= 0").select("hub", "rep").distinct().join(F.broadcast(hub_rep), "hub").select(F.col("rep").alias("u"), F.col("hub_rep").alias("v"))
    first = local.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    several = first.where("rep <> last").select("id", F.col("rep").alias("first_rep"))
    row_links = local.select("id", "rep").join(several, "id").where("rep <> first_rep").select(F.col("first_rep").alias("u"), F.col("rep").alias("v"))
    comp = connected_components(row_links.union(hub_links).where("u <> v"))
    j = first.join(comp, F.col("rep") == F.col("vertex"), "left").select("id", F.coalesce("component", "rep").alias("group_id"))
    sizes = j.groupBy("group_id").agg(F.count("*").alias("group_size")).where(F.col("group_size") >= min_size)
    return j.join(sizes, "group_id").select("id", "group_id", "group_size")
