"""Problem 1: a varied subset of given size.

Vectors become categories (kind of scenery, texture within the kind) by the leaves of cluster-feature trees over all
rows; all rows are aggregated into category combinations; a minimum-cost flow with convex penalties for overuse turns
balanced category targets into quotas per combination; quotas are filled by a deterministic rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.clusters import leaf_summaries, ward
from geoloom.llm.neighbours import axis_values
from geoloom.llm.vectors import unit_rows
from geoloom.operators.prefix import first_per_key, hash_bucket
from geoloom.session import cut, release

# convex overuse: free up to the target, then every further stretch (as a share of the target) costs more a row
STRETCHES = ((0.125, 1.0), (0.125, 2.0), (0.25, 3.0), (0.5, 5.0), (1.0, 9.0), (2.0, 17.0))
BEYOND = 33.0


class Convex:
    """Arcs with a piecewise linear convex cost each: `room` in all, the first `target` units free."""

    def __init__(self, room: np.ndarray, target: float, weight: float):
        self.flow = np.zeros(room.shape, np.int64)
        ends, prices, at = [np.minimum(room, max(1, round(target)))], [0.0], max(1, round(target))
        for share, price in STRETCHES:
            at += max(1, round(target * share))
            ends.append(np.minimum(room, at))
            prices.append(weight * price)
        self.ends = np.stack((*ends, room), axis=-1)
        self.prices = np.array([*prices, weight * BEYOND, np.inf])

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """(cost of one more unit, units at that cost) of every arc."""
        at = (self.ends <= self.flow[..., None]).sum(axis=-1)
        end = np.take_along_axis(self.ends, np.minimum(at, self.ends.shape[-1] - 1)[..., None], axis=-1)[..., 0]
        return self.prices[at], end - self.flow

    def back(self) -> tuple[np.ndarray, np.ndarray]:
        """(cost saved by one unit less, units at that saving); none where there is no flow."""
        at = (self.ends < self.flow[..., None]).sum(axis=-1)
        start = np.where(at > 0, np.take_along_axis(self.ends, np.maximum(at - 1, 0)[..., None], axis=-1)[..., 0], 0)
        return np.where(self.flow > 0, self.prices[at], -np.inf), self.flow - start


def balanced_flow(supply: np.ndarray, size: int) -> np.ndarray:
    """Minimum-cost flow of `size` units through rows and columns of `supply`, both and the cells as even as supply allows.

    Successive shortest paths over the residual network, source - row categories - column categories - sink, every arc
    with a convex cost of overuse. Costs are convex, so only the next and the last unit of an arc matter, and a path is
    found by a few relaxations of a matrix.
    """
    rows, cols = Convex(supply.sum(axis=1), size / supply.shape[0], 1.0), Convex(supply.sum(axis=0), size / supply.shape[1], 1.0)
    cells = Convex(supply, size / max(1, np.count_nonzero(supply)), 0.5)
    sent = 0
    while sent < size:
        (rc, rroom), (kc, kroom), (fc, froom), (bc, broom) = rows.forward(), cols.forward(), cells.forward(), cells.back()
        da, db = rc.copy(), np.full(len(kc), np.inf)
        via_a, via_b = np.full(len(da), -1), np.full(len(db), -1)  # a reached from column via_a (-1: source), b from row via_b
        while True:
            to_b = da[:, None] + fc
            best = to_b.argmin(axis=0)
            new = to_b[best, np.arange(len(db))]
            better_b = new < db - 1e-12
            db, via_b = np.where(better_b, new, db), np.where(better_b, best, via_b)
            to_a = db[None, :] - bc
            best = to_a.argmin(axis=1)
            new = to_a[np.arange(len(da)), best]
            better_a = new < da - 1e-12
            da, via_a = np.where(better_a, new, da), np.where(better_a, best, via_a)
            if not better_a.any():
                break
        b = int((db + kc).argmin())
        if not np.isfinite(db[b] + kc[b]):
            break
        path, push, end = [], min(size - sent, int(kroom[b])), b
        while True:
            a = int(via_b[b])
            path.append((a, b, 1))
            push = min(push, int(froom[a, b]))
            if via_a[a] < 0:
                push = min(push, int(rroom[a]))
                break
            b = int(via_a[a])
            path.append((a, b, -1))
            push = min(push, int(broom[a, b]))
        rows.flow[a] += push
        cols.flow[end] += push
        for i, j, sign in path:
            cells.flow[i, j] += sign * push
        sent += push
    return cells.flow


def quotas(counts: dict[tuple[int, int], int], size: int) -> dict[tuple[int, int], int]:
    """Rows to take of each combination (all of them if there are no more than `size`)."""
    a_of, b_of = sorted({a for a, _ in counts}), sorted({b for _, b in counts})
    size = min(size, sum(counts.values()))
    if size <= 0:
        return {}
    supply = np.zeros((len(a_of), len(b_of)), np.int64)
    for (a, b), n in counts.items():
        supply[a_of.index(a), b_of.index(b)] = n
    flow = balanced_flow(supply, size)
    return {(a_of[i], b_of[j]): int(flow[i, j]) for i, j in zip(*np.nonzero(flow))}


def _centroids(n: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    label = ward(n, x * n[:, None], k)
    sums = np.zeros((label.max() + 1, x.shape[1]))
    np.add.at(sums, label, x * n[:, None])
    return (sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]).astype(np.float32)


def _rest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    r = x - c[(x @ c.T).argmax(axis=1)]
    return (r / np.maximum(np.linalg.norm(r, axis=1), 1e-9)[:, None]).astype(np.float32)


def _categorised(df: DataFrame, kinds: int | None, textures: int, dim: int, leaves: int, id_col: str, vector: str, seed: int):
    """(rows with kind, texture and bucket of near-identical vectors as a written table, rows per combination); None without usable rows."""
    n, s = leaf_summaries(df, dim, leaves, id_col, vector)
    if not len(n):
        return None, {}
    x = s / np.maximum(np.linalg.norm(s, axis=1), 1e-12)[:, None]
    # every leaf counts alike, whatever its rows: rare scenery has centroids of its own
    even = np.ones(len(x))
    kind_c = _centroids(even, x, kinds or max(4, min(64, len(x) // 8)))
    texture_c = _centroids(even, _rest(x.astype(np.float32), kind_c).astype(np.float64), textures)

    def categorise(batches):
        for b in batches:
            ids, v = unit_rows(b.column(0), b.column(1), dim)
            if len(ids):
                k = (v @ kind_c.T).argmax(axis=1)
                t = (_rest(v, kind_c) @ texture_c.T).argmax(axis=1)
                a1, a2 = axis_values(v, seed + 5), axis_values(v, seed + 6)
                same = a1.argmax(axis=1) * a1.shape[1] + a2.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(c.astype(np.int32)) for c in (k, t, same)]], names=["id", "kind", "texture", "same"])

    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    c = cut(src.mapInArrow(categorise, "id bigint, kind int, texture int, same int"))
    # at most kinds x textures rows come back
    return c, {(r["kind"], r["texture"]): r["n"] for r in c.groupBy("kind", "texture").agg(F.count("*").alias("n")).collect()}


def varied_subset(
    df: DataFrame, size: int, kinds: int | None = None, textures: int = 12, dim: int = 64, leaves: int = 1024, id_col: str = "id", vector: str = "embedding", seed: int = 3,
) -> DataFrame:
    """(id, kind, texture, quota, rank): `size` rows (or all usable rows, if fewer) that span the vectors' categories.

    kind is the nearest of the centroids that Ward agglomeration makes of the trees' leaves (an eighth of the leaves,
    at least 4 and at most 64, unless given: more variety gives more kinds), texture the nearest of `textures`
    centroids of what the kind leaves over. The trees read every row, so a rare kind has leaves of its own. Within a
    combination rows are ranked by their turn within a hash bucket of near-identical vectors first, then by a hash of
    the id: each of many copies waits until every bucket has given a row. No combination or bucket is sorted whole.
    The same table in the same files gives the same subset; another partitioning may give other categories. Unusable
    vectors and null ids take no part; repeated ids may be chosen once per row; an empty table gives no rows.
    """
    c, counts = _categorised(df, kinds, textures, dim, leaves, id_col, vector, seed)
    if c is None:
        return df.sparkSession.createDataFrame([], "id bigint, kind int, texture int, quota bigint, rank int")
    q = df.sparkSession.createDataFrame([(k, t, n) for (k, t), n in sorted(quotas(counts, size).items())], "kind int, texture int, quota bigint")
    r = c.join(F.broadcast(q), ["kind", "texture"]).withColumn("h", F.xxhash64("id", F.lit(seed)))  # at most kinds x textures rows
    # a bucket's turn beyond the combination's quota can never come
    r = first_per_key(r, ["kind", "texture", "same"], "quota", hash_bucket(F.col("h")), [F.col("h"), F.col("id")], "turn")
    r = cut(r.select("id", "kind", "texture", "quota", "h", F.col("turn").cast("int").alias("turn")))
    # a combination has as many rows of one turn as it has buckets, at most the square of twice the dimension
    r = first_per_key(r, ["kind", "texture"], "quota", F.col("turn"), [F.col("h"), F.col("id")], "rank")
    return r.select("id", "kind", "texture", "quota", F.col("rank").cast("int").alias("rank"))


def coverage(df: DataFrame, size: int, kinds: int | None = None, textures: int = 12, dim: int = 64, leaves: int = 1024, id_col: str = "id", vector: str = "embedding", seed: int = 3) -> DataFrame:
    """(kind, texture, rows, quota, share_before, share_after) of every combination: how a subset of `size` changes the table's make-up."""
    c, counts = _categorised(df, kinds, textures, dim, leaves, id_col, vector, seed)
    want, total = quotas(counts, size), max(1, sum(counts.values()))
    taken = max(1, sum(want.values()))
    if c is not None:
        release(c)
    rows = [(k, t, n, want.get((k, t), 0), n / total, want.get((k, t), 0) / taken) for (k, t), n in sorted(counts.items())]
    return df.sparkSession.createDataFrame(rows, "kind int, texture int, rows bigint, quota bigint, share_before double, share_after double")
