"""Problem 4: the most similar vectors of every vector, by cross-polytope hashing.

A pseudo-rotation (random signs and fast Hadamard transforms, three times) turns a unit vector; its bucket is the
signed axis it lies nearest to. Every row lives in one bucket per table and looks for neighbours in further buckets
whose axis is nearly as near (multiprobe). Rows meet in one shuffle per table; inside a bucket all are compared, and
candidates are ranked by their exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.vectors import packed, pseudo_rotation, unit_rows, unpacked


def axis_values(x: np.ndarray, seed: int) -> np.ndarray:
    """Closeness of every row to each signed axis: columns 0..d-1 positive, d..2d-1 negative."""
    y = pseudo_rotation(x, seed)
    return np.concatenate((y, -y), axis=1)


def _probes(v: np.ndarray, margin: float | None, ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home axis per row, row numbers and axes of the further probes)."""
    home = v.argmax(axis=1)
    if margin is not None:
        more = v >= (v[np.arange(len(v)), home] - np.float32(margin))[:, None]
    else:
        kth = np.partition(v, v.shape[1] - ranks, axis=1)[:, v.shape[1] - ranks]
        more = v >= kth[:, None]
    more[np.arange(len(v)), home] = False
    r, a = np.nonzero(more)
    return home, r, a


def _top(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, k: int):
    """The k most similar columns per row, each column once; ties by column number."""
    o = np.lexsort((cols, -sims, rows))
    rows, cols, sims = rows[o], cols[o], sims[o]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])
    rows, cols, sims = rows[fresh], cols[fresh], sims[fresh]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], sims[keep]


_TIE = np.float32(5e-7)  # rounding of float32 dot products; exact similarities decide among the candidates
_HELD = 1 << 21  # candidates a task gathers before it looks which are beaten


def _dense(s: np.ndarray, k: int, floors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest entries a row that reach the row's floor, with some that nearly tie.

    floors[rows] rises to what a row's k-th best is at least, so later blocks yield few candidates.
    """
    mask = s >= floors[rows][:, None]
    count = np.count_nonzero(mask, axis=1)
    few = np.nonzero((count > 0) & (count <= 4 * k))[0]
    r, c = np.nonzero(mask[few])
    r = few[r]
    many = np.nonzero(count > 4 * k)[0]
    if len(many):
        dense = s[many]
        kth = np.partition(dense, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        floors[rows[many]] = np.maximum(floors[rows[many]], kth - _TIE)
        level = dense >= (kth - _TIE)[:, None]
        count = np.count_nonzero(level, axis=1)
        few = count <= 4 * k
        dr, dc = np.nonzero(level[few])
        out_r, out_c = [r, many[few][dr]], [c, dc]
        for i in np.nonzero(~few)[0]:  # many ties, such as copies: what is greater, and the first of the ties
            pick = np.union1d(np.flatnonzero(dense[i] > kth[i] + _TIE), np.flatnonzero(level[i])[: k + 1])
            out_r.append(np.full(len(pick), many[i]))
            out_c.append(pick)
        r, c = np.concatenate(out_r), np.concatenate(out_c)
    return r, c


class _Best:
    """Candidates of one task as (row, column, float32 similarity); those that k better ones have beaten are dropped on the way."""

    def __init__(self, rows: int, k: int, floor: float):
        self.k, self.floors, self.limit = k, np.full(rows, floor - _TIE, np.float32), _HELD
        self.parts, self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0

    def add(self, rows: np.ndarray, cols: np.ndarray, sims: np.ndarray) -> None:
        self.parts.append((rows, cols, sims))
        self.held += len(rows)
        if self.held > self.limit:
            self.pairs()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and column numbers, each pair once, of what may be among a row's k best; of many ties the first columns."""
        n = len(self.floors)
        r, c, s = (np.concatenate(p) for p in zip(*self.parts))
        key, first = np.unique(r * n + c, return_index=True)
        r, c, s = key // n, key % n, s[first]
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(r)))
        full = starts[count >= self.k]
        kth = s[np.lexsort((-s, r))[full + self.k - 1]]
        self.floors[r[full]] = np.maximum(self.floors[r[full]], kth - _TIE)
        keep = s >= self.floors[r]
        tie = keep & (s <= self.floors[r] + 2 * _TIE)
        before = np.concatenate(([0], np.cumsum(tie)))
        keep &= ~tie | (before[1:] - np.repeat(before[starts], count) <= 4 * self.k)
        self.parts, self.held = [(r[keep], c[keep], s[keep])], np.count_nonzero(keep)
        self.limit = max(_HELD, 2 * self.held)
        return self.parts[0][:2]


def _compare(x: np.ndarray, lno: np.ndarray, rno: np.ndarray, both: bool, best: _Best) -> None:
    """Give `best` the candidates of all rows lno x rno: columns of each row, and rows of each column if `both`.

    A block of similarities stays in the processor's cache; what its rows and columns have no use for is only read once.
    """
    right = x[rno]
    for a in range(0, len(lno), 256):
        part = lno[a : a + 256]
        left = x[part]
        for b in range(0, len(rno), 1024):
            cols = rno[b : b + 1024]
            s = left @ right[b : b + 1024].T
            at = np.minimum(np.searchsorted(cols, part), len(cols) - 1)
            own = np.nonzero(cols[at] == part)[0]
            s[own, at[own]] = -2  # a row isn't its own neighbour; cols is sorted
            for m, these, those in ((s, part, cols), (s.T, cols, part))[: 1 + both]:
                i = np.flatnonzero(m.max(axis=1) >= best.floors[these])
                if len(i):
                    r, c = _dense(m[i], min(best.k, m.shape[1]), best.floors, these[i])
                    best.add(these[i[r]], those[c], m[i[r], c])


def _bucket_search(x: np.ndarray, ids: np.ndarray, home: np.ndarray, asks: np.ndarray, k: int, floor: float, both: bool):
    """(id, neighbour, similarity) within one bucket: rows with `asks` look among all rows with `home`."""
    best = _Best(len(x), k, floor)
    _compare(x, np.nonzero(asks)[0], np.nonzero(home)[0], both, best)
    r, c = best.pairs()
    keep = ids[r] != ids[c]
    r, c = r[keep], c[keep]
    sims = np.empty(len(r))
    for a in range(0, len(r), 65536):
        p, q = x[r[a : a + 65536]].astype(np.float64), x[c[a : a + 65536]].astype(np.float64)
        sims[a : a + 65536] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
    r, c, sims = _top(r, c, sims, k)
    return ids[r], ids[c], sims


def similar_vectors(
    df: DataFrame, k: int, min_similarity: float | None = None, queries: Column | None = None, id_col: str = "id", vector: str = "embedding",
    dim: int = 64, tables: int = 1, margin: float | None = 0.07, ranks: int = 24, seed: int = 11, target_bucket: int | None = None, tile: int = 65_536,
    brute: int | None = None,
) -> DataFrame:
    """(id, neighbour_id, similarity, rank): the up to k most similar rows of every usable row, or of the `queries`.

    Unusable vectors (null, empty, another length, NaN or infinity, all zero) and null ids take no part. Vectors are
    compared by cosine, so scaled copies are equal; equal vectors are neighbours of similarity 1, ties go to the
    smaller id. A repeated id is never its own neighbour. Empty tables give no rows; other columns are ignored.

    With `min_similarity` only neighbours of at least that are given and buckets within `margin` of the nearest axis
    are probed; without it each query probes its `ranks` nearest axes (margin=None). A table has 2d buckets and all rows
    that meet in one are compared, so whether two rows are compared depends on these two alone, never on the number or
    kind of the others; the work grows with the square of the rows. Buckets beyond `tile` rows, such as those of huge
    groups of near-equal vectors, are cut into tiles of rows against rows; nothing is dropped, and no task holds more
    than two tiles. Every row is shuffled once per probe, as 4 bytes a value. `target_bucket` and `brute`, sizes from
    which further rotations once thinned the comparisons, have no effect.
    """
    floor = -1.5 if min_similarity is None else min_similarity
    symmetric = queries is None
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), (F.lit(True) if symmetric else F.coalesce(queries, F.lit(False))).alias("q"))
    use_margin = None if min_similarity is None else margin

    def coded(batches):
        for b in batches:
            ids, x = unit_rows(b.column(0), b.column(1), dim)
            if not len(ids):
                continue
            flags = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist())) if not symmetric else None
            asks = np.ones(len(ids), bool) if symmetric else np.array([flags[i] for i in ids.tolist()], bool)
            for t in range(tables):
                home, r, a = _probes(axis_values(x, seed + 101 * t), use_margin, ranks)
                keep = asks[r]
                yield t, ids, x, asks, home, r[keep], a[keep]

    def histogram(batches):
        homes: dict[int, int] = {}
        probes: dict[int, int] = {}
        for t, _ids, _x, asks, home, _r, a in coded(batches):
            for codes, into in ((home, homes), (a, probes)):
                for c, m in zip(*np.unique(codes.astype(np.int64) * tables + t, return_counts=True)):
                    into[int(c)] = into.get(int(c), 0) + int(m)
        keys = sorted(set(homes) | set(probes))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([homes.get(c, 0) for c in keys], pa.int64()), pa.array([probes.get(c, 0) for c in keys], pa.int64())], names=["bucket", "homes", "probes"])

    # at most tables x 2d rows of counts come back
    sizes = src.mapInArrow(histogram, "bucket bigint, homes bigint, probes bigint").groupBy("bucket").agg(F.sum("homes").alias("homes"), F.sum("probes").alias("probes"))
    cuts = {r["bucket"]: (math.ceil(r["homes"] / tile), max(1, math.ceil((r["homes"] + r["probes"]) / (2 * tile)))) for r in sizes.where(F.col("homes") + F.col("probes") > 2 * tile).collect()}

    def spread(batches):
        for t, ids, x, asks, home, r, a in coded(batches):
            code = np.concatenate((home, a)).astype(np.int64) * tables + t
            row = np.concatenate((np.arange(len(ids)), r))
            is_home = np.concatenate((np.ones(len(ids), bool), np.zeros(len(r), bool)))
            keys, rows, homes, askers = [], [], [], []
            hot = np.isin(code, np.fromiter(cuts, np.int64, len(cuts))) if cuts else np.zeros(len(code), bool)
            keys.append(code[~hot] * 1_000_000)
            rows.append(row[~hot])
            homes.append(is_home[~hot])
            askers.append(asks[row[~hot]])
            for c in np.unique(code[hot]):
                hs, as_ = cuts[int(c)]
                m = np.nonzero(code == c)[0]
                mix = (ids[row[m]] * 2654435761) >> 7
                hb, ab = mix % hs, mix % as_
                for i in range(hs):  # a home row meets every slice of askers
                    mm = is_home[m] & (hb == i)
                    for j in range(as_):
                        own = mm & (ab == j) & asks[row[m]]
                        keys.append(np.full(mm.sum(), c * 1_000_000 + i * 1000 + j))
                        rows.append(row[m][mm])
                        homes.append(np.ones(mm.sum(), bool))
                        askers.append(own[mm])
                for j in range(as_):  # an asking row meets every slice of homes; where it is there as home, it is already
                    for i in range(hs):
                        mm = asks[row[m]] & (ab == j) & ~(is_home[m] & (hb == i))
                        keys.append(np.full(mm.sum(), c * 1_000_000 + i * 1000 + j))
                        rows.append(row[m][mm])
                        homes.append(np.zeros(mm.sum(), bool))
                        askers.append(np.ones(mm.sum(), bool))
            keys, rows = np.concatenate(keys), np.concatenate(rows)
            flag = np.concatenate(homes).astype(np.int8) + 2 * np.concatenate(askers).astype(np.int8)
            for s in range(0, len(rows), 8192):
                p = rows[s : s + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + 8192], pa.int64()), pa.array(ids[p]), pa.array(flag[s : s + 8192]), packed(x[p])], names=["task", "id", "flag", "v"])

    def search(tbl: pa.Table) -> pa.Table:
        ids, flag, x = tbl["id"].to_numpy(), tbl["flag"].to_numpy(), unpacked(tbl["v"], dim)
        o = np.argsort(ids, kind="stable")  # ties go to the smaller id
        ids, flag, x = ids[o], flag[o], x[o]
        i, j, s = _bucket_search(x, ids, (flag & 1) > 0, (flag & 2) > 0, k, floor, symmetric)
        if min_similarity is not None:
            ok = s >= min_similarity
            i, j, s = i[ok], j[ok], s[ok]
        return pa.table({"id": pa.array(i, pa.int64()), "neighbour_id": pa.array(j, pa.int64()), "similarity": pa.array(s, pa.float64())})

    found = src.mapInArrow(spread, "task bigint, id bigint, flag byte, v binary").groupBy("task").applyInArrow(search, "id bigint, neighbour_id bigint, similarity double")
    best = found.groupBy("id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual_neighbours(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of the pairs in which each is among the other's neighbours."""
    p = neighbours.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b"), "similarity", "id").distinct()
    return p.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n")).where("n = 2").drop("n")
