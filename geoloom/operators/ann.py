"""Approximate search tables: coarse cells, product-quantised codes and SQ8, as plain DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import vec


def training_size(n: int) -> int:
    """Rows to train on: a tenth, but at least two million (or all)."""
    return min(n, max(n // 10, 2_000_000))


def _matrix(batch: pa.RecordBatch, col: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column(col)
    import pyarrow.compute as pc

    ok = pc.fill_null(pc.equal(pc.list_value_length(v), dim), False)
    return batch.column(0).filter(ok).to_numpy(zero_copy_only=False), v.filter(ok).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of every row."""
    if x.shape[1] == 1:  # on a line, between midpoints
        o = np.argsort(c[:, 0], kind="stable")
        s = c[o, 0]
        return o[np.searchsorted((s[1:] + s[:-1]) / 2, x[:, 0])]
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        s, n = np.zeros_like(c), np.bincount(a, minlength=len(c))
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


class IvfPq:
    """Coarse centroids and codebooks: at most nlist x dim and m x 2^nbits x dim/m floats, so they travel in closures."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray):
        self.coarse, self.books = coarse, books


def train_ivf_pq(df: DataFrame, nlist: int, m: int, nbits: int = 8, dim: int = 64, sample: int = 50_000, seed: int = 42, vector: str = "embedding") -> IvfPq:
    """Train on a seeded sample of about `sample` rows (the bound is the parameter)."""
    n = df.count()
    h = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    rows = df.where((F.size(vector) == dim) & (h <= F.lit(int(min(1.0, sample / max(n, 1)) * 1_000_000)))).select(vector).toPandas()[vector]
    if not len(rows):
        raise ValueError("no vectors to train on")
    x = np.stack(rows.to_numpy()).astype(np.float32)
    coarse = _lloyd(x, nlist, seed)
    rest = x - coarse[_nearest(x, coarse)]
    w = dim // m
    books = np.stack([_pad(_lloyd(rest[:, j * w : (j + 1) * w], 1 << nbits, seed + j), 1 << nbits) for j in range(m)])
    return IvfPq(coarse, books)


def _pad(c: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate((c, np.repeat(c[-1:], k - len(c), axis=0))) if len(c) < k else c


def encode(df: DataFrame, model: IvfPq, dim: int = 64, vector: str = "embedding") -> DataFrame:
    """(id, cell, code): one pass; write it partitioned by cell for partition-pruned probes."""
    coarse, books = model.coarse, model.books
    m, w = books.shape[0], books.shape[2]

    def go(batches):
        for b in batches:
            ids, x = _matrix(b, 1, dim)
            if len(ids):
                cell = _nearest(x, coarse)
                r = x - coarse[cell]
                code = np.stack([_nearest(r[:, j * w : (j + 1) * w], books[j]) for j in range(m)], axis=1).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell.astype(np.int32)), pa.array(list(code), pa.list_(pa.int16()))], names=["id", "cell", "code"])

    return df.select("id", F.col(vector).alias("v")).mapInArrow(go, "id bigint, cell int, code array<smallint>")


def search(lists: DataFrame, model: IvfPq, query: np.ndarray, k: int, nprobe: int | None = None) -> DataFrame:
    """(id, distance): the k smallest asymmetric squared distances over the nprobe nearest cells (all by default)."""
    q = np.asarray(query, np.float32)
    d = ((model.coarse - q) ** 2).sum(axis=1)
    cells = np.argsort(d, kind="stable")[: nprobe or len(d)]
    books, coarse = model.books, model.coarse
    m, w = books.shape[0], books.shape[2]
    t = lists.where(F.col("cell").isin(*[int(c) for c in cells])) if nprobe else lists

    def go(batches):
        for b in batches:
            ids, cell = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            if len(ids):
                code = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                out = np.zeros(len(ids))
                for c in np.unique(cell):  # one lookup table per cell
                    r = (q - coarse[c]).reshape(m, w)
                    table = ((books - r[:, None, :]) ** 2).sum(axis=2)
                    at = cell == c
                    out[at] = table[np.arange(m)[None, :], code[at]].sum(axis=1)
                keep = np.argsort(out, kind="stable")[:k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(out[keep])], names=["id", "distance"])

    return t.select("id", "cell", "code").mapInArrow(go, "id bigint, distance double").orderBy("distance", "id").limit(k)


def reranked(found: DataFrame, df: DataFrame, query: np.ndarray, k: int, vector: str = "embedding") -> DataFrame:
    """(id, distance): the k rows of `df` nearest by exact squared distance among those whose id search() `found`."""
    near = df.join(F.broadcast(found.select("id").distinct()), "id", "left_semi")  # as many ids as search() was asked for
    return near.select("id", vec.l2_squared(F.col(vector), vec.literal(query)).alias("distance")).orderBy("distance", "id").limit(k)
