"""Vectors between Arrow and numpy for the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def unit_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit float32 vectors) of the usable rows: an id and exactly `dim` finite values, not all zero."""
    vectors = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_floating(vectors.type.value_type) else vectors
    ok = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False), pc.is_valid(ids))
    ids, vectors = ids.filter(ok), vectors.filter(ok)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    flat = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim).astype(np.float64)
    top = np.abs(x).max(axis=1)
    good = np.isfinite(top) & (top > 0)
    x, top = x[good], top[good]
    x /= top[:, None]  # so that huge or tiny values neither overflow nor vanish
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), x.astype(np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as fixed-width binaries."""
    x = np.ascontiguousarray(x, np.float32)
    width = x.shape[1] * 4
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def unpacked(a: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The float32 matrix of packed rows."""
    parts = a.chunks if isinstance(a, pa.ChunkedArray) else [a]
    out = []
    for p in parts:
        if len(p):
            off = np.frombuffer(p.buffers()[1], np.int32)[p.offset : p.offset + len(p) + 1]
            out.append(np.frombuffer(p.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.float32).reshape(-1, dim))
    return np.concatenate(out) if out else np.zeros((0, dim), np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def pseudo_rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, after padding to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d), np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), d))
    return y


class UnionFind:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                return p
            p[:] = q
