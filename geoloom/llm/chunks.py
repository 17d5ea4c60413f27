"""Problem 9: splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over the bytes marks landmarks; of the landmarks between a piece's least and greatest size the one with
the smallest hash wins and snaps to the nearest natural boundary. Cuts depend on the text around them only, so an edit
alters the pieces next to it and later cuts fall into place again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.tokens import DEFAULT_VOCABULARY, encode, token_bytes

_GEAR = np.random.default_rng(20240601).integers(0, 1 << 64, 256, dtype=np.uint64)
_WINDOW = 16
_LINE = re.compile(r"\r\n|\n|\r")


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the window of bytes that ends at each byte; equal windows have equal hashes wherever they are."""
    g = _GEAR[data]
    h = np.zeros(len(data), np.uint64)
    for i in range(min(_WINDOW, len(data))):
        h[i:] += g[: len(data) - i] << np.uint64(3 * i)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(character offsets where a piece may start, their level: 3 file, 2 hunk, 1 paragraph, 0 line)."""
    starts = [m.end() for m in _LINE.finditer(text)]
    starts = [s for s in starts if s < len(text)]
    level, blank = [], False
    for a in starts:
        if text.startswith(("diff --git ", "commit ", "From "), a):
            level.append(3)
        elif text.startswith("@@ ", a):
            level.append(2)
        else:
            b = a - 1
            while b > 0 and text[b - 1] in " \t\r":
                b -= 1
            level.append(1 if b > 0 and text[b - 1] == "\n" and text[a : a + 1] not in "\r\n" else 0)
    return np.array(starts, np.int64), np.array(level, np.int64)


def cut_points(text: str, tokens: list[int], widths: np.ndarray, limit: int, least: int, overlap: int) -> list[int]:
    """Character offsets of the cuts; the bodies between them have at most limit - overlap tokens of the whole text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = np.cumsum(widths[np.array(tokens, np.int64)])  # byte offset after each token
    lead = (data & 0xC0) != 0x80
    char_at = np.cumsum(lead) - 1  # character number of each byte
    byte_of = np.nonzero(lead)[0]
    where, level = _boundaries(text)
    natural = byte_of[where] if len(where) else np.zeros(0, np.int64)
    marks = rolling_hash(data)
    most = limit - overlap
    cuts, at = [], 0
    while True:
        t0 = int(np.searchsorted(ends, at, side="right"))
        if len(tokens) - t0 <= (limit if not cuts else most):
            return cuts
        lo, hi = int(ends[t0 + least - 1]), int(ends[t0 + most - 1])
        a, b = np.searchsorted(natural, lo), np.searchsorted(natural, hi, side="right")
        goal = lo + int(marks[lo:hi].argmin()) + 1 if hi > lo else hi
        if b > a:
            best = natural[a:b]
            # a higher level is worth a longer way: each level counts as an eighth of the span
            way = np.abs(best - goal) - level[a:b] * ((hi - lo) / 8)
            at = int(best[way.argmin()])
        else:  # no line ends here: the last blank before the end, else the last whole character
            at = hi
            space = text.rfind(" ", int(char_at[lo]), int(char_at[min(hi, len(data) - 1)]))
            at = int(byte_of[space]) if space > 0 and byte_of[space] > lo else at
            while at < len(data) and not lead[at]:
                at -= 1
            if at <= int(ends[t0 - 1] if t0 else 0):
                at = hi
                while at < len(data) and not lead[at]:
                    at += 1
        cuts.append(int(char_at[at]) if at < len(data) else len(text))


def pieces(text: str, vocabulary: str, limit: int, overlap: int, least: int) -> list[tuple[int, int, int, int]] | None:
    """(start, body start, end, tokens) of each piece in characters, or None if the text is within the limit."""
    if len(text) * 4 <= limit or (text.isascii() and len(text) <= limit):
        return None  # a token has a byte at least
    tokens = encode(vocabulary, text)
    if len(tokens) <= limit:
        return None
    widths = token_bytes(vocabulary)
    slack = 16  # the first and last tokens of a piece may split differently when it stands alone
    cuts = cut_points(text, tokens, widths, limit - slack, least, overlap)
    lengths = np.cumsum([1 if ord(c) < 128 else len(c.encode("utf-8", "replace")) for c in text]) if not text.isascii() else None
    ends = np.cumsum(widths[np.array(tokens, np.int64)])
    out, edges = [], [0, *cuts, len(text)]
    i = 0
    while i + 1 < len(edges):
        a, b = edges[i], edges[i + 1]
        s = a
        if i and overlap:
            byte = int(lengths[a - 1]) if lengths is not None else a
            t = max(0, int(np.searchsorted(ends, byte, side="right")) - overlap)
            start = int(ends[t - 1]) if t else 0
            s = max(edges[i - 1], int(np.searchsorted(lengths, start, side="left")) + 1 if lengths is not None and start else start)
        n = len(encode(vocabulary, text[s:b]))
        if n > limit and b - a > 1:  # alone it needs more tokens: halve the body
            mid = text.rfind("\n", a + 1, a + (b - a) // 2)
            edges.insert(i + 1, mid + 1 if mid > a else a + (b - a) // 2)
            continue
        out.append((s, a, b, n))
        i += 1
    return out


def split_oversized(
    df: DataFrame, limit: int = 2048, overlap: int = 128, least: int = 768, id_col: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """(doc_id, piece_no, pieces, start, body_start, tokens, text) of every text of more than `limit` tokens.

    Each piece, encoded alone, has at most `limit` tokens; it begins with the last `overlap` tokens of the piece
    before (body_start - start characters, rounded to whole characters) and the bodies put together are the text again.
    Cuts fall before files, hunks, paragraphs or lines; within a line of more than a piece before a blank or, without
    one, between characters. Null, empty and shorter texts give no rows. Rows are handled where they are read: no
    shuffle.
    """
    if not 0 <= overlap < limit // 2 or not 1 <= least < limit - overlap - 16:
        raise ValueError("overlap must be below half the limit and least below what is left")

    def go(batches):
        for b in batches:
            rows, size = [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = pieces(t, vocabulary, limit, overlap, least) if t else None
                for k, (s, a, e, n) in enumerate(p or []):
                    rows.append((d, k, len(p), s, a, n, t[s:e]))
                    size += e - s
                if size > 4_000_000:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece_no", "pieces", "start", "body_start", "tokens", "text"])

    return df.select(F.col(id_col).cast("bigint"), F.col(text)).mapInArrow(go, "doc_id bigint, piece_no int, pieces int, start bigint, body_start bigint, tokens bigint, text string")
