"""Problem 7: evaluation texts that leak into training text.

The test items' word n-grams, a fixed and checked number, are broadcast as a hash table; every document's word windows
are scanned against it, hits are verified word by word, and spans or documents can be removed.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
# removed characters: soft hyphen and zero-width characters (fixed values)
_GONE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_HAS_GONE = re.compile("[­​‌‍⁠﻿]")


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    return text.translate(_GONE) if _HAS_GONE.search(text) else text


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits after NFKC, lower-casing and removal of soft hyphens and zero-width characters."""
    return _WORD.findall(_fold(text)) if text else []


def words_with_spans(text: str) -> list[tuple[str, int, int]]:
    """words() with each word's place in the original text."""
    folded, origin, i = [], [], 0
    while i < len(text):
        j = i + 1  # a base character with the marks that may combine with it folds as one
        while j < len(text) and (unicodedata.combining(text[j]) or 0x1160 <= ord(text[j]) <= 0x11FF):
            j += 1
        f = _fold(text[i:j])
        folded.append(f)
        origin += [(i, j)] * len(f)
        i = j
    return [(m.group(), origin[m.start()][0], origin[m.end() - 1][1]) for m in _WORD.finditer("".join(folded))]


def item_ngrams(items: list[tuple[int, str | None]], n: int) -> tuple[dict[tuple[str, ...], list[int]], frozenset[str]]:
    """n-gram -> item ids, and the items' vocabulary. Items of fewer than n words have no n-gram and never leak."""
    grams: dict[tuple[str, ...], list[int]] = {}
    vocabulary: set[str] = set()
    for item, text in items:
        w = words(text)
        vocabulary.update(w)
        for i in range(len(w) - n + 1):
            ids = grams.setdefault(tuple(w[i : i + n]), [])
            if item not in ids:
                ids.append(item)
    return grams, frozenset(vocabulary)


def _hits(w: list[str], grams: dict, vocabulary: frozenset, n: int) -> list[tuple[int, list[int]]]:
    """(position, items) of all windows of w that are an item's n-gram.

    A window can only match if all its words are item words, so every n-th word is looked up first and only runs
    around hits are read.
    """
    out, size, i = [], len(w), n - 1
    while i < size:
        if w[i] not in vocabulary:
            i += n
            continue
        a, b = i, i + 1
        while a > 0 and w[a - 1] in vocabulary:
            a -= 1
        while b < size and w[b] in vocabulary:
            b += 1
        for p in range(a, b - n + 1):
            ids = grams.get(tuple(w[p : p + n]))
            if ids:
                out.append((p, ids))
        i = b + n
    return out


def _broadcast_items(items: DataFrame, item_id: str, item_text: str, n: int, max_items: int, max_chars: int):
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("c")).first()
    if size["n"] > max_items or size["c"] > max_chars:
        raise ValueError(f"{size['n']} items of {size['c']} characters are too many to broadcast; scan them in groups of items")
    rows = items.where(F.col(item_id).isNotNull()).select(item_id, item_text).orderBy(item_id).collect()
    return items.sparkSession.sparkContext.broadcast(item_ngrams([(r[0], r[1]) for r in rows], n))


def leaked_items(
    documents: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    max_items: int = 200_000, max_chars: int = 100_000_000,
) -> DataFrame:
    """(doc_id, item_id, windows): documents with at least n consecutive words of an item, once per pair.

    `windows` counts the matching word windows. Whole texts are scanned in one pass without a shuffle; only the items,
    whose number and size are checked, are broadcast. Null and empty texts and null ids match nothing; a repeated
    document row is reported once per row.
    """
    shared = _broadcast_items(items, item_id, item_text, n, max_items, max_chars)

    def scan(batches):
        grams, vocabulary = shared.value
        for b in batches:
            docs, its, cnt = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d is None or not t:
                    continue
                by: dict[int, int] = {}
                for _, ids in _hits(words(t), grams, vocabulary, n):
                    for i in ids:
                        by[i] = by.get(i, 0) + 1
                for i, c in by.items():
                    docs.append(d)
                    its.append(i)
                    cnt.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(its, pa.int64()), pa.array(cnt, pa.int64())], names=["doc_id", "item_id", "windows"])

    return documents.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(scan, "doc_id bigint, item_id bigint, windows bigint")


def without_leaks(
    documents: DataFrame, items: DataFrame, n: int = 12, drop_share: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    max_items: int = 200_000, max_chars: int = 100_000_000,
) -> DataFrame:
    """(doc_id, action, removed_words, text): documents with leaked passages, cleaned.

    The words of matching windows are cut out with what stands between them (`span`); where they make up more than
    `drop_share` of the document's words, the document is dropped and its text null (`document`). Documents without a
    leak are not listed.
    """
    shared = _broadcast_items(items, item_id, item_text, n, max_items, max_chars)

    def clean(batches):
        grams, vocabulary = shared.value
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d is None or not t or not _hits(words(t), grams, vocabulary, n):
                    continue
                spans = words_with_spans(t)
                hit = [False] * len(spans)
                for p, _ in _hits([s[0] for s in spans], grams, vocabulary, n):
                    hit[p : p + n] = [True] * n
                gone = sum(hit)
                if gone > drop_share * len(spans):
                    rows.append((d, "document", gone, None))
                    continue
                out, at, i = [], 0, 0
                while i < len(hit):
                    if hit[i]:
                        j = i
                        while j + 1 < len(hit) and hit[j + 1]:
                            j += 1
                        out.append(t[at : spans[i][1]])
                        at, i = spans[j][2], j
                    i += 1
                rows.append((d, "span", gone, "".join(out) + t[at:]))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["doc_id", "action", "removed_words", "text"])

    return documents.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(clean, "doc_id bigint, action string, removed_words bigint, text string")
