"""Token counts with a public byte-level BPE vocabulary; its path is a parameter, nothing is copied or trained."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the public pre-tokenizer pattern of this vocabulary: a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ranks file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of every token."""
    enc = encoding(path)
    return np.array([len(enc.decode_single_token_bytes(i)) if _known(enc, i) else 0 for i in range(enc.max_token_value + 1)], np.int64)


def _known(enc, i: int) -> bool:
    try:
        enc.decode_single_token_bytes(i)
        return True
    except KeyError:
        return False


def encode(path: str, text: str) -> list[int]:
    """Token ids of a whole text.

    The library's matcher may give up on an extremely long unbroken run; such a text is encoded run by run.
    """
    enc = encoding(path)
    try:
        return enc.encode_ordinary(text)
    except (ValueError, BaseException) as e:  # noqa: B014 - a panic of the native matcher isn't an Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        return [t for a in range(0, len(text), 20000) for t in enc.encode_ordinary(text[a : a + 20000])]


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep..., tokens): the whole text's number of tokens; null and empty texts have 0."""
    cols = [F.col(id_col).alias(id_col), *[F.col(c) for c in keep], F.col(text).alias("__text")]
    src = df.select(*cols)
    n = len(cols) - 1
    names = [*src.columns[:n], "tokens"]

    def count(batches):
        for b in batches:
            t = [len(encode(vocabulary, x)) if x else 0 for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(t, pa.int64())], names=names)

    from pyspark.sql.types import LongType, StructField, StructType

    return src.mapInArrow(count, StructType([*src.schema.fields[:n], StructField("tokens", LongType())]))
