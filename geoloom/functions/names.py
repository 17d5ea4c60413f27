"""Tile ids, class and source spellings, file and model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_key(c: Column) -> Column:
    """Canonical tile_id: upper case, no surrounding blanks, `_` for `-`, number parts without leading zeros.

    Null and blank ids give null, so they equal nothing.
    """
    t = F.regexp_replace(F.translate(F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))), "-", "_"), r"(^|_)0+(?=\d)", "$1")
    return F.when(t != "", t)


def class_key(c: Column) -> Column:
    """Class in lower case with `_` between words; null or blank is `unknown`."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), r"[-\s_]+", "_")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("unknown")).otherwise(t)


def source_key(c: Column) -> Column:
    """Source in lower case with `-` between words; null or blank gives null."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), r"[-\s_]+", "-")
    return F.when(t != "", t)


def mgrs_parts(c: Column) -> Column:
    """struct<zone,band,square> of a tile id that begins with an MGRS id; null if it does not."""
    m = r"^(\d{1,2})([C-HJ-NP-X])([A-Z]{2})"
    zone = F.regexp_extract(c, m, 1).try_cast("int")
    return F.when(
        zone.between(1, 60),
        F.struct(zone.alias("zone"), F.regexp_extract(c, m, 2).alias("band"), F.regexp_extract(c, m, 3).alias("square")),
    )


def tile_spec(name: Column) -> Column:
    """struct<size_px,overlap_px,resolution> from a name ending in size_overlap_resolution (extension and `_metadata` dropped)."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.(db|duckdb|index|faiss|parquet|tar\.gz)$", ""), "_metadata$", "")
    m = r"(\d+)_(\d+)_(\d+(?:\.\d+)?)$"
    size = F.regexp_extract(stem, m, 1).try_cast("int")
    return F.when(
        size.isNotNull(),
        F.struct(
            size.alias("size_px"),
            F.regexp_extract(stem, m, 2).try_cast("int").alias("overlap_px"),
            F.regexp_extract(stem, m, 3).try_cast("double").alias("resolution"),
        ),
    )


def human_size(n: Column) -> Column:
    """Bytes with one decimal in B, KB, MB, GB or TB (steps of 1024); null is `unknown`."""
    out = F.when(n.isNull(), F.lit("unknown"))
    d = n.cast("double")
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(d < 1024.0 ** (i + 1), F.concat(F.format_string("%.1f", F.bround(d / 1024.0**i, 1)), F.lit(" " + unit)))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(d / 1024.0**4, 1)), F.lit(" TB")))


def region_key(c: Column) -> Column:
    """Region name for matching: trimmed lower case with `_` between words."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s_]+", "_")
