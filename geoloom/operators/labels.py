"""Interactive labels as an append-only event log, folded to the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE, ERASE = 1, 0, -100  # label domain: fixed values


def delivered_once(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Repeated deliveries of a sequence number count once (the first to arrive); null labels are no events."""
    cols = [c for c in events.columns if c != seq]
    e = events.where(F.col("label").isNotNull() & F.col(seq).isNotNull())
    return e.groupBy(seq).agg(F.min_by(F.struct(*cols), F.struct("arrived_at", "point_id", "label")).alias("e")).select(seq, "e.*")


def toggled(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys..., label): the same label again removes it, another moves it, ERASE removes; removed points are absent.

    Only the run of equal labels since the last other event matters, so no event list is gathered: a label stands if
    its final run has an odd length. Hot sessions are folded per point.
    """
    last_other = F.max(F.when(F.col("label") != F.col("last"), F.col(order)))
    last = events.groupBy(*keys).agg(F.max_by("label", order).alias("last"))
    e = events.join(last, keys)
    r = e.groupBy(*keys, "last").agg(last_other.alias("other"))
    run = e.drop("last").join(r, keys).where((F.col("label") == F.col("last")) & (F.col("other").isNull() | (F.col(order) > F.col("other"))))
    odd = run.groupBy(*keys, "last").agg(F.count("*").alias("n")).where((F.col("last") != ERASE) & (F.col("n") % 2 == 1))
    return odd.select(*keys, F.col("last").alias("label"))


def last_label(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys..., label): the last event wins; points whose last event is ERASE are absent."""
    return events.groupBy(*keys).agg(F.max_by("label", order).alias("label")).where(F.col("label") != ERASE)


def since_reset(events: DataFrame, session: str, is_reset: Column, order: str = "seq") -> DataFrame:
    """Events of each session after its last reset (entering or leaving a mode clears the labels)."""
    reset = events.groupBy(session).agg(F.max(F.when(is_reset, F.col(order))).alias("__reset"))
    return events.join(reset, session).where(F.col("__reset").isNull() | (F.col(order) > F.col("__reset"))).drop("__reset")


MANUAL = ("manual_pos", "manual_neg")
REVIEWED = ("relabel_pos", "relabel_neg")


def class_of(label: Column, names: tuple[str, str]) -> Column:
    """The class name of a positive or negative label; null for other labels."""
    return F.when(label == POSITIVE, F.lit(names[0])).when(label == NEGATIVE, F.lit(names[1]))


def dataset_rows(labels: DataFrame, tiles: DataFrame, cached: DataFrame | None = None, names: tuple[str, str] = MANUAL) -> DataFrame:
    """Labelled tiles (id, label) with the stored columns of `tiles` and class; a cached embedding (id, embedding) overrides the stored one.

    Labels without a stored tile, and erased or null labels, are left out. Repeated label rows repeat the tile.
    """
    j = labels.where(F.col("label").isin(POSITIVE, NEGATIVE)).select("id", "label").join(tiles, "id")
    if cached is not None:
        j = j.join(cached.select("id", F.col("embedding").alias("__cached")), "id", "left").withColumn("embedding", F.coalesce("__cached", "embedding")).drop("__cached")
    return j.withColumn("class", class_of(F.col("label"), names))


def augmented(manual: DataFrame, reviewed: DataFrame, names: tuple[str, str] = MANUAL, review_names: tuple[str, str] = REVIEWED) -> DataFrame:
    """Manual labels and detection reviews (tile_id, label) in one table with class and source (manual, detection_review)."""
    m = manual.select("tile_id", "label", class_of(F.col("label"), names).alias("class"), F.lit("manual").alias("source"))
    r = reviewed.select("tile_id", "label", class_of(F.col("label"), review_names).alias("class"), F.lit("detection_review").alias("source"))
    return m.unionByName(r)


def label_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("label") == POSITIVE).alias("positives"), F.count_if(F.col("label") == NEGATIVE).alias("negatives"))


def correction_weight(cls: Column, weight: float) -> Column:
    return F.when(cls.isin("relabel_pos", "relabel_neg"), F.lit(weight)).otherwise(F.lit(1.0))
