"""The label log as a stream: the toggle fold kept per (session, point) in Spark's state store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.labels import ERASE

EVENTS = "seq bigint, session_id string, point_id string, label int, event_at timestamp_ntz, arrived_at timestamp_ntz"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def _fold(key, batches, state):
    last, current = state.get if state.exists else (-1, None)
    rows = pd.concat(list(batches)).dropna(subset=["seq", "label"]).drop_duplicates("seq").sort_values("seq")
    for seq, label in zip(rows["seq"], rows["label"].astype(int)):
        if seq > last:  # repeated deliveries and what was already folded
            current = None if label == ERASE or label == current else label
            last = int(seq)
    state.update((last, current))
    yield pd.DataFrame({"session_id": [key[0]], "point_id": [key[1]], "label": pd.array([current], dtype="Int32"), "last_seq": [last]})


def toggled_stream(events: DataFrame) -> DataFrame:
    """Updates (session_id, point_id, label or null, last_seq); events of a key must arrive in order of seq."""
    return events.groupBy("session_id", "point_id").applyInPandasWithState(
        _fold, "session_id string, point_id string, label int, last_seq bigint", "last bigint, current int", "update", "NoTimeout"
    )


def last_label_stream(events: DataFrame) -> DataFrame:
    """The last event per point wins: a plain streaming aggregation."""
    return events.where(F.col("label").isNotNull()).groupBy("session_id", "point_id").agg(F.max_by("label", "seq").alias("label"))
