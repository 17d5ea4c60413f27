"""Relevance-feedback similarity search: labels to query vector, exact top-k, and what is shown of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import vec


def query_vector(labelled: DataFrame, vector: str = "embedding", positive: Column | None = None) -> DataFrame:
    """(pos, value): twice the mean of the positives minus the mean of the negatives (0 without negatives).

    `positive` is a boolean column (default label = 1). Null vectors are ignored; without positives there are no rows.
    Means are combined map-side per element, so any number of labels costs one small shuffle.
    """
    p = F.col("label") == 1 if positive is None else positive
    e = labelled.where(F.col(vector).isNotNull()).select(p.alias("p"), F.posexplode(vector).alias("pos", "v"))
    v = F.col("v").cast("double")
    m = e.groupBy("pos").agg(F.avg(F.when(F.col("p"), v)).alias("pm"), F.avg(F.when(~F.col("p"), v)).alias("nm"))
    return m.where("pm is not null").select("pos", (2 * F.col("pm") - F.coalesce("nm", F.lit(0.0))).alias("value"))


def as_row(query: DataFrame) -> DataFrame:
    """The (pos, value) form as a single row with the array q; one row, so broadcasting it is bounded by the dimension."""
    return query.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda r: r["value"]).alias("q")).where(F.size("q") > 0)


DISTANCES = {"l2": vec.l2, "l2_squared": vec.l2_squared, "cosine": vec.cosine_distance}


def top_k(tiles: DataFrame, query: DataFrame, k: int, metric: str = "l2", exclude: DataFrame | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, distance, rank): the k nearest tiles to the query row, ties by id, without the ids of `exclude`.

    One narrow scan of id and vector; every task keeps its own k best (TakeOrderedAndProject), nothing else moves.
    Null vectors are skipped; without a query row there are no results.
    """
    t = tiles.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("__v"))
    if exclude is not None:
        t = t.join(exclude.select(F.col(exclude.columns[0]).alias("id")), "id", "left_anti")
    d = t.crossJoin(F.broadcast(query.select("q"))).select("id", DISTANCES[metric](F.col("__v"), F.col("q")).alias("distance"))
    top = d.orderBy("distance", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def overfetch_top_k(tiles: DataFrame, query: DataFrame, k: int, labelled: DataFrame, metric: str = "l2_squared") -> DataFrame:
    """Fetch k + min(labelled, k // 2), then drop the labelled and keep k: may give fewer than k rows."""
    n = labelled.count()
    got = top_k(tiles, query, k + min(n, k // 2), metric).drop("rank")
    got = got.join(labelled.select("id"), "id", "left_anti").orderBy("distance", "id").limit(k)
    return got.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def with_metadata(hits: DataFrame, tiles: DataFrame, *columns: str) -> DataFrame:
    """Late materialisation: join the few hits back to the wide table, keeping distance and rank by id."""
    return tiles.select("id", *columns).join(F.broadcast(hits), "id")  # hits: at most k rows


def highlight_cutoff(hits: DataFrame, share: float = 0.1, most: int = 100) -> DataFrame:
    """One row: the greatest distance among the max(1, min(most, ceil(share n))) nearest, and the overall range."""
    n = F.count("*").over(Window.partitionBy())
    w = Window.orderBy("distance", "id")
    h = hits.withColumn("n", n).withColumn("r", F.row_number().over(w))
    keep = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.lit(share) * F.col("n"))))
    return h.agg(F.max(F.when(F.col("r") <= keep, F.col("distance"))).alias("cutoff"), F.min("distance").alias("low"), F.max("distance").alias("high"))


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def color_fraction(d: Column, low: Column, high: Column, cutoff: Column | None = None) -> Column:
    """Similarity as a colour fraction, 1 for the nearest; within the cutoff it runs from 1 to 0.7, beyond to 0."""
    plain = 1 - _clip((d - low) / (high - low))
    if cutoff is not None:
        c = F.least(cutoff, high)
        far = F.when(high > c, F.greatest(F.lit(0.0), 0.7 - 0.7 * _clip((d - c) / (high - c)))).otherwise(F.lit(0.7))
        plain = F.when(c > low, F.when(d <= c, 0.7 + 0.3 * (1 - _clip((d - low) / (c - low)))).otherwise(far)).otherwise(plain)
    return F.when(high > low, plain).otherwise(F.lit(0.5))


def with_probability_fraction(df: DataFrame, p: str = "probability", out: str = "fraction") -> DataFrame:
    """Add the min-max scaled probability over the table; missing counts as 0.5; 0.5 if all are equal.

    The range is one aggregated row, joined to all others; the table itself doesn't move.
    """
    v = F.coalesce(p, F.lit(0.5))
    r = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (v - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.5))
    return df.crossJoin(F.broadcast(r)).withColumn(out, scaled).drop("__lo", "__hi")  # one row


def page(hits: DataFrame, number: int, first: int = 20, size: int = 50) -> DataFrame:
    """Page 0 holds the `first` ranks, every later page `size` more."""
    a, b = (1, first) if number == 0 else (first + (number - 1) * size + 1, first + number * size)
    return hits.where(F.col("rank").between(a, b))


def display_order(hits: DataFrame, order: str = "Similar", detection_mode: bool = False, by: str = "distance") -> DataFrame:
    """Position in the panel; Dissimilar reverses, detection mode reverses again."""
    back = (order == "Dissimilar") != detection_mode
    return hits.withColumn("position", F.row_number().over(Window.orderBy(F.col(by).desc() if back else F.col(by).asc(), F.col("id").desc() if back else F.col("id").asc())))
