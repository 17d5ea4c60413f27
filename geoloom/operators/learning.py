"""Training data for classifiers: splits, negatives, metrics, boosted trees, scoring and cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.prefix import first_per_key, total_before
from geoloom.operators.spatial import far_from


def hash_order(seed: int, *cols: str) -> Column:
    """A reproducible random order that does not depend on partitioning: md5 of seed and key, as both engines have it."""
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_part(h: str) -> Column:
    """The first three hex digits of a hash_order column as a number: 4,096 parts in the hash's order."""
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows, with a failure at run time if any violates `ok` (null counts as a violation)."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def labelled_vectors(labels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Labels with embeddings by tile_id; a label without a stored vector fails (see missing_vectors)."""
    j = labels.join(tiles.select("tile_id", "embedding"), "tile_id", "left")
    return require(j, F.col("embedding").isNotNull(), "a labelled tile has no embedding")


def missing_vectors(labels: DataFrame, tiles: DataFrame) -> DataFrame:
    return labels.join(tiles.where(F.col("embedding").isNotNull()).select("tile_id"), "tile_id", "left_anti")


def stratified_split(samples: DataFrame, fraction: float = 0.2, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Add `part` (train/test): of each positive class max(1, floor(n f)); of each negative class the same number,
    max(1, floor(f times the smallest negative class)), as far as the class reaches. Order is a seeded hash; rows of one
    id stay together; rows without class are train. No class is sorted whole: the last test row of each class is found
    by counts per hash prefix, and every row compares itself with it."""
    n = samples.groupBy("class", "label").agg(F.count("*").alias("n"))
    least = n.where("label = 0").agg(F.min("n").alias("least"))  # one row
    n = n.crossJoin(F.broadcast(least))
    take = F.when(F.col("label") == 1, F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).otherwise(F.greatest(F.lit(1), F.floor(F.col("least") * fraction)))
    n = F.broadcast(n.select("class", "label", take.alias("__take")))  # one row per class
    s = samples.select("class", "label", F.col(id_col).alias("__id"), hash_order(seed, id_col).alias("__h"))
    test = first_per_key(s.join(n, ["class", "label"]), ["class", "label"], "__take", hash_part("__h"), [F.col("__h"), F.col("__id")])
    edge = F.broadcast(test.groupBy("class", "label").agg(F.max(F.struct("__h", "__id")).alias("__edge")))  # one row per class
    key = F.struct(hash_order(seed, id_col).alias("__h"), F.col(id_col).alias("__id"))
    return samples.join(edge, ["class", "label"], "left").withColumn("part", F.when(key <= F.col("__edge"), F.lit("test")).otherwise(F.lit("train"))).drop("__edge")


def random_negatives(tiles: DataFrame, positives: DataFrame, n: int, seed: int = 42, buffer_m: float | None = None) -> DataFrame:
    """n seeded random tiles that are no positives and, with a buffer, farther than it from all positives.

    If the buffer leaves nothing, only the ids are excluded. Label 0, class random_neg.
    """
    rest = tiles.join(positives.select("tile_id"), "tile_id", "left_anti")
    if buffer_m is not None:
        far = far_from(rest, positives, buffer_m)
        rest = rest if far.isEmpty() else far
    pick = rest.orderBy(hash_order(seed, "tile_id"), "tile_id").limit(n)
    return pick.select("id", "tile_id", F.lit(0).alias("label"), F.lit("random_neg").alias("class"))


def stratified_sample(points: DataFrame, per_class: dict[int, int], seed: int = 42, cls: str = "land", id_col: str = "id") -> DataFrame:
    """Up to per_class[c] points of each class in seeded order; other classes give none."""
    want = F.create_map(*[F.lit(x) for kv in per_class.items() for x in kv])
    r = F.row_number().over(Window.partitionBy(cls).orderBy(hash_order(seed, id_col), id_col))
    most = max(per_class.values(), default=0)
    return points.where(F.col(cls).isin(*per_class)).withColumn("r", r).where((F.col("r") <= most) & (F.col("r") <= F.try_element_at(want, F.col(cls)))).drop("r")


def remap(c: Column, mapping: dict) -> Column:
    """Class codes through a table; codes outside it are masked (null)."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)


def binary_metrics(df: DataFrame, label: str = "label", p: str = "probability", threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold, 0 where a denominator is; per group if asked."""
    y, h = F.col(label) == 1, F.col(p) >= threshold
    g = df.groupBy(*(by or [])).agg(
        F.count_if(y & h).alias("tp"), F.count_if(~y & h).alias("fp"), F.count_if(y & ~h).alias("fn"), F.count_if(~y & ~h).alias("tn")
    )
    d = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.withColumns({"accuracy": d(tp + tn, tp + fp + fn + tn), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn)})


def roc_auc(df: DataFrame, label: str = "label", p: str = "probability") -> DataFrame:
    """Area under the ROC curve from average ranks, computed on one row per distinct score (null with one class).

    Scores are first counted per value; the running count goes over range partitions of the distinct scores.
    """
    s = df.groupBy(p).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    s = total_before(s, "n", p).withColumn("rank_sum", F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2))
    a = s.agg(F.sum("rank_sum").alias("r"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return a.select(F.when((F.col("np") > 0) & (F.col("nn") > 0), (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"))


def valid_folds(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Folds whose test part has both labels, with its counts."""
    g = df.groupBy(fold).agg(F.count_if(F.col("label") == 1).alias("test_pos"), F.count_if(F.col("label") == 0).alias("test_neg"))
    return g.where("test_pos > 0 and test_neg > 0")


def _features(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.where(F.col("embedding").isNotNull()).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def fit_boosted_trees(train: DataFrame, trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42, weight: str | None = None):
    """A gradient-boosted binary classifier over embedding and label."""
    from pyspark.ml.classification import GBTClassifier

    g = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, featuresCol="features", labelCol="label")
    if weight:
        g = g.setWeightCol(weight)
    return g.fit(_features(train).withColumn("label", F.col("label").cast("double")))


def score(model, tiles: DataFrame, threshold: float | None = None) -> DataFrame:
    """(id, tile_id, probability) of every tile with a vector, at or above the threshold if one is given."""
    from pyspark.ml.functions import vector_to_array

    s = model.transform(_features(tiles)).select("id", "tile_id", vector_to_array("probability")[1].alias("probability"))
    return s if threshold is None else s.where(F.col("probability") >= threshold)


def cross_validate(samples: DataFrame, trees: int = 20, depth: int = 4, weight: str | None = None) -> DataFrame:
    """One row per valid fold with its test metrics; folds without both labels are skipped, none valid is an error."""
    folds = [r["fold"] for r in valid_folds(samples).orderBy("fold").collect()]  # one row per fold
    if not folds:
        raise ValueError("no valid folds")
    out = None
    for k in folds:
        m = fit_boosted_trees(samples.where(F.col("fold") != k), trees, depth, weight=weight)
        held = samples.where(F.col("fold") == k)
        p = score(m, held).join(held.select("id", "label"), "id")
        row = binary_metrics(p).crossJoin(roc_auc(p)).withColumn("fold", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def mean_and_std(per_fold: DataFrame, *metrics: str) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    return per_fold.agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
