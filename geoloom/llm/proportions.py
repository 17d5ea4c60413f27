"""Problem 2: samples that match target category proportions.

Weights are raked by iterative proportional fitting over the margins class, source and label of each plan; a plan's
sample is drawn by weighted exponential keys; then classes below their share or minimum get rows, classes above it
give rows back, and what could not be met is reported for every margin.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.names import class_key, source_key
from geoloom.session import cut, release


def available_points(labeled: DataFrame) -> DataFrame:
    """(dataset_id, id, feature_id, class, source, label): each point's latest row, if its label is 0 or 1.

    The latest by labeled_at (null first), then received_at, then feature_id. Rows without id or dataset_id are no
    points. Kept by max_by, so that a hot dataset or point is combined map-side.
    """
    order = F.struct("labeled_at", "received_at", "feature_id")
    row = F.struct("feature_id", F.col("label").alias("label"), F.col("class").alias("class"), F.col("source").alias("source"))
    p = labeled.where("id is not null and dataset_id is not null").groupBy("dataset_id", "id").agg(F.max_by(row, order).alias("r"))
    p = p.where("r.label in (0, 1)")
    return p.select(
        "dataset_id", "id", F.col("r.feature_id").alias("feature_id"), class_key(F.col("r.class")).alias("class"),
        F.coalesce(source_key(F.col("r.source")), F.lit("unknown")).alias("source"), F.col("r.label").alias("label"),
    )


def plan_targets(target_mix: DataFrame) -> DataFrame:
    """Plans with target_rows (share of the sample, rounded half up) and wanted_rows (at least min_rows)."""
    t = F.floor(F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_size", F.lit(0)), 6) + 0.5).cast("bigint")
    p = target_mix.select("plan_id", "dataset_id", "sample_size", F.col("class").alias("plan_class"), class_key(F.col("class")).alias("class"), "target_share", F.coalesce("min_rows", F.lit(0)).cast("bigint").alias("min_rows"), t.alias("target_rows"))
    return p.withColumn("wanted_rows", F.greatest("target_rows", "min_rows"))


def allotted(available: np.ndarray, target: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """Rows each class ends up with: its share or its minimum where it has them, `size` in all at most.

    Minimums come first, and classes that cannot give what is wanted of them give all they have; if that leaves less
    than the other shares, these are cut in proportion (largest remainders first). Only the minimums alone exceed `size`.
    """
    wanted = np.maximum(target, least)
    floor = np.where(available < wanted, available, least)
    room = np.where(available < wanted, 0, wanted - floor)
    spare = max(0, size - int(floor.sum()))
    if room.sum() > spare:
        share = room * (spare / room.sum())
        give = np.floor(share).astype(np.int64)
        order = np.lexsort((np.arange(len(share)), give - share))
        give[order[: spare - int(give.sum())]] += 1
        room = give
    return floor + room


def rake(n: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 500, tol: float = 1e-6) -> tuple[np.ndarray, int, bool]:
    """(rows of each cell, rounds, converged): cell counts n fitted to margins, each (code per cell, target per code).

    Margins are fitted in turn, the last one exactly. No cell gets more rows than it has: a cell fitted beyond n is
    held at n and the rest of its category makes up for it in the next turn, as far as it can.
    """
    w = n.astype(float).copy()
    for r in range(1, rounds + 1):
        old = w.copy()
        for code, want in margins:
            have = np.bincount(code, w, minlength=len(want))
            w = np.minimum(w * np.where(have > 0, want / np.where(have > 0, have, 1), 0.0)[code], n)
        if np.abs(w - old).max(initial=0.0) <= tol * max(1.0, w.max(initial=0.0)):
            return w, r, True
    return w, rounds, False


def _bound(n: np.ndarray, weight: np.ndarray, rows: float) -> float:
    """A key that more than `rows` of the cells' rows stay below, but for a chance under 1e-15; infinite if all may be needed."""
    need = rows + 8 * math.sqrt(rows) + 40
    if n[weight > 0].sum() <= need:
        return math.inf
    low, high = 0.0, 1.0
    below = lambda key: float((n * -np.expm1(-weight * key)).sum())
    while below(high) < need and high < 1e18:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < need else (low, mid)
    return high if high < 1e18 else math.inf


_CELL = "plan_id bigint, dataset_id string, class string, source string, label int, n bigint, weight double, expected double, bound double, sample_size bigint, quota bigint, rounds int, converged boolean"


def _fit(t: pa.Table) -> pa.Table:
    """Raked cells of one plan: expected rows, weight per row, the class's quota and the key below which its rows lie."""
    n, size = t["n"].to_numpy(), int(t["sample_size"][0].as_py() or 0)
    codes = {c: np.unique(np.array(t[c].to_pylist(), dtype=object).astype(str), return_inverse=True)[1] for c in ("class", "source", "label")}
    k = codes["class"]
    first = np.unique(k, return_index=True)[1]
    available = np.bincount(k, n).astype(np.int64)
    quota = allotted(available, t["target_rows"].to_numpy()[first], t["min_rows"].to_numpy()[first], size)
    total, supply = float(quota.sum()), float(n.sum())
    other = [(codes[c], np.bincount(codes[c], n) / max(supply, 1) * total) for c in ("source", "label")]
    expected, rounds, converged = rake(n, [*other, (k, quota.astype(float))])
    weight = expected / np.maximum(n, 1)
    bound = np.full(len(n), _bound(n, weight, min(size, supply)))
    for c in range(len(available)):
        m = k == c
        if quota[c] > 0:
            bound[m] = max(bound[m][0], _bound(n[m], weight[m], float(quota[c])))
    cols = {c: t[c] for c in ("plan_id", "dataset_id", "class", "source", "label", "n")}
    extra = {"weight": weight, "expected": expected, "bound": bound, "sample_size": np.full(len(n), size), "quota": quota[k]}
    return pa.table({**cols, **{c: pa.array(v) for c, v in extra.items()}, "rounds": pa.array(np.full(len(n), rounds, np.int32)), "converged": pa.array(np.full(len(n), converged))})


def raked_cells(points: DataFrame, target_mix: DataFrame) -> DataFrame:
    """The (class, source, label) cells of each plan with their rows, raked weight and quota; null plan ids take no part.

    A plan's cells are few whatever the number of its points; plans are raked in parallel.
    """
    cells = points.groupBy("dataset_id", "class", "source", "label").agg(F.count("*").alias("n"))
    p = plan_targets(target_mix).where("plan_id is not null").groupBy("plan_id", "dataset_id", "class").agg(*[F.max(c).alias(c) for c in ("sample_size", "target_rows", "min_rows")])
    j = p.join(cells, ["dataset_id", "class"]).select("plan_id", "dataset_id", "class", "source", "label", "n", "sample_size", "target_rows", "min_rows")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: the work is in Python, not in bytes
    return j.repartition(parts, "plan_id").groupBy("plan_id").applyInArrow(_fit, _CELL)


def _candidates(points: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """Rows of the plans' cells with their exponential key -ln(u) / weight, below the cell's bound."""
    u = (F.pmod(F.xxhash64("plan_id", "id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    j = cells.where("weight > 0").join(points, ["dataset_id", "class", "source", "label"])
    return j.withColumn("key", -F.log(u) / F.col("weight")).where("key <= bound").select("plan_id", "feature_id", "id", "class", "source", "label", "weight", "key", "sample_size", "quota", "n")


def sample_plans(labeled: DataFrame, target_mix: DataFrame, seed: int = 17) -> DataFrame:
    """(plan_id, feature_id, id, class, source, label, drawn, weight): the rows of each plan's sample.

    1. A plan's weights are raked to its class shares and to its dataset's own shares of sources and labels.
    2. The sample_size rows with the smallest keys -ln(u) / weight are drawn, over the whole plan.
    3. Classes drawn short of their quota (see allotted) get their next rows by key (drawn = `repair`), classes drawn
       beyond it give back those with the largest keys; the others are marked `weighted`.

    So a sample has its target shares and minimums exactly and never more than sample_size rows, unless the minimums
    alone are more. A class with fewer available rows than wanted gives all it has. Null or blank classes are
    `unknown`; plans of unknown datasets, null plan ids and empty tables give no rows; a class repeated within a plan
    counts once. Rows whose key cannot be among those needed never leave the task that reads them; should a bound turn
    out too low for a plan (a chance under 1e-15), that plan is drawn again without bounds.
    """
    points = cut(available_points(labeled))
    cells = cut(raked_cells(points, target_mix))
    rows = cut(_candidates(points, cells, seed))
    have = rows.groupBy("plan_id", "class").agg(F.count("*").alias("have"))
    need = cells.groupBy("plan_id", "class").agg(F.max("quota").alias("quota"), F.sum("n").alias("n"), F.max("sample_size").alias("size"))
    need = need.join(have, ["plan_id", "class"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    per_plan = Window.partitionBy("plan_id")
    short = need.withColumn("all", F.sum("have").over(per_plan)).withColumn("supply", F.sum(F.when(F.col("quota") > 0, F.col("n")).otherwise(0)).over(per_plan))
    short = cut(short.where("have < least(quota, n) or all < least(size, supply)").select("plan_id").distinct())
    if not short.isEmpty():
        again = cells.join(short, "plan_id").withColumn("bound", F.lit(float("inf")))
        rows = rows.join(short, "plan_id", "left_anti").unionByName(_candidates(points, again, seed))
    # the candidates are few: about sample_size rows a plan, or the quotas where these reach farther
    drawn = F.row_number().over(per_plan.orderBy("key", "feature_id"))
    rank = F.row_number().over(Window.partitionBy("plan_id", "class").orderBy("key", "feature_id"))
    s = rows.withColumn("drawn", F.when(drawn <= F.col("sample_size"), F.lit("weighted")).otherwise(F.lit("repair"))).withColumn("rank", rank)
    s = s.where("rank <= quota").select("plan_id", "feature_id", "id", "class", "source", "label", "drawn", "weight")
    out = cut(s)
    release(rows, short)
    return out


def sample_report(labeled: DataFrame, target_mix: DataFrame, seed: int = 17) -> DataFrame:
    """Every plan and class with target_rows, wanted_rows, what its sample holds, its share and what is missing.

    gap = wanted_rows - sampled where that is positive; `unmet` where it is because the class has no further rows:
    the sample holds all that are available. Other gaps were given up for the minimums of other classes. A row without
    plan_id belongs to no sample: its gap is what its class lacks of wanted_rows.
    """
    counts = available_points(labeled).groupBy("dataset_id", "class").agg(F.count("*").alias("available"))
    s = sample_plans(labeled, target_mix, seed).groupBy("plan_id", "class").agg(F.count("*").alias("sampled"), F.count_if(F.col("drawn") == "repair").alias("repaired"))
    r = plan_targets(target_mix).join(s, ["plan_id", "class"], "left").join(counts, ["dataset_id", "class"], "left")
    r = r.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("sampled", "repaired", "available")})
    total = F.sum("sampled").over(Window.partitionBy("plan_id"))
    held = F.when(F.col("plan_id").isNull(), F.col("available")).otherwise(F.col("sampled"))
    r = r.withColumn("actual_share", F.col("sampled") / F.greatest(total, F.lit(1))).withColumn("gap", F.greatest(F.lit(0), F.col("wanted_rows") - held))
    return r.withColumn("unmet", (F.col("gap") > 0) & (held >= F.col("available")))


def margin_report(labeled: DataFrame, target_mix: DataFrame, seed: int = 17) -> DataFrame:
    """(plan_id, margin, value, target, raked, sampled, gap, rounds, converged) of the margins class, source and label.

    target: the class's quota, or the dataset's own share of a source or label times the sample; raked: the rows that
    the fitted weights expect; gap = target - sampled. Margins that contradict each other or the supply leave raked
    off target and converged false.
    """
    points = cut(available_points(labeled))
    c = cut(raked_cells(points, target_mix))
    s = sample_plans(labeled, target_mix, seed)
    size = c.groupBy("plan_id", "class").agg(F.max("quota").alias("q")).groupBy("plan_id").agg(F.sum("q").alias("size"))
    supply = c.groupBy("plan_id").agg(F.sum("n").alias("supply"))
    out = None
    for m in ("class", "source", "label"):
        target = F.max("quota").cast("double") if m == "class" else F.sum("n") * F.first("size") / F.first("supply")
        g = c.join(size, "plan_id").join(supply, "plan_id").groupBy("plan_id", F.col(m).cast("string").alias("value"))
        g = g.agg(target.alias("target"), F.sum("expected").alias("raked"), F.max("rounds").alias("rounds"), F.bool_and("converged").alias("converged"))
        n = s.groupBy("plan_id", F.col(m).cast("string").alias("value")).agg(F.count("*").alias("sampled"))
        g = g.join(n, ["plan_id", "value"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)).cast("bigint"))
        g = g.select("plan_id", F.lit(m).alias("margin"), "value", "target", "raked", "sampled", (F.col("target") - F.col("sampled")).alias("gap"), "rounds", "converged")
        out = g if out is None else out.unionByName(g)
    return out
