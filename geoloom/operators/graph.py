"""Connected components by random-mate contraction, as SQL joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import cut, release


def _heads(v, seed: int, rnd: int):
    return F.xxhash64(v, F.lit(seed * 1009 + rnd)).bitwiseAND(F.lit(1).cast("bigint")) == 1


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", seed: int = 17, max_rounds: int = 200) -> DataFrame:
    """(vertex, component) for every vertex of `edges`; component is the smallest vertex of its component.

    Vertices are of any one orderable type (numbers, strings).

    Each round flips a coin per vertex; a tail with a head among its neighbours is contracted into its smallest head.
    Vertices of a single edge are always tails and their neighbours heads (of two such, the smaller), so pairs and
    stars vanish at once. Edges are relabelled, loops and repeats dropped, until none is left; then the contractions
    are unwound backwards. A round removes an expected quarter of the vertices that still have an edge, or more,
    whatever the component's shape (a path needs as few rounds as a star). All state is distributed and checkpointed; nothing is collected but counts.
    Null endpoints are ignored, a loop still reports its vertex, no edges give an empty result.
    """
    e0 = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    e0 = cut(e0.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    loops = e0.where("u = v").select(F.col("u").alias("vertex"))
    e = e0.where("u <> v")
    hooks: list[DataFrame] = []
    for rnd in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = cut(both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v"))
        single = ends.select(F.col("u").alias("x"), F.lit(True).alias("end"))
        anchor = ends.select(F.col("v").alias("x"), F.lit(True).alias("anchor")).distinct()
        state = single.join(anchor, "x", "full").select("x", F.coalesce("end", F.lit(False)).alias("end"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
        of = lambda c: state.select(F.col("x").alias(c), F.struct("end", "anchor").alias("s" + c))
        at = both.join(of("u"), "u", "left").join(of("v"), "v", "left")
        end = lambda c: F.coalesce(F.col(f"s{c}.end"), F.lit(False))
        held = lambda c: F.coalesce(F.col(f"s{c}.anchor"), F.lit(False))
        pair = end("u") & end("v") & (F.col("u") > F.col("v"))
        tail = ~end("u") & ~held("u") & ~_heads(F.col("u"), seed, rnd)
        head = ~end("v") & (held("v") | _heads(F.col("v"), seed, rnd))
        hook = cut(at.where(pair | (end("u") & ~end("v")) | (tail & head)).groupBy("u").agg(F.min("v").alias("p")))
        release(ends)
        hooks.append(hook)
        a = e.join(hook, "u", "left").select(F.coalesce("p", "u").alias("u"), "v")
        b = a.join(hook.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("p", "v").alias("v"))
        last, e = e, cut(b.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        release(last)
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")

    root: DataFrame | None = None  # (vertex, root) of the vertices contracted so far, last round first
    for i, hook in enumerate(reversed(hooks), 1):
        if root is None:
            root = hook.select(F.col("u").alias("vertex"), F.col("p").alias("root"))
            continue
        lifted = hook.join(root.select(F.col("vertex").alias("p"), "root"), "p", "left").select(F.col("u").alias("vertex"), F.coalesce("root", "p").alias("root"))
        root = root.unionByName(lifted)
        if i % 6 == 0:
            root = cut(root)
    everyone = loops.select("vertex", F.col("vertex").alias("root"))
    if root is not None:
        root = cut(root)
        tops = root.select(F.col("root").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root"))
        everyone = everyone.join(root.unionByName(tops), "vertex", "left_anti").unionByName(root).unionByName(tops)
    least = everyone.groupBy("root").agg(F.min("vertex").alias("component"))
    out = cut(everyone.join(least, "root").select("vertex", "component"))
    release(e0, e, *hooks)
    return out
