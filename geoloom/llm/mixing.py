"""Problem 8: mixing sources to target weights by a time-varying curriculum.

Every source of a mix has a weight schedule over training time t in [0, 1]; its integral is the source's cumulative
token demand. A document's offset in its source's (repeated) token stream, put through the inverse of that integral,
is its training position; documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.names import source_key
from geoloom.llm.tokens import DEFAULT_VOCABULARY, token_counts
from geoloom.operators.prefix import running_total
from geoloom.session import cut


def sized_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every row; source in the spelling of the mixes, null or blank is `unknown`."""
    t = token_counts(documents, vocabulary=vocabulary, keep=("source",))
    return cut(t.select("doc_id", F.coalesce(source_key(F.col("source")), F.lit("unknown")).alias("source"), "tokens"))


def mix_plan(sized: DataFrame, mix: DataFrame, tilt: float = 0.5) -> DataFrame:
    """One row per mix and source: demand, capacity, granted tokens, repeats and the schedule's slope.

    demand = target_share x total_ratio x size of all documents, capacity = max_repeats x size of the source's
    documents, granted = the smaller. The schedule of a source is share x (1 + slope (2t - 1)): slopes run from +tilt
    to -tilt over a mix's sources, the largest available last, and are centred so that the schedules sum to one at all
    times. A source without documents has capacity 0. Null shares, ratios and repeats count as 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = F.broadcast(sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")))  # one row
    m = mix.select("mix_id", "source", source_key(F.col("source")).alias("__s"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_ratio", "target_share", "max_repeats")])
    sizes = sizes.select(F.col("source").alias("__s"), "source_tokens")
    p = m.join(sizes, "__s", "left").crossJoin(total).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    p = p.withColumn("demand", F.col("target_share") * F.col("total_ratio") * F.col("all_tokens")).withColumn("capacity", (F.col("max_repeats") * F.col("source_tokens")).cast("double"))
    p = p.withColumn("granted", F.least("demand", "capacity"))
    per_mix = Window.partitionBy("mix_id")
    rank = F.row_number().over(per_mix.orderBy("source_tokens", "source")) - 1
    raw = F.lit(tilt) * (1 - 2 * rank / F.greatest(F.lit(1), F.count("*").over(per_mix) - 1))
    p = p.withColumn("__raw", raw).withColumn("__w", F.sum("target_share").over(per_mix))
    centre = F.sum(F.col("__raw") * F.col("target_share")).over(per_mix) / F.col("__w")
    slope = F.when(F.col("__w") > 0, F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("__raw") - centre))).otherwise(F.lit(0.0))
    p = p.withColumn("slope", slope).withColumn("repeats", F.when(F.col("source_tokens") > 0, F.col("granted") / F.col("source_tokens")).otherwise(F.lit(0.0)))
    return p.select("mix_id", "source", F.col("__s").alias("source_key"), "target_share", "total_ratio", "max_repeats", "all_tokens", "source_tokens", "demand", "capacity", "granted", "repeats", "slope")


def mixed_documents(sized: DataFrame, plan: DataFrame, seed: int = 5, buckets: int = 1024, ordered: bool = True) -> DataFrame:
    """(mix_id, source, doc_id, epoch, tokens, position): the mix's documents in training order.

    Each pass over a source is shuffled by a hash; a document enters with every pass whose offset it starts below the
    source's granted tokens, so a source is repeated at most max_repeats times and overshoots by less than a document.
    position is the training token at which the document is due. Offsets are running totals over hash buckets, so that
    a source of any size is never sorted in one task. Documents of zero tokens and sources outside the mix are left
    out. With `ordered` rows are range-partitioned and sorted by mix and position.
    """
    h = F.xxhash64("doc_id", "source", F.lit(seed))
    off = running_total(sized.where("tokens > 0"), ["source"], F.pmod(h, F.lit(buckets)).cast("int"), [h, F.col("doc_id")], "tokens", "offset")
    p = plan.where("granted > 0").select("mix_id", F.col("source").alias("mix_source"), F.col("source_key").alias("source"), "source_tokens", "granted", "target_share", "total_ratio", "all_tokens", "slope", "demand")
    j = off.join(F.broadcast(p) if p.count() <= 10_000 else p, "source")
    passes = F.ceil((F.col("granted") - F.col("offset")) / F.col("source_tokens")).cast("int")
    j = j.where(F.col("offset") < F.col("granted")).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    # a source that falls short is spread over the whole time, so its stream is measured in what is granted
    x = (F.col("epoch") * F.col("source_tokens") + F.col("offset")) / F.col("granted")
    b = 1 - F.col("slope")
    t = F.when(F.abs("slope") < 1e-9, x).otherwise((F.sqrt(b * b + 4 * F.col("slope") * x) - b) / (2 * F.col("slope")))
    out = j.select("mix_id", F.col("mix_source").alias("source"), "doc_id", "epoch", "tokens", F.abs(t * F.col("total_ratio") * F.col("all_tokens")).alias("position"))
    return out.repartitionByRange("mix_id", "position").sortWithinPartitions("mix_id", "position", "doc_id", "epoch") if ordered else out


def mix_report(sized: DataFrame, mix: DataFrame) -> DataFrame:
    """Per mix and source: repeats, actual tokens and share of the mixed documents, and whether it falls short.

    short: the source's documents in the mix, repeats included, have fewer tokens than its demand. As a document enters
    if it starts below what is granted, that is so exactly where max_repeats x size is below the demand.
    """
    plan = cut(mix_plan(sized, mix))
    got = mixed_documents(sized, plan, ordered=False).groupBy("mix_id", "source").agg(F.sum("tokens").alias("actual_tokens"), F.count("*").alias("documents"), F.max("epoch").alias("last_epoch"))
    r = plan.join(got, ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    share = F.try_divide("actual_tokens", F.sum("actual_tokens").over(Window.partitionBy("mix_id")))
    return r.select("mix_id", "source", "target_share", "max_repeats", "demand", "capacity", "repeats", F.coalesce("documents", F.lit(0)).alias("documents"), "actual_tokens", F.coalesce(share, F.lit(0.0)).alias("actual_share"), (F.col("actual_tokens") < F.col("demand")).alias("short"))
