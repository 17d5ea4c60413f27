"""The pN_ queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import chunks, clusters, leaks, mixing, neighbours, proportions, splits, subset
from geoloom.session import cut, table

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_varied_subset(spark: SparkSession, sf: str) -> DataFrame:
    """A twentieth of the stored tiles, spanning the kinds of scenery."""
    g = table(spark, sf, "geo_embeddings")
    return subset.varied_subset(g, max(100, g.count() // 20))


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the combinations in the stored tiles and in the subset."""
    g = table(spark, sf, "geo_embeddings")
    return subset.coverage(g, max(100, g.count() // 20))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    r = proportions.sample_report(table(spark, sf, "labeled"), table(spark, sf, "target_mix"))
    return r.where("unmet").select("plan_id", F.col("class"))


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return proportions.sample_plans(table(spark, sf, "labeled"), table(spark, sf, "target_mix"))


def p2_margins(spark: SparkSession, sf: str) -> DataFrame:
    """What the samples hold of every class, source and label against the targets."""
    return proportions.margin_report(table(spark, sf, "labeled"), table(spark, sf, "target_mix"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.linked_groups(table(spark, sf, "geo_embeddings")).select("id", "group_id")


def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.described_clusters(table(spark, sf, "geo_embeddings"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    n = neighbours.similar_vectors(table(spark, sf, "geo_embeddings"), 5, min_similarity=0.95)
    return neighbours.mutual_neighbours(cut(n)).select("id_a", "id_b")


def p4_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar rows, however similar, of every row whose id is divisible by 100."""
    return neighbours.similar_vectors(table(spark, sf, "geo_embeddings"), 10, queries=F.col("id") % 100 == 0, tables=2, margin=None, ranks=40)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.related_groups(table(spark, sf, "geo_embeddings")).where("group_size > 1").select("id", "group_id")


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.grouped_splits(cut(splits.related_groups(table(spark, sf, "geo_embeddings"))), SPLIT_SHARES)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    r = mixing.mix_report(mixing.sized_documents(table(spark, sf, "documents")), table(spark, sf, "source_mix"))
    return r.where("short").select("mix_id", "source")


def p8_mixed(spark: SparkSession, sf: str) -> DataFrame:
    s = mixing.sized_documents(table(spark, sf, "documents"))
    return mixing.mixed_documents(s, cut(mixing.mix_plan(s, table(spark, sf, "source_mix"))))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.split_oversized(table(spark, sf, "documents")).where("piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.split_oversized(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_varied_subset, p1_coverage, p2_found, p2_sample, p2_margins, p3_found, p3_clusters, p4_found, p4_search, p5_found, p5_splits, p7_found, p7_cleaned, p8_found, p8_mixed, p9_found, p9_pieces)}

ORACLE_SQL = {
    "p2_found": """
with latest as (
  select dataset_id, label, coalesce(nullif(regexp_replace(lower(trim(class)), '[-\\s_]+', '_', 'g'), ''), 'unknown') as class,
         row_number() over (partition by dataset_id, id order by labeled_at desc nulls last, received_at desc nulls last, feature_id desc) as rn
  from labeled where id is not null and dataset_id is not null
), counts as (select dataset_id, class, count(*) as available from latest where rn = 1 and label in (0, 1) group by 1, 2)
select t.plan_id, t.class from target_mix t left join counts c on c.dataset_id = t.dataset_id and c.class = t.class
where coalesce(c.available, 0) < greatest(t.min_rows, cast(floor(round(t.target_share * t.sample_size, 6) + 0.5) as bigint))
""",
}
