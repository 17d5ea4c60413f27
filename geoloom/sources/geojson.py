"""GeoJSON in and out: labelled points, detections and vector layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "struct<type:string,features:array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<id:string,tile_id:string,label:double,class:string,source:string,probability:double,embedding:array<double>>>>>"


def kind(doc: Column) -> Column:
    """labeled (label and embedding), detections (probability) or vector_layer, by the first feature."""
    p = lambda k: F.get_json_object(doc, f"$.features[0].properties.{k}").isNotNull()
    return F.when(p("label") & p("embedding"), F.lit("labeled")).when(p("probability"), F.lit("detections")).otherwise(F.lit("vector_layer"))


def features(docs: DataFrame, column: str = "value") -> DataFrame:
    """One row per feature: id, tile_id, label, class, source, probability, embedding, geometry type and coordinates.

    A missing class is `unknown`; documents that cannot be parsed give no rows.
    """
    f = docs.select(F.explode(F.from_json(column, LABELLED)["features"]).alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates")).withColumn("class", F.coalesce("class", F.lit("unknown")))


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole GeoJSON files, unioned."""
    return features(spark.read.text(list(paths), wholetext=True))


def point_features(rows: DataFrame, *properties: str) -> DataFrame:
    """(value): a GeoJSON feature text per row with lon/lat."""
    g = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), g.alias("geometry"))).alias("value"))


def write_collection(features_text: DataFrame, path: str, column: str = "value") -> None:
    """Write feature texts in parallel: every part file is a whole FeatureCollection of its partition's features."""

    def enclose(batches):
        import pyarrow as pa

        last = None
        yield pa.RecordBatch.from_arrays([pa.array(['{"type":"FeatureCollection","features":['])], names=["value"])
        for b in batches:
            rows = [r for r in b.column(0).to_pylist() if r is not None]
            if rows:
                rows, last = ([last] if last is not None else []) + rows[:-1], rows[-1]
                yield pa.RecordBatch.from_arrays([pa.array([r + "," for r in rows], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([*([] if last is None else [last]), "]}"], pa.string())], names=["value"])

    features_text.select(column).mapInArrow(enclose, "value string").write.mode("overwrite").text(path)


def collection(features_text: DataFrame, metadata: Column | None = None, most_bytes: int = 256 << 20) -> DataFrame:
    """One row with a FeatureCollection document (metadata, a struct over the aggregated rows, comes last).

    A document is one value in one task, so the texts' total size is measured first; beyond `most_bytes` it is an
    error: write_collection() writes exports of any size.
    """
    size = features_text.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("b")).first()["b"]
    if size > most_bytes:
        raise ValueError(f"{size} bytes are too many for one document; use write_collection")
    end = F.lit("]}") if metadata is None else F.concat(F.lit('],"metadata":'), F.to_json(metadata), F.lit("}"))
    return features_text.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("value")), ","), end).alias("value"))
