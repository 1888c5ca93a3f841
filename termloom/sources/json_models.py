"""JSON exports of a modelling tool: one document per file, bare or wrapped in ``model``; read with one schema, unknown members ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, optional, synonyms

_META = "struct<Description:string,Examples:string,Synonyms:string>"
_END = "struct<id:string,startType:string,endType:string>"
_MODEL = f"""struct<modelId:string,name:string,description:string,
entities:array<struct<id:string,name:string,metadata:{_META},attributes:array<struct<id:string,name:string>>>>,
relationships:array<struct<id:string,name:string,description:string,sourceEntity:{_END},targetEntity:{_END},labels:array<struct<name:string,direction:string>>>>>""".replace("\n", "")


class ContentError(ValueError):
    pass


def models(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, model): each file's document; files that aren't such JSON, or lack ``entities``, raise ContentError with their names."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    own = F.from_json("value", f"struct<model:{_MODEL}>")["model"]
    bare = F.from_json("value", _MODEL)
    df = raw.select("path", F.when(F.coalesce(F.array_contains(F.json_object_keys("value"), "model"), F.lit(False)), own).otherwise(bare).alias("model"))
    bad = [r["path"] for r in df.where("model IS NULL OR model.entities IS NULL OR model.name IS NULL").select("path").collect()]
    if bad:
        raise ContentError("not a model export: " + ", ".join(sorted(bad)))
    return df


def entities(docs: DataFrame, source: str) -> DataFrame:
    e = docs.select("path", F.explode("model.entities").alias("e"))
    broader = inheritance(docs).groupBy("path", "narrower").agg(F.array_sort(F.collect_set("wider")).alias("broader"))
    out = e.select("path", normalize(F.col("e.id")).alias("key"), optional(F.col("e.name")).alias("label"), optional(F.col("e.metadata.Description")).alias("definition"), synonyms(F.coalesce("e.metadata.Synonyms", F.lit(""))).alias("alt_labels"))
    out = out.join(broader.withColumnRenamed("narrower", "key"), ["path", "key"], "left")
    return out.select(F.lit(source).alias("source"), "path", "key", "label", "definition", "alt_labels", F.coalesce("broader", F.array().cast("array<string>")).alias("broader"))


def attributes(docs: DataFrame, source: str) -> DataFrame:
    e = docs.select("path", F.explode("model.entities").alias("e")).select("path", F.col("e.id").alias("owner"), F.explode("e.attributes").alias("a"))
    return e.select(F.lit(source).alias("source"), "path", normalize(F.col("a.id")).alias("key"), optional(F.col("a.name")).alias("label"), normalize(F.col("owner")).alias("owner"))


def _links(docs: DataFrame) -> DataFrame:
    r = docs.select("path", F.explode("model.relationships").alias("r"))
    inherits = F.coalesce(F.col("r.sourceEntity.startType") == "superType", F.lit(False)) | F.coalesce(F.col("r.targetEntity.endType") == "subType", F.lit(False))
    return r.withColumn("inherits", inherits)


def inheritance(docs: DataFrame) -> DataFrame:
    """(path, narrower, wider) of relationships that state inheritance."""
    return _links(docs).where("inherits").select("path", normalize(F.col("r.targetEntity.id")).alias("narrower"), normalize(F.col("r.sourceEntity.id")).alias("wider"))


def relationships(docs: DataFrame, source: str) -> DataFrame:
    """Edges; the label is the name, else the first label that doesn't read backwards; the others are alternates."""
    labels = F.coalesce(F.col("r.labels"), F.array().cast("array<struct<name:string,direction:string>>"))
    forward = F.filter(labels, lambda x: F.lower(F.coalesce(x["direction"], F.lit(""))) != "source")
    label = F.coalesce(optional(F.col("r.name")), optional(F.get(forward, F.lit(0))["name"]))
    out = _links(docs).where("NOT inherits").withColumn("label", label)
    alternates = F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: x["name"]), lambda x: x.isNotNull() & (x != F.col("label")))))
    return out.select(F.lit(source).alias("source"), "path", normalize(F.col("r.id")).alias("key"), "label", alternates.alias("alt_labels"), normalize(F.col("r.sourceEntity.id")).alias("end_a"), normalize(F.col("r.targetEntity.id")).alias("end_b"))


def orphans(docs: DataFrame) -> DataFrame:
    """Inheritance whose narrower entity isn't in its model."""
    known = docs.select("path", F.explode("model.entities").alias("e")).select("path", normalize(F.col("e.id")).alias("narrower"))
    return inheritance(docs).join(known, ["path", "narrower"], "left_anti")
