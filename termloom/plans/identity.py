"""Permanent identifiers: lookup in the ID map, minting, and the checks of either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocabulary import RANK
from .components import stored


def resolve(named: DataFrame, id_map: DataFrame) -> DataFrame:
    """Objects with ``known`` (the ID map's IRI, if there is one) and ``iri`` (that, else the minted one)."""
    known = id_map.select("source", "key", F.col("iri").alias("known"))
    return named.withColumnRenamed("iri", "minted").join(known, ["source", "key"], "left").withColumn("iri", F.coalesce("known", "minted"))


def appended(resolved: DataFrame, id_map: DataFrame) -> DataFrame:
    """New rows of the ID map, numbered on from its last: by kind, then source:key.

    Places are dealt within ranges of the sort order, whose sizes are added up, so that no single task sorts all rows.
    """
    rank = F.lit(len(RANK))
    for k, n in RANK.items():
        rank = F.when(F.col("kind") == k, n).otherwise(rank)
    last = id_map.agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("last"))
    fresh = resolved.where("known IS NULL").select(rank.alias("_rank"), "iri", "kind", "source", "key", "ref")
    return placed(fresh, ["_rank", "ref"]).crossJoin(F.broadcast(last)).select((F.col("last") + F.col("place")).alias("row_no"), "iri", "kind", "source", "key")


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place`` (from 1) in a total order: sorted in ranges, numbered within each, moved on by the sizes of those before.

    The ranges are stored, as their limits are sampled: made again for the sizes, they would be others."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_p": F.shiftright("_m", 33), "_n": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_m")
    sizes = ranged.groupBy("_p").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy(F.col("a._p").alias("_p")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


def collisions(named: DataFrame) -> DataFrame:
    """(iri, n): identifiers that more than one object has."""
    return named.groupBy("iri").agg(F.count("*").alias("n")).where("n > 1")


def kind_conflicts(named: DataFrame, id_map: DataFrame) -> DataFrame:
    recorded = id_map.select("source", "key", F.col("kind").alias("recorded"))
    return named.join(recorded, ["source", "key"]).where("kind <> recorded").select("source", "key", "kind", "recorded")


def append_only(base: DataFrame, current: DataFrame) -> DataFrame:
    """(source, key, change): rows of the base that the current map lacks or has edited."""
    now = current.select("source", "key", F.col("iri").alias("i"), F.col("kind").alias("k"), F.lit(True).alias("there"))
    both = base.join(now, ["source", "key"], "left")
    change = F.when(F.col("there").isNull(), "removed").when((F.col("iri") != F.col("i")) | (F.col("kind") != F.col("k")), "edited")
    return both.select("source", "key", change.alias("change")).where("change IS NOT NULL")
