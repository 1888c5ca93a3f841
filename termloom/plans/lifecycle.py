"""What becomes of subjects of the previous output: live, deprecated, or carried as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from .components import stored


def defined(quads: DataFrame) -> DataFrame:
    """Subjects with a block that has their label."""
    return quads.where(F.col("predicate") == V.LABEL).select("subject").distinct()


def divide(previous: DataFrame, live: DataFrame, id_map: DataFrame, fetched: list[str]) -> DataFrame:
    """(subject, fate) of the subjects that are gone: ``deprecate`` if all the sources that own it were fetched, else ``keep``;
    ``unmapped`` if the ID map doesn't have it."""
    lost = defined(previous).join(live.select(F.col("iri").alias("subject")).distinct(), "subject", "left_anti")
    scope = id_map.groupBy(F.col("iri").alias("subject")).agg(F.bool_and(F.col("source").isin(fetched)).alias("all_fetched"))
    fate = F.when(F.col("all_fetched").isNull(), "unmapped").when(F.col("all_fetched"), "deprecate").otherwise("keep")
    return lost.join(scope, "subject", "left").select("subject", fate.alias("fate"))


def deprecated(previous: DataFrame, subjects: DataFrame, merges: DataFrame) -> DataFrame:
    """Statements of deprecated subjects: all but status, replacement and date, then the status and the register's replacement on
    the defining blocks."""
    blocks = stored(previous.join(subjects.select("subject"), "subject", "left_semi").select("file", "subject", "predicate", "o_kind", "o_value", "o_lang"))
    kept = blocks.where(~F.col("predicate").isin(V.STATUS, V.REPLACED_BY, V.MODIFIED)).select("file", "subject", "predicate", "o_kind", "o_value", "o_lang")
    defining = blocks.where(F.col("predicate") == V.LABEL).select("file", "subject").distinct()
    null = F.lit(None).cast("string")
    status = defining.select("file", "subject", F.lit(V.STATUS).alias("predicate"), F.lit("lit").alias("o_kind"), F.lit("deprecated").alias("o_value"), null.alias("o_lang"))
    to = defining.join(merges.select(F.col("deprecated_iri").alias("subject"), "replaced_by_iri"), "subject")
    replaced = to.select("file", "subject", F.lit(V.REPLACED_BY).alias("predicate"), F.lit("iri").alias("o_kind"), F.col("replaced_by_iri").alias("o_value"), null.alias("o_lang"))
    return kept.unionByName(status).unionByName(replaced)


def verbatim(previous: DataFrame, subjects: DataFrame) -> DataFrame:
    """Statements of subjects that are carried as they were; their dates are dealt anew."""
    return previous.join(subjects.select("subject"), "subject", "left_semi").where(F.col("predicate") != V.MODIFIED).select("file", "subject", "predicate", "o_kind", "o_value", "o_lang")
