"""Comparison of two snapshots of statements: new, gone, changed and unchanged subjects, and their dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V


def sets(quads: DataFrame) -> DataFrame:
    """(subject, s): each subject's statements over all files, without its date, as a sorted array. Objects are whole terms: kind,
    language and datatype count as far as there are columns of them (none is as good as null there; languages without case)."""
    rows = quads.where(F.col("predicate") != V.MODIFIED)
    empty = F.lit("")
    of = {"o_kind": F.col("o_kind"), "o_lang": F.lower("o_lang"), "o_type": F.nullif(F.col("o_type"), F.lit(V.XSD + "string"))}
    more = [F.coalesce(x, empty).alias(n) if n in quads.columns else empty.alias(n) for n, x in of.items()]
    return rows.groupBy("subject").agg(F.array_sort(F.collect_set(F.struct("predicate", "o_value", *more))).alias("s"))


def new(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.select("subject").distinct().join(previous.select("subject").distinct(), "subject", "left_anti")


def gone(current: DataFrame, previous: DataFrame) -> DataFrame:
    return new(previous, current)


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Subjects of both whose statement sets differ. Sets are compared whole: one file's share of a subject isn't enough."""
    return sets(current).join(sets(previous).withColumnRenamed("s", "was"), "subject").where("s <> was").select("subject")


def dated(current: DataFrame, previous: DataFrame, today: str) -> DataFrame:
    """(subject, modified): the previous date where the set is the same and has one, else today."""
    date = previous.where(F.col("predicate") == V.MODIFIED).groupBy("subject").agg(F.max("o_value").alias("date"))
    old = sets(previous).withColumnRenamed("s", "was").join(date, "subject", "left")
    both = sets(current).join(old, "subject", "left")
    return both.select("subject", F.when((F.col("s") == F.col("was")) & F.col("date").isNotNull(), F.col("date")).otherwise(F.lit(today)).alias("modified"))
