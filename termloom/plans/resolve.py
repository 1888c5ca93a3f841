"""Records that describe the same thing: grouping by shared references and reconciling fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components


def groups(refs: DataFrame) -> DataFrame:
    """(obj, grp): objects grouped by any shared (source, key), transitively; grp is the group's least object.

    ``refs`` is (obj, source, key). An object is linked to the least object of each reference, so edges grow with the references."""
    least = refs.groupBy("source", "key").agg(F.min("obj").alias("b"))
    edges = refs.join(least, ["source", "key"]).select(F.col("obj").alias("a"), "b")
    return components(edges).select(F.col("node").alias("obj"), F.col("root").alias("grp"))


def reconcile(records: DataFrame, by: list[str], scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row per group: arrays united and sorted, scalars that agree, and ``conflicts``, the names of those that don't (nulls
    never disagree)."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias(a) for a in arrays]
    aggs += [F.max(s).alias(s) for s in scalars]
    conflict = F.array_compact(F.array(*[F.when(F.countDistinct(s) > 1, F.lit(s)) for s in scalars])) if scalars else F.array().cast("array<string>")
    return records.groupBy(*by).agg(*aggs, conflict.alias("conflicts"))


def split_refs(refs: DataFrame, grouped: DataFrame) -> DataFrame:
    """(grp, source, n): groups to which one source gives several keys."""
    return refs.join(grouped, "obj").groupBy("grp", "source").agg(F.countDistinct("key").alias("n")).where("n > 1")
