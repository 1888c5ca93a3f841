"""CSV registers: the ID map and the merge register. The header must match exactly; blank lines are skipped; bad rows are issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocabulary import KINDS

ID_MAP = ("iri", "kind", "source_name", "source_key", "first_seen", "note")
MERGES = ("deprecated_iri", "replaced_by_iri", "date", "note")


class HeaderError(ValueError):
    pass


def scan(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All rows as text, with row_no in file order (files in order of their names)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise HeaderError(f"{path} has no header")
    if (got := first[0][0].lstrip("﻿").strip()) != ",".join(columns):
        raise HeaderError(f"{path}: header is {got!r}")
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in columns), multiLine=True, quote='"', escape='"')
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
    return rows.withColumn("row_no", F.monotonically_increasing_id() + 1)


def id_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): rows that are sound, and (row_no, message) of each problem."""
    rows = scan(spark, path, ID_MAP)
    checks = [
        (F.col("iri") == "", "no IRI"),
        (~F.col("kind").isin(*KINDS), "unknown kind"),
        ((F.col("source_name") == "") | F.contains("source_name", F.lit(":")), "bad source name"),
        (F.col("source_key") == "", "no source key"),
        (F.try_to_date("first_seen", "yyyy-MM-dd").isNull(), "bad date"),
    ]
    return _divided(rows, checks, ("first_seen",))


def merges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = scan(spark, path, MERGES).withColumns({c: F.trim(c) for c in MERGES[:2]})
    checks = [
        ((F.col("deprecated_iri") == "") | (F.col("replaced_by_iri") == ""), "no IRI"),
        (F.col("deprecated_iri") == F.col("replaced_by_iri"), "replaces itself"),
        (F.try_to_date("date", "yyyy-MM-dd").isNull(), "bad date"),
    ]
    return _divided(rows, checks, ("date",))


def _divided(rows: DataFrame, checks: list, dates: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("_issues", F.array_compact(F.array(*[F.when(bad, F.lit(m)) for bad, m in checks])))
    good = marked.where(F.size("_issues") == 0).drop("_issues").withColumns({d: F.try_to_date(d, "yyyy-MM-dd") for d in dates})
    return good, marked.select("row_no", F.explode("_issues").alias("message"))
