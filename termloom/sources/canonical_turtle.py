"""Reader of the canonical Turtle that this library writes: blocks between empty lines, one statement a line, fixed prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocabulary import TYPE, prefixes


def _iri(c: Column, base: str) -> Column:
    out = F.lit(None).cast("string")
    for p, ns in prefixes(base).items():
        out = F.when(F.startswith(c, F.lit(p + ":")), F.concat(F.lit(ns), F.substring(c, len(p) + 2, 1 << 30))).otherwise(out)
    return F.when(F.startswith(c, F.lit("<")), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(out)


def _unescape(c: Column) -> Column:
    mark = "\u0001"  # stands for a backslash meanwhile; canonical text has no raw control characters
    c = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), *((f"\\u{n:04X}", chr(n)) for n in [0, *range(2, 8), 11, *range(14, 32), 127])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(F.replace(c, F.lit(mark), F.lit("\\")), F.lit("\\u0001"), F.lit(mark))


def parse(files: DataFrame, base: str) -> DataFrame:
    """Statements of (file, text)."""
    c = F.col
    block = files.select("file", F.explode(F.slice(F.split(c("text"), "\n\n"), 2, 1 << 30)).alias("b"))
    body = block.select("file", F.rtrim(F.regexp_replace("b", r"\s*\.\s*$", "")).alias("b"))
    cut = body.select("file", F.split_part("b", F.lit(" "), F.lit(1)).alias("s"), F.explode(F.split(F.substring("b", F.instr("b", " ") + 1, F.lit(1 << 30)), " ;\n  ")).alias("st"))
    o = cut.select("file", _iri(c("s"), base).alias("subject"), F.split_part("st", F.lit(" "), F.lit(1)).alias("p"), F.substring("st", F.instr("st", " ") + 1, F.lit(1 << 30)).alias("o"))
    literal = r'^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^(\S+))?$'
    lit_ = F.startswith("o", F.lit('"'))
    part = lambda n: F.nullif(F.regexp_extract("o", literal, n), F.lit(""))
    return o.select(
        "file", "subject", F.when(c("p") == "a", TYPE).otherwise(_iri(c("p"), base)).alias("predicate"), F.when(lit_, "lit").otherwise("iri").alias("o_kind"),
        F.when(lit_, _unescape(F.regexp_extract("o", literal, 1))).otherwise(_iri(c("o"), base)).alias("o_value"), F.when(lit_, part(2)).alias("o_lang"), F.when(lit_, _iri(part(3), base)).alias("o_type"),
    )


def read(spark: SparkSession, folder: str, base: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.ttl").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))
    return parse(files, base)
