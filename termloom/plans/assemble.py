"""From records to statements: each object becomes its rows (file, subject, predicate, object)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V


def home_file(kind: Column, home: Column, glossary: Column) -> Column:
    """Name of the file that an object's own statements go to; its home is the least of its schemes."""
    stem = F.when(kind == "relationship", "relationships-").when(glossary, "concepts-").otherwise("taxonomy-")
    return F.concat(stem, home, F.lit(".ttl"))


def statements(named: DataFrame, base: str, glossary: Callable[[Column], Column], language: str = "en") -> DataFrame:
    """Statement rows of objects that have ref and iri; references are resolved by ref, those that don't resolve give no statement
    (:func:`dangling` reports them). One pass over the objects, and one join per kind of reference."""
    c = F.col
    home = F.array_min("schemes")
    iri = lambda p, o: F.struct(F.lit(p).alias("predicate"), F.lit("iri").alias("o_kind"), o.alias("o_value"), F.lit(None).cast("string").alias("o_lang"))
    text = lambda p, o, lang=None: F.struct(F.lit(p).alias("predicate"), F.lit("lit").alias("o_kind"), o.alias("o_value"), F.lit(lang).cast("string").alias("o_lang"))
    scheme_iri = F.concat(F.lit(base + "sch/"), home)
    klass = F.lit(None).cast("string")
    for k, v in V.CLASS.items():
        klass = F.when(c("kind") == k, F.lit(v)).otherwise(klass)
    is_scheme = c("kind") == "scheme"
    own = [
        iri(V.TYPE, klass),
        text(V.LABEL, c("label"), language),
        text(V.STATUS, F.lit("active")),
        text(V.SOURCE_REF, c("ref")),
        F.when(~is_scheme, iri(V.IN_SCHEME, scheme_iri)),
        F.when(is_scheme, text(V.SCHEME_TYPE, F.when(glossary(c("slug")), "glossary").otherwise("taxonomy"))),
        F.when((c("kind") == "taxonomy-value") & c("broader").isNull(), iri(V.TOP, scheme_iri)),
    ]
    file = home_file(c("kind"), home, glossary(home))
    base_rows = named.select(file.alias("file"), c("iri").alias("subject"), F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("s")).select("file", "subject", "s.*")
    refs = references(named).select(file.alias("file"), c("iri").alias("subject"), "predicate", "to")
    found = refs.join(named.select(c("ref").alias("to"), c("iri").alias("o_value")).where("to IS NOT NULL"), "to")
    linked = found.select("file", "subject", "predicate", F.lit("iri").alias("o_kind"), "o_value", F.lit(None).cast("string").alias("o_lang"))
    return base_rows.unionByName(linked).withColumns({"o_type": F.lit(None).cast("string"), "defines": F.lit(True)})


def references(named: DataFrame) -> DataFrame:
    """One row per reference of an object: its own columns, predicate, to (a ref)."""
    c = F.col
    each = F.array(*[F.struct(F.lit(p).alias("predicate"), c(x).alias("to")) for p, x in ((V.BROADER, "broader"), (V.ATTRIBUTE_OF, "owner"), (V.SOURCE, "end_a"), (V.TARGET, "end_b"))])
    return named.withColumn("_r", F.explode(F.filter(each, lambda x: x["to"].isNotNull()))).select(*named.columns, "_r.predicate", "_r.to")


def dangling(named: DataFrame, present: DataFrame) -> DataFrame:
    """(iri, predicate, to): references to refs that ``present`` doesn't have."""
    return references(named).select("iri", "predicate", "to").join(present.select(F.col("ref").alias("to")).distinct(), "to", "left_anti").select("iri", "predicate", "to")


def shortcuts(quads: DataFrame) -> DataFrame:
    """One direct edge per pair of a relationship's ends, in the least file of those that state it."""
    ends = quads.where(F.col("predicate").isin(V.SOURCE, V.TARGET)).groupBy("file", "subject").agg(
        F.collect_set(F.when(F.col("predicate") == V.SOURCE, F.col("o_value"))).alias("a"), F.collect_set(F.when(F.col("predicate") == V.TARGET, F.col("o_value"))).alias("b")
    )
    pairs = ends.select("file", F.explode("a").alias("a"), "b").select("file", "a", F.explode("b").alias("b"))
    return pairs.groupBy(F.col("a").alias("subject"), F.col("b").alias("o_value")).agg(F.min("file").alias("file"))


SQL = f"""
quads AS MATERIALIZED (
  WITH o AS (SELECT *, CASE WHEN kind = 'relationship' THEN 'relationships-' WHEN list_min(schemes) <> 'part-type' THEN 'concepts-' ELSE 'taxonomy-' END || list_min(schemes) || '.ttl' AS file, '{{base}}sch/' || list_min(schemes) AS home FROM named),
  r AS (SELECT file, iri, '{V.BROADER}' AS p, broader AS t FROM o UNION ALL SELECT file, iri, '{V.ATTRIBUTE_OF}', owner FROM o UNION ALL SELECT file, iri, '{V.SOURCE}', end_a FROM o UNION ALL SELECT file, iri, '{V.TARGET}', end_b FROM o)
  SELECT file, iri AS subject, '{V.TYPE}' AS predicate, 'iri' AS o_kind, CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CLASS.items())} END AS o_value, NULL::VARCHAR AS o_lang FROM o
  UNION ALL SELECT file, iri, '{V.LABEL}', 'lit', label, 'en' FROM o
  UNION ALL SELECT file, iri, '{V.STATUS}', 'lit', 'active', NULL FROM o
  UNION ALL SELECT file, iri, '{V.SOURCE_REF}', 'lit', ref, NULL FROM o
  UNION ALL SELECT file, iri, '{V.IN_SCHEME}', 'iri', home, NULL FROM o WHERE kind <> 'scheme'
  UNION ALL SELECT file, iri, '{V.SCHEME_TYPE}', 'lit', CASE WHEN slug <> 'part-type' THEN 'glossary' ELSE 'taxonomy' END, NULL FROM o WHERE kind = 'scheme'
  UNION ALL SELECT file, iri, '{V.TOP}', 'iri', home, NULL FROM o WHERE kind = 'taxonomy-value' AND broader IS NULL
  UNION ALL SELECT r.file, r.iri, p, 'iri', n.iri, NULL FROM r JOIN named n ON r.t = n.ref)"""
