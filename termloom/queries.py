"""Named queries over the driver's tables, each with the SQL that states the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocabulary as V
from .bindings import BASE, NAMED, OBJ, QUADS, named, objects, quads, sql_uuid5, statements, table
from .functions import ids, text, turtle
from .plans import assemble, identity, lifecycle, resolve, snapshot
from .plans.components import components, stored
from .rules import compiler

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- text -------------------------------------------------------------------------------------------------------------------
_SPACES = "||".join(f"chr({ord(x)})" for x in text.SPACES)
_REMOVED = "||".join(f"chr({ord(x)})" for x in text.REMOVED)
_TR = f"translate(nfc_normalize(%s), {_SPACES} || {_REMOVED}, repeat(' ', {len(text.SPACES)}))"
_NORM = f"regexp_replace({_TR}, '^[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{{85}}]+|[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{{85}}]+$', '', 'g')"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(lit("\u00a0 "), "text", lit("\u200b e\u0301\u2003 "))
    return table(spark, d, "documents").select("doc_id", "source", raw.alias("raw"))


_RAW = "chr(160) || ' ' || text || chr(8203) || ' e' || chr(769) || chr(8195) || ' '"


@query(f"SELECT doc_id, length(n)::INT AS n_chars, md5(n) AS digest FROM (SELECT doc_id, {_NORM % _RAW} AS n FROM documents)")
def norm_text(spark, d):
    n = _dirty(spark, d).select("doc_id", text.normalize(c("raw")).alias("n"))
    return n.select("doc_id", F.length("n").alias("n_chars"), F.md5("n").alias("digest"))


@query(f"SELECT source, count(*) AS n, sum((nfc <> raw)::INT)::BIGINT AS changed FROM (SELECT source, text AS raw, {_TR % 'text'} AS nfc FROM documents) GROUP BY source")
def norm_count_by_source(spark, d):
    t = table(spark, d, "documents").select("source", "text", text.translated(c("text")).alias("nfc"))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.sum((c("nfc") != c("text")).cast("bigint")).alias("changed"))


@query("SELECT p_partkey, regexp_full_match(lower(p_name), '[a-z0-9]+([-_][a-z0-9]+)*') AS as_is, regexp_full_match(replace(lower(p_name), ' ', '-'), '[a-z0-9]+([-_][a-z0-9]+)*') AS joined FROM part")
def slug_check(spark, d):
    return table(spark, d, "part").select("p_partkey", text.is_slug(F.lower("p_name")).alias("as_is"), text.is_slug(F.replace(F.lower("p_name"), lit(" "), lit("-"))).alias("joined"))


_TAG = "lang || CASE WHEN doc_id % 3 = 0 THEN '-x1' WHEN doc_id % 3 = 1 THEN '_XX' ELSE '' END"


@query(f"SELECT doc_id, {_TAG} AS tag, regexp_full_match({_TAG}, '[A-Za-z]{{2,3}}(-[A-Za-z0-9]{{1,8}})*') AS ok FROM documents")
def lang_tag_check(spark, d):
    tag = F.concat("lang", F.when(c("doc_id") % 3 == 0, "-x1").when(c("doc_id") % 3 == 1, "_XX").otherwise(""))
    return table(spark, d, "documents").select("doc_id", tag.alias("tag"), text.is_language_tag(tag).alias("ok"))


_H = "md5(c_custkey::VARCHAR)"
_UU = f"CASE WHEN c_custkey % 2 = 0 THEN upper(u) WHEN c_custkey % 3 = 0 THEN u || 'x' ELSE u END"


@query(f"SELECT c_custkey, CASE WHEN regexp_full_match(k, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN lower(k) END AS uuid FROM (SELECT c_custkey, {_UU} AS k FROM (SELECT c_custkey, substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-' || substr({_H}, 13, 4) || '-' || substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12) AS u FROM customer))")
def uuid_recognise(spark, d):
    h = F.md5(c("c_custkey").cast("string"))
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    k = F.when(c("c_custkey") % 2 == 0, F.upper(u)).when(c("c_custkey") % 3 == 0, F.concat(u, lit("x"))).otherwise(u)
    return table(spark, d, "customer").select("c_custkey", ids.as_uuid(k).alias("uuid"))


@query("SELECT part, count(*) AS n FROM (SELECT unnest([trim(x) for x in string_split(replace(lower(text), chr(10), ','), ',')]) AS part FROM documents) WHERE part <> '' GROUP BY part")
def synonym_split(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.filter(F.transform(F.split(F.replace(F.lower("text"), lit("\n"), lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("part"))
    return t.groupBy("part").agg(F.count("*").alias("n"))


@query()
def quote_aware_split(spark, d):
    cell = F.concat("text", lit('; "a; b"@en ; c;"open; end'))
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.quoted_split(cell)).alias("place", "part")).select("doc_id", "place", F.md5("part").alias("digest"), text.tagged(c("part"))["language"].alias("language"))


@query("SELECT event_id, event_type, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


_CTRL = "chr(92) || chr(34) || chr(10) || chr(13) || chr(9) || chr(8) || chr(12) || chr(1) || chr(127) || text"
_ESC = "replace(replace(replace(replace(replace(replace(replace(%s, chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)), chr(10), chr(92)||'n'), chr(13), chr(92)||'r'), chr(9), chr(92)||'t'), chr(8), chr(92)||'b'), chr(12), chr(92)||'f')"


@query(f"SELECT doc_id, md5(replace(replace({_ESC % ('(' + _CTRL + ')')}, chr(1), chr(92)||'u0001'), chr(127), chr(92)||'u007F')) AS digest FROM documents")
def escape_literal(spark, d):
    raw = F.concat(lit('\\"\n\r\t\b\f\x01\x7f'), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(turtle.escape(raw)).alias("digest"))


# ---- identity ---------------------------------------------------------------------------------------------------------------
@query(OBJ + f" SELECT key, '{BASE}c/' || {sql_uuid5(chr(39) + 'crm:' + chr(39) + ' || key')} AS iri FROM obj WHERE kind = 'entity' AND source = 'crm'")
def mint_entity(spark, d):
    return named(objects(spark, d).where("kind = 'entity' AND source = 'crm'")).select("key", "iri")


@query(OBJ + f" SELECT key, '{BASE}v/' || {sql_uuid5(chr(39) + 'part-type|' + chr(39) + ' || key')} AS iri FROM obj WHERE kind = 'taxonomy-value'")
def mint_taxonomy(spark, d):
    return named(objects(spark, d).where("kind = 'taxonomy-value'")).select("key", "iri")


@query(NAMED + " SELECT kind, ref, iri FROM named")
def compose_iri(spark, d):
    return named(objects(spark, d)).select("kind", "ref", "iri")


@query(OBJ + " SELECT source, kind, count(*) AS n, min(source || ':' || key) AS least, max(source || ':' || key) AS greatest FROM obj GROUP BY ALL")
def source_ref_string(spark, d):
    ref = F.concat_ws(":", "source", "key")
    return objects(spark, d).groupBy("source", "kind").agg(F.count("*").alias("n"), F.min(ref).alias("least"), F.max(ref).alias("greatest"))


_MAPPED = " md5(ref) >= '3'"
_IDMAP = ", id_map AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ref, kind) AS row_no, iri, CASE WHEN md5(ref) > 'fe' THEN 'other' ELSE kind END AS kind, source, key FROM named WHERE" + _MAPPED + ")"


def _id_map(named_: DataFrame, *numbers: str) -> DataFrame:
    """A register that lacks some objects and has a wrong kind for a few; numbered for those who ask for ``row_no``."""
    n = named_.where(F.md5("ref") >= "3").withColumnRenamed("kind", "was")
    kind = F.when(F.md5("ref") > "fe", "other").otherwise(c("was"))
    if numbers:
        n = identity.placed(n, ["ref", "was"]).withColumnRenamed("place", "row_no")
    return n.select(*numbers, "iri", kind.alias("kind"), "source", "key")


@query(NAMED + _IDMAP + " SELECT n.ref, n.kind, n.iri, m.iri IS NULL AS minted FROM named n LEFT JOIN id_map m USING (source, key)")
def id_map_lookup(spark, d):
    n = named(objects(spark, d))
    return identity.resolve(n, _id_map(n)).select("ref", "kind", "iri", c("known").isNull().alias("minted"))


_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in V.RANK.items()) + " END"


@query(NAMED + _IDMAP + f" SELECT (SELECT max(row_no) FROM id_map) + row_number() OVER (ORDER BY {_RANK}, ref) AS row_no, iri, kind, source, key FROM named WHERE NOT" + _MAPPED)
def id_map_mint_append(spark, d):
    n = named(objects(spark, d))
    m = _id_map(n, "row_no")
    return identity.appended(identity.resolve(n, m), m)


@query(OBJ + f" SELECT iri, count(*) AS n FROM (SELECT '{BASE}v/' || {sql_uuid5(chr(39) + 'part-type|' + chr(39) + ' || split_part(key, ' + chr(39) + '#' + chr(39) + ', 1)')} AS iri FROM obj WHERE kind = 'taxonomy-value') GROUP BY iri HAVING count(*) > 1")
def iri_collision(spark, d):
    values = objects(spark, d).where("kind = 'taxonomy-value'").withColumn("key", F.split_part("key", lit("#"), lit(1)))
    return identity.collisions(named(values))


@query(NAMED + _IDMAP + " SELECT n.source, n.key, n.kind, m.kind AS recorded FROM named n JOIN id_map m USING (source, key) WHERE n.kind <> m.kind")
def kind_conflict(spark, d):
    n = named(objects(spark, d))
    return identity.kind_conflicts(n, _id_map(n))


@query(NAMED + _IDMAP + ", cur AS (SELECT source, key, CASE WHEN md5(key) < '1' THEN iri || 'x' ELSE iri END AS iri, kind FROM id_map WHERE md5(key) < 'e') SELECT b.source, b.key, CASE WHEN c.iri IS NULL THEN 'removed' ELSE 'edited' END AS change FROM id_map b LEFT JOIN cur c USING (source, key) WHERE c.iri IS NULL OR c.iri <> b.iri OR c.kind <> b.kind")
def append_only_diff(spark, d):
    base = _id_map(named(objects(spark, d)))
    now = base.where(F.md5("key") < "e").withColumn("iri", F.when(F.md5("key") < "1", F.concat("iri", lit("x"))).otherwise(c("iri")))
    return identity.append_only(base, now)


@query(NAMED + _IDMAP + " SELECT source, count(*) AS n FROM id_map WHERE source NOT IN ('geo', 'crm', 'catalog') GROUP BY source")
def unconfigured_source(spark, d):
    configured = spark.createDataFrame([(s,) for s in ("geo", "crm", "catalog")], "source string")
    return _id_map(named(objects(spark, d))).join(F.broadcast(configured), "source", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query(NAMED + _IDMAP + " SELECT DISTINCT iri AS subject FROM named WHERE iri NOT IN (SELECT iri FROM id_map)")
def unmapped_subject(spark, d):
    n = named(objects(spark, d))
    return statements(n).select("subject").distinct().join(_id_map(n).select(c("iri").alias("subject")), "subject", "left_anti")


@query(NAMED + f" SELECT iri, CASE WHEN iri LIKE '{BASE}v/%' THEN 'urn:moved:' || substr(iri, {len(BASE) + 1}) ELSE iri END AS moved FROM named")
def rebase_iri(spark, d):
    return named(objects(spark, d)).select("iri", F.when(F.startswith("iri", lit(BASE + "v/")), ids.rebase(c("iri"), BASE, "urn:moved:")).otherwise(c("iri")).alias("moved"))


# ---- merging ----------------------------------------------------------------------------------------------------------------
_RECORDS = """WITH rec AS (SELECT o_custkey AS grp, [o_orderpriority] AS labels, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""


@query(_RECORDS + " SELECT grp, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ';') AS labels FROM rec GROUP BY grp")
def merge_union_labels(spark, d):
    r = table(spark, d, "orders").select(c("o_custkey").alias("grp"), F.array("o_orderpriority").alias("labels"))
    return resolve.reconcile(r, ["grp"], [], ["labels"]).select("grp", F.array_join("labels", ";").alias("labels"))


@query(_RECORDS + " SELECT grp, max(status) AS status, count(DISTINCT status) > 1 AS conflict FROM rec GROUP BY grp")
def merge_scalar_conflict(spark, d):
    r = table(spark, d, "orders").select(c("o_custkey").alias("grp"), c("o_orderstatus").alias("status"))
    return resolve.reconcile(r, ["grp"], ["status"], []).select("grp", "status", (F.size("conflicts") > 0).alias("conflict"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - 1 AS b FROM part WHERE p_partkey % 7 <> 0 AND p_partkey > 1),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a FROM both_),
r(a, b) AS (SELECT a, a FROM n UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a)
SELECT a AS obj, min(b) AS grp FROM r GROUP BY a""")
def component_merge(spark, d):
    e = table(spark, d, "part").where("p_partkey % 7 <> 0 AND p_partkey > 1").select(c("p_partkey").alias("a"), (c("p_partkey") - 1).alias("b"))
    return components(e).select(c("node").alias("obj"), c("root").alias("grp"))


@query()  # recursive SQL takes the square of the longest component
def component_merge_whole(spark, d):
    """One chain of all parts, and a hub (0) of all customers (negative)."""
    e = table(spark, d, "part").where("p_partkey > 1").select(c("p_partkey").alias("a"), (c("p_partkey") - 1).alias("b"))
    hub = table(spark, d, "customer").select((-c("c_custkey")).alias("a"), lit(0).cast("bigint").alias("b"))
    return components(e.unionByName(hub)).select(c("node").alias("obj"), c("root").alias("grp"))


_REFS = "refs AS (SELECT c_custkey AS obj, 'a' AS source, (c_custkey // 3)::VARCHAR AS key FROM customer UNION ALL SELECT c_custkey, 'b', ((c_custkey + 1) // 5)::VARCHAR FROM customer WHERE c_custkey % 4 = 0)"


@query("WITH RECURSIVE " + _REFS + """, e AS (SELECT DISTINCT x.obj AS a, y.obj AS b FROM refs x JOIN refs y USING (source, key)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS obj, min(b) AS grp FROM r GROUP BY a)
SELECT grp, source, count(DISTINCT key) AS n FROM refs JOIN g USING (obj) GROUP BY ALL HAVING count(DISTINCT key) > 1""")
def merge_split_refs(spark, d):
    k = c("c_custkey")
    cust = table(spark, d, "customer")
    refs = cust.select(k.alias("obj"), lit("a").alias("source"), F.floor(k / 3).cast("string").alias("key")).unionByName(cust.where(k % 4 == 0).select(k.alias("obj"), lit("b").alias("source"), F.floor((k + 1) / 5).cast("string").alias("key")))
    return resolve.split_refs(refs, resolve.groups(refs))


# ---- statements -------------------------------------------------------------------------------------------------------------
@query(QUADS + " SELECT file, subject, predicate, o_kind, o_value, o_lang FROM quads")
def statement_rows(spark, d):
    return quads(spark, d).select("file", "subject", "predicate", "o_kind", "o_value", "o_lang")


@query(QUADS + f" SELECT file, count(DISTINCT subject) FILTER (WHERE predicate = '{V.LABEL}') AS subjects, count(*) AS statements FROM quads GROUP BY file")
def file_partition_counts(spark, d):
    q = quads(spark, d)
    return q.groupBy("file").agg(F.countDistinct(F.when(c("predicate") == V.LABEL, c("subject"))).alias("subjects"), F.count("*").alias("statements"))


@query(OBJ + " SELECT source || ':' || key AS ref, list_min(list_concat(schemes, ['zz'])) AS home FROM obj WHERE kind <> 'relationship'")
def home_scheme(spark, d):
    return objects(spark, d).where("kind <> 'relationship'").select(F.concat_ws(":", "source", "key").alias("ref"), F.array_min(F.concat("schemes", F.array(lit("zz")))).alias("home"))


@query(QUADS + f" SELECT a.o_value AS subject, b.o_value, min(a.file) AS file FROM quads a JOIN quads b ON a.subject = b.subject AND a.file = b.file WHERE a.predicate = '{V.SOURCE}' AND b.predicate = '{V.TARGET}' GROUP BY a.o_value, b.o_value")
def shortcut_pairs(spark, d):
    return assemble.shortcuts(quads(spark, d))


@query(NAMED + f", r AS (SELECT iri, '{V.BROADER}' AS predicate, broader AS t FROM named UNION ALL SELECT iri, '{V.ATTRIBUTE_OF}', owner FROM named UNION ALL SELECT iri, '{V.SOURCE}', end_a FROM named UNION ALL SELECT iri, '{V.TARGET}', end_b FROM named) SELECT iri, predicate, t AS \"to\" FROM r WHERE t IS NOT NULL AND t NOT IN (SELECT ref FROM named WHERE md5(ref) >= '1')")
def dangling_reference(spark, d):
    n = named(objects(spark, d))
    return assemble.dangling(n, n.where(F.md5("ref") >= "1"))


_TWICE = QUADS + ", twice AS (SELECT * FROM quads UNION ALL SELECT 'extra.ttl', subject, predicate, o_kind, o_value, o_lang FROM quads WHERE md5(subject) < '0f')"


@query(_TWICE + " SELECT subject, predicate, o_value, min(file) AS first_file, count(DISTINCT file) AS files FROM twice GROUP BY subject, predicate, o_value HAVING count(DISTINCT file) > 1")
def duplicate_statement(spark, d):
    files = F.when(F.md5("subject") < "0f", F.array("file", lit("extra.ttl"))).otherwise(F.array("file"))
    twice = quads(spark, d).select("subject", "predicate", "o_value", F.explode(files).alias("file"))
    each = twice.repartition("subject").distinct()  # the count needs no exchange of its own then
    return each.groupBy("subject", "predicate", "o_value").agg(F.min("file").alias("first_file"), F.count("file").alias("files")).where("files > 1")


@query(OBJ + " SELECT source || ':' || key AS ref, schemes[1] AS scheme FROM obj WHERE kind <> 'scheme' AND schemes[1] NOT IN (SELECT slug FROM obj WHERE kind = 'scheme' AND slug <> 'region-2')")
def membership_check(spark, d):
    o = objects(spark, d)
    known = o.where("kind = 'scheme' AND slug <> 'region-2'").select(c("slug").alias("scheme"))
    return o.where("kind <> 'scheme'").select(F.concat_ws(":", "source", "key").alias("ref"), F.explode("schemes").alias("scheme")).join(known, "scheme", "left_anti").select("ref", "scheme")


_ABBR = "CASE " + " ".join(f"WHEN starts_with(x, '{ns}') AND regexp_full_match(substr(x, {len(ns) + 1}), '[A-Za-z0-9_]([A-Za-z0-9_.-]*[A-Za-z0-9_-])?') THEN '{p}:' || substr(x, {len(ns) + 1})" for p, ns in sorted(V.prefixes(BASE).items(), key=lambda i: -len(i[1]))) + " ELSE '<' || x || '>' END"


@query(QUADS + f" SELECT x AS iri, {_ABBR} AS short FROM (SELECT predicate AS x FROM quads UNION SELECT subject FROM quads UNION SELECT subject || '/a b' FROM quads)")
def abbreviate_iri(spark, d):
    x = quads(spark, d).select(F.explode(F.array("predicate", "subject", F.concat("subject", lit("/a b")))).alias("iri")).distinct()
    return x.select("iri", turtle.abbreviate(c("iri"), BASE).alias("short"))


_HEAD = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in V.prefixes(BASE).items()).replace("'", "''")
_TERM = f"CASE WHEN o_kind = 'iri' THEN {_ABBR.replace('(x,', '(o_value,').replace('substr(x', 'substr(o_value').replace('|| x ||', '|| o_value ||')} ELSE chr(34) || {_ESC % 'o_value'} || chr(34) || coalesce('@' || o_lang, '') END"
_PRED = f"CASE WHEN predicate = '{V.TYPE}' THEN 'a' ELSE {_ABBR.replace('(x,', '(predicate,').replace('substr(x', 'substr(predicate').replace('|| x ||', '|| predicate ||')} END"
_SUBJ = _ABBR.replace("(x,", "(subject,").replace("substr(x", "substr(subject").replace("|| x ||", "|| subject ||")
_FILES = QUADS + f""", t AS (SELECT DISTINCT file, subject, predicate, o_kind, o_value, o_lang, {_PRED} || ' ' || {_TERM} AS s, CASE predicate WHEN '{V.TYPE}' THEN 0 WHEN '{V.LABEL}' THEN 1 ELSE 2 END AS r FROM quads),
b AS (SELECT file, subject, {_SUBJ} || ' ' || string_agg(s, ' ;' || chr(10) || '  ' ORDER BY r, predicate, CASE o_kind WHEN 'iri' THEN 0 ELSE 1 END, o_value, coalesce(o_lang, '')) || ' .' AS block FROM t GROUP BY file, subject),
f AS (SELECT file, '{_HEAD}' || string_agg(chr(10) || block || chr(10), '' ORDER BY subject) AS text FROM b GROUP BY file)"""


@query(_FILES + " SELECT file, 'sha256:' || sha256(text) AS digest, length(text)::INT AS n_chars FROM f")
def file_digest(spark, d):
    return turtle.digests(quads(spark, d), BASE).select("file", F.concat(lit("sha256:"), "digest").alias("digest"), c("n_chars").cast("int").alias("n_chars"))


@query(_FILES + " SELECT file, text FROM f WHERE file LIKE 'concepts%'")
def canonical_turtle(spark, d):
    return turtle.files(quads(spark, d).where(F.startswith("file", lit("concepts"))), BASE)


# ---- level sheets -----------------------------------------------------------------------------------------------------------
_PATHS = "WITH p AS (SELECT p_partkey AS row_no, [p_type, p_brand, p_name] AS path FROM part UNION ALL SELECT 0, [p_type] FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 0, [p_type, p_brand] FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_partkey % 13 <> 0))"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return (
        p.select(c("p_partkey").alias("row_no"), F.array("p_type", "p_brand", "p_name").alias("path"))
        .unionByName(p.select("p_type").distinct().select(lit(0).cast("bigint").alias("row_no"), F.array("p_type").alias("path")))
        .unionByName(p.where("p_partkey % 13 <> 0").select("p_type", "p_brand").distinct().select(lit(0).cast("bigint").alias("row_no"), F.array("p_type", "p_brand").alias("path")))
    )


@query(_PATHS + " SELECT array_to_string(a.path, '/') AS path, array_to_string(b.path, '/') AS parent FROM (SELECT DISTINCT path FROM p) a JOIN (SELECT DISTINCT path FROM p) b ON a.path[1 : len(a.path) - 1] = b.path")
def ragged_parent(spark, d):
    p = _paths(spark, d).select("path").distinct()
    up = p.select("path", F.expr("slice(path, 1, size(path) - 1)").alias("up"))
    return up.join(p.select(c("path").alias("up")), "up").select(F.array_join("path", "/").alias("path"), F.array_join("up", "/").alias("parent"))


@query(_PATHS + " SELECT DISTINCT array_to_string(path, '/') AS path FROM p WHERE len(path) > 1 AND array_to_string(path[1 : len(path) - 1], '/') NOT IN (SELECT array_to_string(path, '/') FROM p)")
def ragged_orphan(spark, d):
    p = _paths(spark, d).select("path").distinct()
    up = p.where("size(path) > 1").select("path", F.expr("slice(path, 1, size(path) - 1)").alias("up"))
    return up.join(p.select(c("path").alias("up")), "up", "left_anti").select(F.array_join("path", "/").alias("path"))


@query("SELECT p_partkey, first_row FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type, p_brand, p_name) AS first_row FROM part) WHERE p_partkey > first_row")
def ragged_duplicate_path(spark, d):
    p = table(spark, d, "part").withColumn("first_row", F.min("p_partkey").over(Window.partitionBy("p_type", "p_brand", "p_name")))
    return p.where("p_partkey > first_row").select("p_partkey", "first_row")


@query("SELECT p_partkey FROM part WHERE p_partkey % 9 = 0")
def skipped_level(spark, d):
    blank = F.when(c("p_partkey") % 9 == 0, "").otherwise(c("p_brand"))
    rows = table(spark, d, "part").select("p_partkey", F.array("p_type", blank, "p_name").alias("levels"))
    # the last filled level must be as deep as there are filled levels
    filled = F.filter("levels", lambda x: x != "")
    deepest = F.array_max(F.transform("levels", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return rows.where(deepest != F.size(filled)).select("p_partkey")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type WHEN event_id % 8 = 0 THEN 'alt' END AS verb FROM events")
def verb_label_choice(spark, d):
    name = F.when(c("event_id") % 4 != 0, c("event_type"))
    labels = F.array(F.struct(lit("back").alias("name"), lit("SOURCE").alias("dir")), F.struct(lit("alt").alias("name"), F.when(c("event_id") % 8 == 0, "target").otherwise("Source").alias("dir")))
    first = F.get(F.filter(labels, lambda x: F.lower(x["dir"]) != "source"), lit(0))["name"]
    return table(spark, d, "events").select("event_id", F.coalesce(name, first).alias("verb"))


@query("SELECT route, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' OR l_linestatus = 'O' THEN 'inheritance' ELSE 'edge' END AS route FROM lineitem) GROUP BY route")
def inheritance_route(spark, d):
    inherits = (c("l_returnflag") == "A") | (c("l_linestatus") == "O")
    return table(spark, d, "lineitem").groupBy(F.when(inherits, "inheritance").otherwise("edge").alias("route")).agg(F.count("*").alias("n"))


# ---- snapshots --------------------------------------------------------------------------------------------------------------
_SNAP = f"""WITH st AS (SELECT event_id, 'event:' || event_id AS subject, unnest(['type', 'user', 'props']) AS predicate, unnest([event_type, user_id::VARCHAR, props]) AS o_value FROM events),
prev AS (SELECT * FROM st WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, 'event:' || event_id, '{V.MODIFIED}', '2024-02-01' FROM events WHERE event_id % 10 <> 0 AND event_id % 3 <> 0),
cur AS (SELECT event_id, subject, predicate, CASE WHEN predicate = 'props' AND event_id % 11 = 0 THEN o_value || '!' ELSE o_value END AS o_value FROM st WHERE event_id % 7 <> 0)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("event_id", "event_type", c("user_id").cast("string").alias("user"), "props")

    def rows(df: DataFrame) -> DataFrame:
        s = F.array(*[F.struct(lit(p).alias("predicate"), c(x).alias("o_value")) for p, x in (("type", "event_type"), ("user", "user"), ("props", "props"))])
        return df.select(F.concat(lit("event:"), c("event_id").cast("string")).alias("subject"), F.explode(s).alias("s")).select("subject", "s.*")

    old = e.where("event_id % 10 <> 0")
    dates = old.where("event_id % 3 <> 0").select(F.concat(lit("event:"), c("event_id").cast("string")).alias("subject"), lit(V.MODIFIED).alias("predicate"), lit("2024-02-01").alias("o_value"))
    now = e.where("event_id % 7 <> 0").withColumn("props", F.when(c("event_id") % 11 == 0, F.concat("props", lit("!"))).otherwise(c("props")))
    return rows(now), rows(old).unionByName(dates)


@query(_SNAP + " SELECT DISTINCT subject FROM cur WHERE subject NOT IN (SELECT subject FROM prev)")
def snapshot_new(spark, d):
    return snapshot.new(*_snapshots(spark, d))


@query(_SNAP + " SELECT DISTINCT subject FROM prev WHERE subject NOT IN (SELECT subject FROM cur)")
def snapshot_gone(spark, d):
    return snapshot.gone(*_snapshots(spark, d))


_SETS = _SNAP + f", a AS (SELECT subject, list_sort(list(predicate || '=' || o_value)) AS s FROM cur GROUP BY subject), b AS (SELECT subject, list_sort(list(predicate || '=' || o_value) FILTER (WHERE predicate <> '{V.MODIFIED}')) AS s, max(o_value) FILTER (WHERE predicate = '{V.MODIFIED}') AS d FROM prev GROUP BY subject)"


@query(_SETS + " SELECT a.subject FROM a JOIN b USING (subject) WHERE a.s <> b.s")
def snapshot_changed(spark, d):
    return snapshot.changed(*_snapshots(spark, d))


@query(_SETS + " SELECT a.subject, CASE WHEN a.s = b.s AND b.d IS NOT NULL THEN b.d ELSE '2024-03-01' END AS modified FROM a LEFT JOIN b USING (subject)")
def modified_carry_forward(spark, d):
    return snapshot.dated(*_snapshots(spark, d), "2024-03-01")


_TERMS = _SNAP + """, tag AS (SELECT *, 'lit' AS o_kind, CASE WHEN predicate = 'type' THEN 'en' END AS o_lang, CASE WHEN predicate = 'user' THEN 'urn:integer' END AS o_type FROM prev),
now AS (SELECT subject, predicate, o_value, o_kind, CASE WHEN o_lang IS NOT NULL AND event_id % 13 = 0 THEN 'fr' ELSE o_lang END AS o_lang, CASE WHEN o_type IS NOT NULL AND event_id % 17 = 0 THEN 'urn:long' ELSE o_type END AS o_type FROM tag),
a AS (SELECT subject, list_sort(list(concat_ws('|', predicate, o_value, o_kind, coalesce(o_lang, ''), coalesce(o_type, '')))) AS s FROM now WHERE predicate <> '%s' GROUP BY subject),
b AS (SELECT subject, list_sort(list(concat_ws('|', predicate, o_value, o_kind, coalesce(o_lang, ''), coalesce(o_type, ''))) FILTER (WHERE predicate <> '%s')) AS s, max(o_value) FILTER (WHERE predicate = '%s') AS d FROM tag GROUP BY subject)""".replace("%s", V.MODIFIED)


def _tagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot with languages and datatypes, and one in which nothing but some of these is other."""
    old = _snapshots(spark, d)[1].withColumns({"o_kind": lit("lit"), "o_lang": F.when(c("predicate") == "type", "en"), "o_type": F.when(c("predicate") == "user", "urn:integer")})
    n = F.split_part("subject", lit(":"), lit(2)).cast("bigint")
    now = old.withColumns({"o_lang": F.when(c("o_lang").isNotNull() & (n % 13 == 0), "fr").otherwise(c("o_lang")), "o_type": F.when(c("o_type").isNotNull() & (n % 17 == 0), "urn:long").otherwise(c("o_type"))})
    return now, old


@query(_TERMS + " SELECT a.subject FROM a JOIN b USING (subject) WHERE a.s <> b.s")
def snapshot_changed_terms(spark, d):
    return snapshot.changed(*_tagged(spark, d))


@query(_TERMS + " SELECT a.subject, CASE WHEN a.s = b.s AND b.d IS NOT NULL THEN b.d ELSE '2024-03-01' END AS modified FROM a LEFT JOIN b USING (subject)")
def modified_terms(spark, d):
    return snapshot.dated(*_tagged(spark, d), "2024-03-01")


_LIFE = QUADS + _IDMAP + """, live AS (SELECT iri FROM named WHERE md5(iri) >= '4' AND source <> 'erp'), gone AS (SELECT DISTINCT subject FROM quads WHERE subject NOT IN (SELECT iri FROM live)),
fate AS (SELECT subject, CASE WHEN bool_and(source IN ('geo', 'crm', 'catalog')) IS NULL THEN 'unmapped' WHEN bool_and(source IN ('geo', 'crm', 'catalog')) THEN 'deprecate' ELSE 'keep' END AS fate FROM gone LEFT JOIN id_map ON subject = iri GROUP BY subject)"""


def _fates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = named(objects(spark, d))
    q = statements(n)
    live = n.where((F.md5("iri") >= "4") & (c("source") != "erp")).select("iri")
    return n, q, lifecycle.divide(q, live, _id_map(n), ["geo", "crm", "catalog"])


@query(_LIFE + " SELECT subject, fate FROM fate")
def scope_division(spark, d):
    return _fates(spark, d)[2]


@query(_LIFE + f", m AS (SELECT iri AS old, 'urn:new:' || substr(md5(iri), 1, 8) AS new FROM named WHERE md5(iri) < '2') SELECT file, q.subject, predicate, o_kind, o_value, o_lang FROM quads q JOIN fate f ON q.subject = f.subject AND fate = 'deprecate' WHERE predicate <> '{V.STATUS}' UNION ALL SELECT DISTINCT file, q.subject, '{V.STATUS}', 'lit', 'deprecated', NULL FROM quads q JOIN fate f ON q.subject = f.subject AND fate = 'deprecate' UNION ALL SELECT DISTINCT file, q.subject, '{V.REPLACED_BY}', 'iri', new, NULL FROM quads q JOIN fate f ON q.subject = f.subject AND fate = 'deprecate' JOIN m ON old = q.subject")
def deprecate_rows(spark, d):
    n, q, fate = _fates(spark, d)
    merges = n.where(F.md5("iri") < "2").select(c("iri").alias("deprecated_iri"), F.concat(lit("urn:new:"), F.substring(F.md5("iri"), 1, 8)).alias("replaced_by_iri"))
    return lifecycle.deprecated(q, fate.where("fate = 'deprecate'"), merges)


@query(_LIFE + " SELECT file, q.subject, predicate, o_kind, o_value, o_lang FROM quads q JOIN fate f ON q.subject = f.subject AND fate = 'keep'")
def carry_verbatim(spark, d):
    _, q, fate = _fates(spark, d)
    return lifecycle.verbatim(q, fate.where("fate = 'keep'"))


_MERGES = "WITH m AS (SELECT s_suppkey AS a, (s_suppkey * s_suppkey + 1) % (SELECT count(*) FROM supplier) AS b FROM supplier WHERE s_suppkey % 3 <> 0)"


def _merges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.crossJoin(F.broadcast(s.agg(F.count("*").alias("n")))).where("s_suppkey % 3 <> 0").select(c("s_suppkey").alias("a"), ((c("s_suppkey") * c("s_suppkey") + 1) % c("n")).alias("b"))


@query(_MERGES + " SELECT DISTINCT x AS iri FROM (SELECT a AS x FROM m UNION SELECT b FROM m) WHERE x NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)")
def merge_register_unknown(spark, d):
    m = _merges(spark, d).select(F.explode(F.array("a", "b")).alias("iri")).distinct()
    return m.join(table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(c("s_suppkey").alias("iri")), "iri", "left_anti")


_CYC = "r(a, b) AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a)"


@query(_MERGES.replace("WITH", "WITH RECURSIVE") + f", {_CYC} SELECT a AS iri FROM r WHERE a = b")
def merge_register_cycle(spark, d):
    from .plans.components import cyclic

    return cyclic(_merges(spark, d).select(c("a").alias("child"), c("b").alias("parent"))).select(c("node").alias("iri"))


@query(_FILES + ", rec AS (SELECT file, sha256(text) AS digest FROM f WHERE file NOT LIKE '%1.ttl' UNION ALL SELECT 'lost.ttl', 'x'), now AS (SELECT file, CASE WHEN file LIKE 'taxonomy%' THEN 'y' ELSE sha256(text) END AS digest FROM f) SELECT coalesce(rec.file, now.file) AS file, CASE WHEN rec.file IS NULL THEN 'unrecorded' WHEN now.file IS NULL THEN 'missing' ELSE 'changed' END AS finding FROM rec FULL JOIN now ON rec.file = now.file WHERE rec.digest IS DISTINCT FROM now.digest")
def manifest_diff(spark, d):
    f = stored(turtle.digests(quads(spark, d), BASE).select("file", "digest"))
    rec = f.where("file NOT LIKE '%1.ttl'").union(spark.createDataFrame([("lost.ttl", "x")], "file string, digest string")).withColumnRenamed("digest", "was")
    now = f.withColumn("digest", F.when(F.startswith("file", lit("taxonomy")), "y").otherwise(c("digest")))
    finding = F.when(c("was").isNull(), "unrecorded").when(c("digest").isNull(), "missing").otherwise("changed")
    return rec.join(now, "file", "full").where("NOT (was <=> digest)").select("file", finding.alias("finding"))


# ---- rules ------------------------------------------------------------------------------------------------------------------
_BAD = QUADS + f""", bad AS MATERIALIZED (
  SELECT file, CASE WHEN md5(subject) > 'f8' THEN 'urn:stray:' || md5(subject) ELSE subject END AS subject, predicate, o_kind,
    CASE WHEN predicate = '{V.IN_SCHEME}' AND md5(subject) LIKE '3%' THEN '{BASE}sch/none' WHEN predicate = '{V.STATUS}' AND md5(subject) LIKE '5%' THEN 'odd' WHEN predicate = '{V.STATUS}' AND md5(subject) LIKE '6%' THEN 'deprecated' ELSE o_value END AS o_value,
    CASE WHEN predicate = '{V.LABEL}' AND md5(subject) LIKE '1%' THEN NULL ELSE o_lang END AS o_lang
  FROM quads WHERE NOT (predicate = '{V.STATUS}' AND md5(subject) LIKE '0%') AND NOT (predicate IN ('{V.ATTRIBUTE_OF}', '{V.SOURCE}') AND md5(subject) LIKE '4%')
  UNION ALL SELECT file, subject, predicate, o_kind, o_value || ' again', o_lang FROM quads WHERE predicate = '{V.LABEL}' AND md5(subject) LIKE '2%'
  UNION ALL SELECT file, subject, '{V.NOTATION}', 'lit', substr(md5(subject), 1, 3), CASE WHEN md5(subject) LIKE '7%' THEN 'en' END FROM quads WHERE predicate = '{V.TYPE}' AND o_value = '{V.CLASS["taxonomy-value"]}')"""


def _bad(spark: SparkSession, d: str) -> DataFrame:
    """Statements with faults dealt by the digest of their subject."""
    q = quads(spark, d).select("file", "subject", "predicate", "o_kind", "o_value", "o_lang")
    h = F.md5("subject")
    starts = lambda x: F.startswith(h, lit(x))
    is_ = lambda *p: c("predicate").isin(*p)
    row = lambda subject, predicate, kind, value, lang: F.struct(subject.alias("subject"), predicate.alias("predicate"), kind.alias("o_kind"), value.alias("o_value"), lang.alias("o_lang"))
    base = F.when(
        ~(is_(V.STATUS) & starts("0")) & ~(is_(V.ATTRIBUTE_OF, V.SOURCE) & starts("4")),
        row(
            F.when(h > "f8", F.concat(lit("urn:stray:"), h)).otherwise(c("subject")), c("predicate"), c("o_kind"),
            F.when(is_(V.IN_SCHEME) & starts("3"), BASE + "sch/none").when(is_(V.STATUS) & starts("5"), "odd").when(is_(V.STATUS) & starts("6"), "deprecated").otherwise(c("o_value")),
            F.when(is_(V.LABEL) & starts("1"), None).otherwise(c("o_lang")),
        ),
    )
    again = F.when(is_(V.LABEL) & starts("2"), row(c("subject"), c("predicate"), c("o_kind"), F.concat("o_value", lit(" again")), c("o_lang")))
    notation = F.when(is_(V.TYPE) & (c("o_value") == V.CLASS["taxonomy-value"]), row(c("subject"), lit(V.NOTATION), lit("lit"), F.substring(h, 1, 3), F.when(starts("7"), "en")))
    return q.select("file", F.inline(F.array_compact(F.array(base, again, notation))))


def _rule_sql(r: compiler.Rule) -> str:
    targets = ", ".join(f"'{t}'" for t in r.targets)
    focus = f"SELECT DISTINCT subject FROM bad WHERE predicate = '{V.TYPE}' AND o_value IN ({targets})"
    vals = f"(SELECT DISTINCT subject, o_kind, o_value, o_lang FROM bad WHERE predicate = '{r.path}')"
    if r.component == "class":
        return f"SELECT DISTINCT '{r.name}' AS rule, '{r.severity}' AS severity, f.subject FROM ({focus}) f JOIN {vals} v USING (subject) WHERE v.o_value NOT IN (SELECT subject FROM bad WHERE predicate = '{V.TYPE}' AND o_value = '{r.value}')"
    having = {
        "minCount": f"count(v.o_value) < {r.value}", "maxCount": f"count(v.o_value) > {r.value}", "none": "count(v.o_value) > 0",
        "unique_lang": "count(v.o_value) > count(DISTINCT CASE WHEN v.o_value IS NOT NULL THEN coalesce(v.o_lang, '') END)",
        "lang": "count(v.o_value) > count(v.o_lang)", "plain": "count(v.o_lang) + count(*) FILTER (WHERE v.o_kind = 'iri') > 0",
        "in": f"count(v.o_value) FILTER (WHERE v.o_value NOT IN ({', '.join(repr(x) for x in r.value or ())})) > 0" if r.component == "in" else "",
    }[r.component]
    return f"SELECT '{r.name}' AS rule, '{r.severity}' AS severity, f.subject FROM ({focus}) f LEFT JOIN {vals} v USING (subject) GROUP BY f.subject HAVING {having}"


def _rules(*names: str) -> list[compiler.Rule]:
    return [r for r in compiler.CATALOG if r.name.startswith(names)]


def _rule_query(name: str, *prefixes: str) -> None:
    rules = _rules(*prefixes)
    QUERIES[name] = lambda spark, d: compiler.evaluate(_bad(spark, d), rules)
    SQL[name] = _BAD + " " + " UNION ALL ".join(map(_rule_sql, rules))


for _name, _own in {
    "rule_label": ("label",), "rule_status": ("status",), "rule_scheme": ("scheme-missing", "scheme-undeclared"), "rule_definition": ("definition",), "rule_owner": ("owner",),
    "rule_ends": ("source-", "target-"), "rule_scheme_type": ("scheme-type", "enumerates"), "rule_broader": ("broader",), "rule_notation_plain": ("notation",),
}.items():
    _rule_query(_name, *_own)


@query(_BAD + " " + " UNION ALL ".join(f"SELECT rule, severity, count(*) AS n FROM ({_rule_sql(r)}) GROUP BY ALL" for r in compiler.CATALOG))
def rule_catalogue_counts(spark, d):
    return compiler.evaluate(_bad(spark, d)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE m AS (SELECT p_partkey AS a, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS b FROM part), " + _CYC + " SELECT 'urn:p:' || a AS subject FROM r WHERE a = b")
def rule_cycle(spark, d):
    p = table(spark, d, "part")
    up = (c("p_partkey") * c("p_partkey") + 1) % c("n")
    e = p.crossJoin(F.broadcast(p.agg(F.count("*").alias("n")))).select(F.concat(lit("urn:p:"), c("p_partkey").cast("string")).alias("subject"), lit(V.BROADER).alias("predicate"), F.concat(lit("urn:p:"), up.cast("string")).alias("o_value"))
    return compiler.cycles(e)


@query(_BAD + f", n AS (SELECT DISTINCT x.subject, x.o_value AS notation, s.o_value AS scheme FROM bad x JOIN bad s ON x.subject = s.subject WHERE x.predicate = '{V.NOTATION}' AND s.predicate = '{V.IN_SCHEME}') SELECT scheme, notation, subject FROM n WHERE (scheme, notation) IN (SELECT (scheme, notation) FROM n GROUP BY scheme, notation HAVING count(DISTINCT subject) > 1)")
def rule_notation(spark, d):
    return compiler.shared_notation(stored(_bad(spark, d)))


@query(_BAD + f", st AS (SELECT subject, o_value AS s FROM bad WHERE predicate = '{V.STATUS}') SELECT DISTINCT subject, o_value FROM bad WHERE predicate IN ('{V.BROADER}', '{V.ATTRIBUTE_OF}') AND subject IN (SELECT subject FROM st WHERE s = 'active') AND o_value IN (SELECT subject FROM st WHERE s = 'deprecated')")
def rule_deprecated_parent(spark, d):
    return compiler.deprecated_parents(stored(_bad(spark, d)))


@query(_BAD + f" SELECT DISTINCT subject FROM bad WHERE NOT starts_with(subject, '{BASE}')")
def namespace_violation(spark, d):
    return compiler.outside(_bad(spark, d), BASE)


@query(_BAD + f" SELECT DISTINCT subject, o_value AS type FROM bad WHERE predicate = '{V.TYPE}' AND NOT starts_with(subject, '{BASE}')")
def rule_iri_policy(spark, d):
    return compiler.iri_policy(_bad(spark, d), BASE)


# ---- reports ----------------------------------------------------------------------------------------------------------------
@query(QUADS + f" SELECT k AS class, count(q.subject) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in (*V.CLASS.values(), V.SEM + 'BusinessTerm'))}]) AS k) LEFT JOIN quads q ON q.predicate = '{V.TYPE}' AND q.o_value = k GROUP BY k")
def class_counts(spark, d):
    known = spark.createDataFrame([(x,) for x in (*V.CLASS.values(), V.SEM + "BusinessTerm")], "class string")
    n = quads(spark, d).where(c("predicate") == V.TYPE).groupBy(c("o_value").alias("class")).agg(F.count("*").alias("n"))
    return known.join(n, "class", "left").select("class", F.coalesce("n", lit(0)).alias("n"))


@query(QUADS + f" SELECT t.o_value AS class, lower(l.o_value) AS name, count(DISTINCT l.subject) AS n, min(l.o_value) AS label FROM quads l JOIN quads t ON l.subject = t.subject AND t.predicate = '{V.TYPE}' WHERE l.predicate = '{V.LABEL}' GROUP BY t.o_value, lower(l.o_value) HAVING count(DISTINCT l.subject) > 1")
def name_clash(spark, d):
    q = stored(quads(spark, d))
    labels = q.where(c("predicate") == V.LABEL).select("subject", c("o_value").alias("label"))
    both = labels.join(compiler.types(q), "subject")
    return both.groupBy(c("type").alias("class"), text.folded(c("label")).alias("name")).agg(F.countDistinct("subject").alias("n"), F.min("label").alias("label")).where("n > 1")


@query(_BAD + " SELECT rule, subject, place FROM (SELECT rule, subject, row_number() OVER (PARTITION BY rule ORDER BY subject) AS place FROM (" + " UNION ALL ".join(map(_rule_sql, _rules("label", "status"))) + ")) WHERE place <= 20")
def top_listing(spark, d):
    v = compiler.evaluate(_bad(spark, d), _rules("label", "status"))
    placed = v.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy("subject"))).where("place <= 20")
    return placed.select("rule", "subject", c("place").cast("bigint").alias("place"))


@query(_BAD + " SELECT row_number() OVER (ORDER BY subject, rule) AS place, subject, rule, severity FROM (" + " UNION ALL ".join(map(_rule_sql, _rules("owner", "source-"))) + ")")
def issue_order(spark, d):
    v = compiler.evaluate(_bad(spark, d), _rules("owner", "source-"))
    return identity.placed(v, ["subject", "rule"]).select("place", "subject", "rule", "severity")


@query(_SNAP + f", a AS (SELECT DISTINCT subject FROM cur), b AS (SELECT subject, max(o_value) FILTER (WHERE predicate = '{V.MODIFIED}') AS d FROM prev GROUP BY subject) SELECT coalesce(a.subject, b.subject) AS subject, CASE WHEN a.subject IS NULL THEN 'lost' WHEN b.subject IS NULL THEN 'invented' ELSE 'redated' END AS finding FROM a FULL JOIN b ON a.subject = b.subject WHERE a.subject IS NULL OR b.subject IS NULL OR b.d IS NOT NULL")
def migration_guard(spark, d):
    now, old = _snapshots(spark, d)
    dates = lambda q: q.groupBy("subject").agg(F.array_sort(F.collect_set(F.when(c("predicate") == V.MODIFIED, c("o_value")))).alias("dates"))
    both = dates(now).withColumnRenamed("dates", "a").join(dates(old).withColumnRenamed("dates", "b"), "subject", "full")
    finding = F.when(c("a").isNull(), "lost").when(c("b").isNull(), "invented").when(c("a") != c("b"), "redated")
    return both.select("subject", finding.alias("finding")).where("finding IS NOT NULL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every output file of a compile of the driver's tables."""
    return file_digest(spark, sf_dir)
