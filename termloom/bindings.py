"""The driver's star schema read as business models: three sources of objects, their records and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .plans import assemble
from .plans.components import stored

BASE = "https://models.example.org/"
FIELDS = ("kind", "source", "key", "label", "schemes", "slug", "broader", "owner", "end_a", "end_b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, kind: str, source: str, key: Column, label: Column, scheme: Column, **more: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    cols = {"kind": F.lit(kind), "source": F.lit(source), "key": key, "label": label, "schemes": F.array(scheme)} | {c: more.get(c, empty) for c in FIELDS[5:]}
    return df.select(*[c.cast("array<string>" if n == "schemes" else "string").alias(n) for n, c in cols.items()])


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects. broader, owner, end_a and end_b are the keys of other objects as source:key."""
    t = lambda n: table(spark, sf_dir, n)
    c, s = F.col, F.lit
    text = lambda name: c(name).cast("string")
    region = F.concat(s("region-"), text("n_regionkey"))
    nation = F.concat(s("geo:nation-"), text("n_nationkey"))
    nations = t("nation").select("n_nationkey", "n_regionkey", "n_name")
    customer = t("customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment").join(nations, c("c_nationkey") == c("n_nationkey"))
    supplier = t("supplier").select("s_suppkey", "s_nationkey", "s_name").join(nations, c("s_nationkey") == c("n_nationkey"))
    part = t("part").select("p_partkey", "p_name", "p_type", "p_brand")
    brand = F.concat_ws("/", "p_type", "p_brand")
    leaf = F.concat(brand, s("/"), c("p_name"), s("#"), text("p_partkey"))
    edges = relations(spark, sf_dir).join(customer.select("c_custkey", "n_regionkey"), "c_custkey")
    own = F.concat(s("region-"), text("r_regionkey"))
    parts = [
        _rows(t("region"), "scheme", "geo", own, c("r_name"), own, slug=own),
        _rows(spark.range(1), "scheme", "catalog", s("part-type"), s("Part type"), s("part-type"), slug=s("part-type")),
        _rows(nations, "entity", "geo", F.concat(s("nation-"), text("n_nationkey")), c("n_name"), region),
        _rows(customer, "entity", "crm", text("c_custkey"), c("c_name"), region, broader=nation),
        _rows(supplier, "entity", "erp", text("s_suppkey"), c("s_name"), region, broader=nation),
        _rows(customer, "attribute", "crm", F.concat(text("c_custkey"), s(".segment")), c("c_mktsegment"), region, owner=F.concat(s("crm:"), text("c_custkey"))),
        _rows(part.select("p_type").distinct(), "taxonomy-value", "catalog", c("p_type"), c("p_type"), s("part-type")),
        _rows(part.select("p_type", "p_brand").distinct(), "taxonomy-value", "catalog", brand, c("p_brand"), s("part-type"), broader=F.concat(s("catalog:"), c("p_type"))),
        _rows(part, "taxonomy-value", "catalog", leaf, c("p_name"), s("part-type"), broader=F.concat(s("catalog:"), brand)),
        _rows(edges, "relationship", "sales", F.concat_ws("-", text("c_custkey"), text("s_suppkey")), s("buys from"), region, end_a=F.concat(s("crm:"), text("c_custkey")), end_b=F.concat(s("erp:"), text("s_suppkey"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (customer, supplier) of returned lines of urgent orders."""
    orders = table(spark, sf_dir, "orders").where(F.startswith("o_orderpriority", F.lit("1"))).select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()


def named(objects_: DataFrame) -> DataFrame:
    """Objects with ref (source:key) and iri."""
    c = F.col
    local = ids.local_name(c("kind"), c("source"), c("key"), c("schemes"), c("slug"))
    out = objects_.withColumns({"ref": F.concat_ws(":", "source", "key"), "iri": F.concat(ids.namespace(c("kind"), BASE), local)})
    return stored(out)  # queries read it several times


def statements(named_: DataFrame) -> DataFrame:
    return assemble.statements(named_, BASE, glossary=lambda slug: slug != "part-type")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of all objects, for queries that read them once."""
    return statements(named(objects(spark, sf_dir)))


REGION = "'region-' || n_regionkey"
_OBJ = f"""
rel AS MATERIALIZED (SELECT DISTINCT o_custkey AS c_custkey, l_suppkey AS s_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderpriority LIKE '1%'),
obj AS MATERIALIZED (
  SELECT 'scheme' AS kind, 'geo' AS source, 'region-' || r_regionkey AS key, r_name AS label, ['region-' || r_regionkey] AS schemes, 'region-' || r_regionkey AS slug, NULL::VARCHAR AS broader, NULL::VARCHAR AS owner, NULL::VARCHAR AS end_a, NULL::VARCHAR AS end_b FROM region
  UNION ALL SELECT 'scheme', 'catalog', 'part-type', 'Part type', ['part-type'], 'part-type', NULL, NULL, NULL, NULL
  UNION ALL SELECT 'entity', 'geo', 'nation-' || n_nationkey, n_name, [{REGION}], NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'entity', 'crm', c_custkey::VARCHAR, c_name, [{REGION}], NULL, 'geo:nation-' || n_nationkey, NULL, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'entity', 'erp', s_suppkey::VARCHAR, s_name, [{REGION}], NULL, 'geo:nation-' || n_nationkey, NULL, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'attribute', 'crm', c_custkey || '.segment', c_mktsegment, [{REGION}], NULL, NULL, 'crm:' || c_custkey, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'taxonomy-value', 'catalog', p_type, p_type, ['part-type'], NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT DISTINCT 'taxonomy-value', 'catalog', p_type || '/' || p_brand, p_brand, ['part-type'], NULL, 'catalog:' || p_type, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'taxonomy-value', 'catalog', p_type || '/' || p_brand || '/' || p_name || '#' || p_partkey, p_name, ['part-type'], NULL, 'catalog:' || p_type || '/' || p_brand, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'relationship', 'sales', rel.c_custkey || '-' || rel.s_suppkey, 'buys from', [{REGION}], NULL, NULL, NULL, 'crm:' || rel.c_custkey, 'erp:' || rel.s_suppkey
            FROM rel JOIN customer ON rel.c_custkey = customer.c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def sql_uuid5(name: str) -> str:
    from .vocabulary import UUID_NAMESPACE

    h = f"sha1(unhex('{UUID_NAMESPACE}') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


_NAMED = f"""
named AS MATERIALIZED (SELECT *, source || ':' || key AS ref, '{BASE}' || CASE kind WHEN 'relationship' THEN 'r/' WHEN 'scheme' THEN 'sch/' WHEN 'taxonomy-value' THEN 'v/' ELSE 'c/' END
  || CASE WHEN kind = 'scheme' THEN slug WHEN kind = 'taxonomy-value' THEN {sql_uuid5("list_min(schemes) || '|' || key")}
     WHEN regexp_full_match(key, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN lower(key) ELSE {sql_uuid5("source || ':' || key")} END AS iri FROM obj)"""
OBJ, NAMED = "WITH " + _OBJ, "WITH " + _OBJ + "," + _NAMED
QUADS = NAMED + "," + assemble.SQL.format(base=BASE)
