"""Rules (target classes, path, component, parameters) compiled to plans that give (rule, subject) of each violation."""

from __future__ import annotations

from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..plans.components import cyclic, stored

ALL = tuple(V.CLASS.values())
ENTITY, ATTRIBUTE, RELATIONSHIP, SCHEME, VALUE = (V.CLASS[k] for k in ("entity", "attribute", "relationship", "scheme", "taxonomy-value"))

TERM = V.SEM + "BusinessTerm"


class Rule(NamedTuple):
    name: str
    targets: tuple[str, ...]
    path: str
    component: str  #: minCount, maxCount, unique_lang, lang, plain, in, class, none
    value: Any = None
    severity: str = "violation"


CATALOG = [
    Rule("label-missing", ALL, V.LABEL, "minCount", 1),
    Rule("label-repeated", ALL, V.LABEL, "unique_lang"),
    Rule("label-untagged", ALL, V.LABEL, "lang"),
    Rule("status-missing", ALL, V.STATUS, "minCount", 1),
    Rule("status-repeated", ALL, V.STATUS, "maxCount", 1),
    Rule("status-unknown", ALL, V.STATUS, "in", ("active", "deprecated")),
    Rule("scheme-missing", (ENTITY, ATTRIBUTE, RELATIONSHIP, VALUE), V.IN_SCHEME, "minCount", 1),
    Rule("scheme-undeclared", (ENTITY, ATTRIBUTE, RELATIONSHIP, VALUE), V.IN_SCHEME, "class", SCHEME),
    Rule("definition-missing", (ENTITY, ATTRIBUTE, VALUE), V.DEFINITION, "minCount", 1, "warning"),
    Rule("definition-untagged", (ENTITY, ATTRIBUTE, RELATIONSHIP, VALUE, TERM), V.DEFINITION, "lang"),
    Rule("owner-missing", (ATTRIBUTE,), V.ATTRIBUTE_OF, "minCount", 1),
    Rule("owner-repeated", (ATTRIBUTE,), V.ATTRIBUTE_OF, "maxCount", 1),
    Rule("owner-class", (ATTRIBUTE,), V.ATTRIBUTE_OF, "class", ENTITY),
    Rule("source-missing", (RELATIONSHIP,), V.SOURCE, "minCount", 1),
    Rule("source-repeated", (RELATIONSHIP,), V.SOURCE, "maxCount", 1),
    Rule("source-class", (RELATIONSHIP,), V.SOURCE, "class", ENTITY),
    Rule("target-missing", (RELATIONSHIP,), V.TARGET, "minCount", 1),
    Rule("target-repeated", (RELATIONSHIP,), V.TARGET, "maxCount", 1),
    Rule("target-class", (RELATIONSHIP,), V.TARGET, "class", ENTITY),
    Rule("scheme-type", (SCHEME,), V.SCHEME_TYPE, "in", ("glossary", "taxonomy")),
    Rule("scheme-type-missing", (SCHEME,), V.SCHEME_TYPE, "minCount", 1),
    Rule("scheme-type-repeated", (SCHEME,), V.SCHEME_TYPE, "maxCount", 1),
    Rule("enumerates-class", (SCHEME,), V.ENUMERATES, "class", ENTITY),
    Rule("broader-class", (ENTITY,), V.BROADER, "class", ENTITY),
    Rule("broader-unwanted", (ATTRIBUTE, RELATIONSHIP, SCHEME, TERM), V.BROADER, "none"),
    Rule("notation-plain", ALL, V.NOTATION, "plain"),
]


def types(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("predicate") == V.TYPE).select("subject", F.col("o_value").alias("type")).distinct()


def evaluate(quads: DataFrame, rules: list[Rule] = CATALOG) -> DataFrame:
    """(rule, severity, subject) of all violations of all rules.

    The statements are read and sent once, whatever the number of rules: each subject's distinct ones are gathered, and all rules look
    at those. Class rules then look up the distinct objects of their links, as very many subjects may share one."""
    paths = sorted({r.path for r in rules})
    typed_ = F.nullif(F.col("o_type"), F.lit(V.XSD + "string")) if "o_type" in quads.columns else F.lit(None).cast("string")
    known = [*paths, V.TYPE]
    which = F.lit(None).cast("int")
    for i, p in enumerate(known):
        which = F.when(F.col("predicate") == p, i).otherwise(which)
    each = quads.where(F.col("predicate").isin(known)).select("subject", F.xxhash64("subject").alias("_h"), F.struct(which.alias("i"), "o_kind", "o_value", "o_lang", typed_.alias("o_type")).alias("s"))
    own = each.groupBy("_h", "subject").agg(F.collect_set("s").alias("s"))  # the aggregate's sort compares the hash first, as all subjects begin alike
    of = lambda p: F.filter("s", lambda x: x["i"] == known.index(p))
    own = own.select("subject", F.array_distinct(F.transform(of(V.TYPE), lambda x: x["o_value"])).alias("types"), *[of(p).alias(f"_{i}") for i, p in enumerate(paths)]).where(F.size("types") > 0)
    found = []
    for r in rules:
        if r.component == "class":
            continue
        at = F.col(f"_{paths.index(r.path)}")
        n = F.size(at)
        bad = {
            "minCount": lambda: n < r.value,
            "maxCount": lambda: n > r.value,
            "none": lambda: n > 0,
            "unique_lang": lambda: n > F.size(F.array_distinct(F.transform(at, lambda x: F.coalesce(x["o_lang"], F.lit(""))))),
            "lang": lambda: F.exists(at, lambda x: x["o_lang"].isNull()),
            "plain": lambda: F.exists(at, lambda x: (x["o_kind"] == "iri") | x["o_lang"].isNotNull() | x["o_type"].isNotNull()),
            "in": lambda: F.exists(at, lambda x: ~x["o_value"].isin(*r.value)),
        }[r.component]()
        target = F.arrays_overlap("types", F.array(*[F.lit(t) for t in r.targets]))
        found.append(F.when(target & bad, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))))
    violations = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<rule:string,severity:string>>")
    by_class = [r for r in rules if r.component == "class"]
    if not by_class:
        return own.select("subject", F.explode(violations).alias("v")).select("v.rule", "v.severity", "subject")
    wanted = sorted({r.value for r in by_class})

    def linked_by(r: Rule) -> Column:
        to = F.transform(f"_{paths.index(r.path)}", lambda x: F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), x["o_value"].alias("o_value"), F.lit(r.value).alias("want")))
        target = F.arrays_overlap("types", F.array(*[F.lit(t) for t in r.targets]))
        return F.when(target, to).otherwise(F.array().cast("array<struct<rule:string,severity:string,o_value:string,want:string>>"))

    links = F.flatten(F.array(*map(linked_by, by_class)))
    seen = stored(own.select("subject", F.filter("types", lambda t: t.isin(wanted)).alias("types"), violations.alias("violations"), links.alias("links")))
    plain = seen.select("subject", F.explode("violations").alias("v")).select("v.rule", "v.severity", "subject")
    linked = seen.select("subject", F.explode("links").alias("l")).select("subject", "l.*")
    declared = seen.select(F.col("subject").alias("o_value"), F.explode("types").alias("want"))
    wrong = stored(linked.select("o_value", "want").distinct().join(declared, ["o_value", "want"], "left_anti"))
    return plain.unionByName(linked.join(wrong, ["o_value", "want"], "left_semi").select("rule", "severity", "subject").distinct())


def cycles(quads: DataFrame) -> DataFrame:
    """Subjects that are their own broader one, over any number of steps."""
    return cyclic(quads.where(F.col("predicate") == V.BROADER).select(F.col("subject").alias("child"), F.col("o_value").alias("parent"))).select(F.col("node").alias("subject"))


def shared_notation(quads: DataFrame) -> DataFrame:
    """(scheme, notation, subject): notations that several subjects of a scheme have."""
    n = quads.where(F.col("predicate") == V.NOTATION).select("subject", F.col("o_value").alias("notation"))
    s = quads.where(F.col("predicate") == V.IN_SCHEME).select("subject", F.col("o_value").alias("scheme"))
    both = n.join(s, "subject").distinct()
    return both.join(both.groupBy("scheme", "notation").agg(F.countDistinct("subject").alias("n")).where("n > 1"), ["scheme", "notation"], "left_semi")


def deprecated_parents(quads: DataFrame) -> DataFrame:
    """Active subjects below, or attributes of, a deprecated one."""
    status = quads.where(F.col("predicate") == V.STATUS).select("subject", F.col("o_value").alias("status"))
    links = quads.where(F.col("predicate").isin(V.BROADER, V.ATTRIBUTE_OF)).select("subject", "o_value")
    up = status.where("status = 'deprecated'").select(F.col("subject").alias("o_value"))
    return links.join(status.where("status = 'active'").select("subject"), "subject", "left_semi").join(up, "o_value", "left_semi").select("subject", "o_value").distinct()


def outside(quads: DataFrame, base: str) -> DataFrame:
    return quads.where(~F.startswith("subject", F.lit(base))).select("subject").distinct()


def iri_policy(quads: DataFrame, base: str) -> DataFrame:
    """Subjects whose IRI isn't their class's namespace with a UUID (a slug, for schemes)."""
    bad = F.lit(False)
    for kind, ns in V.NAMESPACE.items():
        local = "[a-z0-9]+([-_][a-z0-9]+)*" if kind == "scheme" else "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
        bad |= (F.col("type") == V.CLASS[kind]) & ~F.col("subject").rlike("^" + (base + ns).replace(".", r"\.") + local + "$")
    return types(quads).where(bad).select("subject", "type")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
