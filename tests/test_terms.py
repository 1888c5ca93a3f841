"""Whole terms in snapshots, case folding, and the rules of exactly one."""

from pyspark.sql import functions as F

from termloom import vocabulary as V
from termloom.functions import text
from termloom.plans import snapshot
from termloom.rules import compiler

SCHEMA = "subject string, predicate string, o_kind string, o_value string, o_lang string, o_type string"


def test_a_language_or_a_datatype_alone_is_a_change(spark):
    old = [("s", V.LABEL, "lit", "x", "en", None), ("t", V.NOTATION, "lit", "1", None, None), ("u", V.LABEL, "lit", "x", "en", None), ("v", V.SOURCE, "iri", "x", None, None)]
    now = [("s", V.LABEL, "lit", "x", "fr", None), ("t", V.NOTATION, "lit", "1", None, "urn:t"), ("u", V.LABEL, "lit", "x", "EN", None), ("v", V.SOURCE, "lit", "x", None, V.XSD + "string")]
    dates = [(s, V.MODIFIED, "lit", "2020-01-01", None, None) for s in "stuv"]
    old, now = spark.createDataFrame(old + dates, SCHEMA), spark.createDataFrame(now, SCHEMA)
    assert {r["subject"] for r in snapshot.changed(now, old).collect()} == {"s", "t", "v"}
    assert {tuple(r) for r in snapshot.dated(now, old, "2024-01-01").collect()} == {("s", "2024-01-01"), ("t", "2024-01-01"), ("u", "2020-01-01"), ("v", "2024-01-01")}


def test_folding_is_full_case_folding(spark):
    words = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "σίσυφος", "ﬁn", "ſ", "Ǆ", "ᾳ", "ẞ", "İ", "plain", "", "Ꭰꭰ", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.folded(F.col("w")).alias("f")).collect()
    assert all(r["f"] == (None if r["w"] is None else r["w"].casefold()) for r in rows), rows


def test_exactly_one_and_plain(spark):
    rows = [
        ("r", V.TYPE, "iri", compiler.RELATIONSHIP, None, None), ("r", V.SOURCE, "iri", "a", None, None), ("r", V.SOURCE, "iri", "b", None, None), ("r", V.TARGET, "iri", "a", None, None), ("r", V.TARGET, "iri", "b", None, None),
        ("q", V.TYPE, "iri", compiler.RELATIONSHIP, None, None), ("q", V.SOURCE, "iri", "a", None, None), ("q", V.TARGET, "iri", "b", None, None), ("q", V.DEFINITION, "lit", "x", None, None),
        ("s", V.TYPE, "iri", compiler.SCHEME, None, None), ("s", V.SCHEME_TYPE, "lit", "glossary", None, None), ("s", V.SCHEME_TYPE, "lit", "taxonomy", None, None),
        ("t", V.TYPE, "iri", compiler.TERM, None, None), ("t", V.BROADER, "iri", "q", None, None),
        *[row for n, (kind, lang, datatype) in enumerate([("iri", None, None), ("lit", "en", None), ("lit", None, "urn:t"), ("lit", None, None), ("lit", None, V.XSD + "string")]) for row in ((f"n{n}", V.TYPE, "iri", compiler.VALUE, None, None), (f"n{n}", V.NOTATION, kind, "1", lang, datatype))],
    ]
    got = {(r["rule"], r["subject"]) for r in compiler.evaluate(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {("source-repeated", "r"), ("target-repeated", "r"), ("scheme-type-repeated", "s"), ("broader-unwanted", "t"), ("definition-untagged", "q"), ("notation-plain", "n0"), ("notation-plain", "n1"), ("notation-plain", "n2")}
    names = {n for n, _ in want}
    assert {g for g in got if g[0] in names} == want
