"""What queries on large tables may not do twice or hold whole."""

import hashlib

import pytest

from termloom import bindings, queries
from termloom.functions import turtle
from termloom.rules import compiler

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["deprecate_rows", "id_map_lookup"])
def test_objects_are_made_once(spark, monkeypatch, name):
    made, objects = [], bindings.objects
    for module in (bindings, queries):
        monkeypatch.setattr(module, "objects", lambda *x: made.append(1) or objects(*x))
    assert queries.QUERIES[name](spark, DATA).columns and len(made) == 1


def test_rules_without_classes_send_statements_once(spark):
    q = spark.createDataFrame([], "subject string, predicate string, o_kind string, o_value string, o_lang string")
    plan = compiler.evaluate(q, [r for r in compiler.CATALOG if r.name.startswith(("label", "status"))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_digests_are_those_of_the_texts(spark):
    rows = [(f, f"{bindings.BASE}c/{i}", "urn:p", "lit", v, None, None) for f, n in (("a", 30), ("b", 3)) for i in range(n) for v in ("é\n", '"\\', "plain", "\x07")]
    q = spark.createDataFrame(rows, "file string, subject string, predicate string, o_kind string, o_value string, o_lang string, o_type string")
    want = {r["file"]: (hashlib.sha256(r["text"].encode()).hexdigest(), len(r["text"])) for r in turtle.files(q, bindings.BASE).collect()}
    assert {r["file"]: (r["digest"], r["n_chars"]) for r in turtle.digests(q, bindings.BASE).collect()} == want and len(want) == 2
