import json

import pytest

from termloom.bindings import BASE, quads
from termloom.functions import turtle
from termloom.sinks import files
from termloom.sources import canonical_turtle, json_models, registers


def test_turtle_round_trip(spark, tmp_path):
    q = quads(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([("concepts-region-0.ttl", BASE + "c/odd", "urn:p", "lit", 'a "q" \\ \n \t ; . \u0001 é', "en")], "file string, subject string, predicate string, o_kind string, o_value string, o_lang string")
    q = q.select(*odd.columns).unionByName(odd).selectExpr("*", "cast(null as string) AS o_type")
    folder = str(tmp_path / "out")
    done = files.write_all(turtle.files(q, BASE), folder)
    assert len(done["added"]) > 5 and files.verify(folder) == []
    back = canonical_turtle.read(spark, folder, BASE)
    cols = ["file", "subject", "predicate", "o_kind", "o_value", "o_lang"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, q.select(cols).distinct().collect()))
    again = files.write_all(turtle.files(back, BASE), folder)
    assert not again["added"] and not again["rewritten"] and not again["removed"]
    (tmp_path / "out" / "stray.ttl").write_text("x")
    assert files.verify(folder) == [("stray.ttl", "unrecorded")]
    assert files.write_all(turtle.files(back, BASE), folder)["removed"] == ["stray.ttl"]


def test_registers(spark, tmp_path):
    p = tmp_path / "map.csv"
    p.write_text("﻿iri,kind,source_name,source_key,first_seen,note\nurn:a,entity,crm,1,2024-01-01,\n\nurn:b,thing,c:rm,,2024-13-01,x\n", encoding="utf-8")
    rows, issues = registers.id_map(spark, str(p))
    assert [r["iri"] for r in rows.collect()] == ["urn:a"]
    assert sorted(r["message"] for r in issues.collect()) == ["bad date", "bad source name", "no source key", "unknown kind"]
    p.write_text("a,b\n")
    with pytest.raises(registers.HeaderError):
        registers.id_map(spark, str(p))


def test_json_models(spark, tmp_path):
    model = {"modelId": 7, "name": "Shop", "ignored": 1, "entities": [{"id": "a", "name": "Order line", "metadata": {"Synonyms": "row, , item"}, "attributes": [{"id": "a1", "name": "Price"}]}, {"id": "b", "name": "Thing"}],
             "relationships": [{"id": "r1", "labels": [{"name": "back", "direction": "Source"}, {"name": "holds", "direction": "target"}], "sourceEntity": {"id": "a"}, "targetEntity": {"id": "b"}}, {"id": "r2", "sourceEntity": {"id": "b", "startType": "superType"}, "targetEntity": {"id": "a"}}, {"id": "r3", "sourceEntity": {"id": "b", "startType": "superType"}, "targetEntity": {"id": "z"}}]}
    (tmp_path / "one.json").write_text(json.dumps({"model": model}))
    (tmp_path / "two.json").write_text(json.dumps(model))
    docs = json_models.models(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    e = {r["key"]: r for r in json_models.entities(docs, "ell").where("path LIKE '%one.json'").collect()}
    assert e["a"]["label"] == "Order line" and e["a"]["alt_labels"] == ["row", "item"] and e["a"]["broader"] == ["b"] and e["b"]["broader"] == []
    assert [(r["owner"], r["label"]) for r in json_models.attributes(docs, "ell").where("path LIKE '%two.json'").collect()] == [("a", "Price")]
    assert {(r["key"], r["label"], tuple(r["alt_labels"])) for r in json_models.relationships(docs, "ell").collect()} == {("r1", "holds", ("back",))}
    assert {r["narrower"] for r in json_models.orphans(docs).collect()} == {"z"}
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(json_models.ContentError):
        json_models.models(spark, [str(tmp_path / "bad.json")])
