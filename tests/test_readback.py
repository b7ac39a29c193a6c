"""Explanations, normal form, listings, exports, the guard, the service."""

import json

import pytest

from factweave import explain, export
from factweave.language import normal
from factweave.language.parser import QueryError, parse
from factweave.model import Model, ModelError
from factweave.plans import tpch
from factweave.plans.catalogue import PATHS
from factweave.service import Service, shown
from factweave.sqlguard import check


def test_normal_form_is_a_fixed_point_and_means_the_same(ferries):
    for text in ["LIST n FROM Ferry [lies in Port: 1] has FerryName n AND ALSO has Seats s WHERE s > 50 ORDERED WITH s THE FIRST 2", "LIST p, c FROM Sailing x goes to Port p AND ALSO THE COUNT OF x GROUPED BY p AS c WHERE c > 1", "THE SUM OF s IN Sailing is run by Ferry has Seats s"]:
        once = normal.query(parse(ferries.model, text).query)
        assert normal.query(parse(ferries.model, once).query) == once
        assert sorted(ferries(once)) == sorted(ferries(text))


@pytest.mark.parametrize("key", [k for k, (t, _) in PATHS.items() if "DEFINE" not in t])
def test_every_registered_query_has_a_normal_form(key):
    m = tpch.model()
    once = normal.query(parse(m, PATHS[key][0]).query)
    assert normal.query(parse(m, once).query) == once


def test_explain_names_what_is_dropped_and_what_is_chance(ferries):
    r = explain.explain(ferries.model, "LIST n FROM Sailing has SailingNr n AND ALSO has Riders r THE FIRST 2")
    assert r.risks == 1 and any("Riders" in x for x in r.requires)
    assert "Normalised" in r.text() and json.dumps(r.as_dict())
    assert explain.explain(ferries.model, "LIST n FROM Sailing has SailingNr n AND ALSO has Riders r ORDERED WITH r THE FIRST 2").risks == 0


def test_listing_and_linking(ferries):
    listing = explain.schema(ferries.model, relational=True)
    assert "Ferry lies in Port" in listing and "ferry.home" in listing
    found = explain.link(ferries.model, "How many seats do ferries in each port have?")
    assert {"Seats", "Ferry", "Port"} <= found and "Tonnes" not in found


def test_rules_and_abstraction(ferries):
    said = explain.rules(ferries.model)
    assert "Each Ferry lies in at most one Port." in said and "Each Icebreaker is a Ferry." in said
    ladder = explain.abstraction(ferries.model)
    assert ladder[-1] == ["Ferry"] and len(ladder[0]) == 6
    assert "create table sailing" in explain.annotated_ddl(ferries.model)


def test_model_round_trip_and_problems(ferries):
    assert Model.from_json(ferries.model.to_json()).to_json() == ferries.model.to_json()
    assert ferries.model.problems() == [] and tpch.model().problems() == []
    bad = Model("x").entity("A", "a", "id", supertype="B")
    bad.entity("C", "c")
    assert len(bad.problems()) == 2
    with pytest.raises(ModelError):
        Model("y").entity("A", "a", "i", supertype="B").entity("B", "b", "i", supertype="A").supertypes("A")


def test_exports(ferries):
    xml = export.orm_xml(ferries.model)
    assert export.check_xml(xml) == [] and "UniquenessConstraint" in xml
    assert export.check_xml(xml.replace('id="_Ferry"', 'id="_Boat"', 1))
    page = export.html(ferries.model)
    assert page == export.html(ferries.model) and "Ferry" in page


def test_guard_finds_traps_that_change_the_answer(spark, ferries):
    for name, df in ferries.tables.items():
        df.createOrReplaceTempView(name)
    columns = {n: df.columns for n, df in ferries.tables.items()}
    kinds = lambda sql: {g.kind for g in check(spark.sql(sql), ferries.model, columns)}
    assert "fan trap" in kinds("select sum(seats) from ferry f join sailing s on s.hull = f.hull")
    assert kinds("select sum(fare) from ferry f join sailing s on s.hull = f.hull") == set()
    assert "cross product" in kinds("select count(*) from port cross join goods")
    assert "sum of distinct" in kinds("select sum(distinct fare) from sailing")


def test_service_answers_and_restricts(spark, ferries):
    s = Service(spark, ferries.model, ferries.source)
    ask = lambda **a: s.answer(json.dumps(a))
    assert len(ask(tool="query", arguments={"query": "LIST n FROM Ferry has FerryName n"})["result"]["rows"]) == 5
    assert ask(tool="query", arguments={"query": "LIST n FROM Ferry: 99 has FerryName n"})["result"]["notice"]
    assert "error" in ask(tool="nothing") and "error" in ask(tool="sql", arguments={"sql": "drop table ferry"})
    assert ask(tool="sql", arguments={"sql": "select sum(seats) as s from ferry f join sailing x on x.hull = f.hull"})["result"]["findings"]
    assert "refused" in ask(tool="query", arguments={"query": "LIST n FROM Ferry has FerryName n THE FIRST 1", "strict": True})["result"]
    narrow = Service(spark, ferries.model, ferries.source, {"Ferry", "FerryName"})
    with pytest.raises(QueryError):
        narrow.tool_query("LIST s FROM Ferry has Seats s")


def test_shown_rows_are_counted_by_one_run(spark):
    assert shown(spark, spark.range(3), 5).endswith("3 rows") and shown(spark, spark.range(9), 5).endswith("more than 5 rows")
    assert shown(spark, spark.range(0), 5).startswith("no rows")
