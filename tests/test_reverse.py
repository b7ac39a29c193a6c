"""Profiling and derivation on small tables."""

import json
import random
from itertools import combinations

import pytest

from factweave.plans.compiler import run
from factweave.reverse import catalog, derive, mine, review
from factweave.sources.tables import frames


def test_census_and_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, v string")
    facts = mine.facts(df)
    assert (facts["v"].rows, facts["v"].nulls, facts["v"].distinct) == (3, 1, 1)
    assert facts["k"].never_null


def test_unique_sets_are_minimal(spark):
    df = spark.createDataFrame([(i, i // 3, i % 3, "c") for i in range(9)], "id int, a int, b int, c string")
    assert mine.unique_sets(df, mine.facts(df)) == [("id",), ("a", "b")]


def test_combinations_are_refuted_together(spark, monkeypatch):
    # all but those with g repeat, and only past the rows that are looked at first
    df = spark.createDataFrame([(*[i % 2990 * k % 2993 for k in (1, 2, 3, 5, 7)], i // 1500) for i in range(3000)], "a int, b int, c int, d int, e int, g int")
    passes = []
    whole = mine.repeats
    monkeypatch.setattr(mine, "repeats", lambda *a: passes.append(a[1]) or whole(*a))
    assert mine.unique_sets(df, mine.facts(df)) == [(c, "g") for c in "abcde"]
    assert sorted(passes) == [(c, "g") for c in "abcde"]


@pytest.mark.parametrize(("share", "few"), [(100_000, 1_000_000), (20, 1_000_000), (20, 30), (20, 0)])
def test_unique_sets_against_all_combinations(spark, monkeypatch, share, few):
    draw = random.Random(few + share)
    rows = [(draw.randrange(300), draw.randrange(40), draw.random() // 0.004, f"t{draw.randrange(60)}", draw.randrange(9)) for _ in range(700)]
    names = "abcde"
    want = []
    for combo in (c for size in (1, 2, 3) for c in combinations(range(5), size)):
        if len({tuple(r[i] for i in combo) for r in rows}) == len(rows) and not any(set(u) <= set(combo) for u in want):
            want.append(combo)
    df = spark.createDataFrame(rows, "a int, b int, c double, d string, e int").repartition(3)
    for name, n in (("REFUTING", 5), ("SHARE", share), ("FEW", few), ("TASK_ROWS", 100)):
        monkeypatch.setattr(mine, name, n)
    assert want and mine.unique_sets(df, mine.facts(df)) == [tuple(names[i] for i in u) for u in want]


def test_keys_and_references_are_recovered(spark):
    nations = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "nation_id int, name string")
    people = spark.createDataFrame([(i, f"p{i}", (i * 7) % 10, i % 3) for i in range(60)], "person_id int, full string, nation_id int, counter int")
    draft = derive.recover("d", {"nations": nations, "people": people})
    assert draft.catalog["nations"].key == ("nation_id",) and draft.catalog["people"].key == ("person_id",)
    assert [(f.columns, f.table) for f in draft.catalog["people"].foreign] == [(("nation_id",), "nations")]
    assert draft.model.problems() == []
    rows = run(spark, draft.model, frames(nations=nations, people=people), "LIST n, c FROM People p has Nation has NationName n AND ALSO THE COUNT OF p GROUPED BY n AS c").collect()
    assert len(rows) == 10 and all(r.c == 6 for r in rows)


def test_classification():
    cat = catalog.from_json(
        json.dumps(
            {
                "a": {"columns": {"a_id": "int"}, "key": ["a_id"]},
                "b": {"columns": {"b_id": "int"}, "key": ["b_id"]},
                "ab": {"columns": {"a_id": "int", "b_id": "int"}, "key": ["a_id", "b_id"], "foreign": [{"columns": ["a_id"], "table": "a", "references": ["a_id"]}, {"columns": ["b_id"], "table": "b", "references": ["b_id"]}]},
                "sub": {"columns": {"a_id": "int"}, "key": ["a_id"], "foreign": [{"columns": ["a_id"], "table": "a", "references": ["a_id"]}]},
                "log": {"columns": {"at": "date"}},
                "v": {"columns": {"x": "int"}, "view": True},
            }
        )
    )
    assert {n: derive.classify(t) for n, t in cat.items()} == {"a": "entity", "b": "entity", "ab": "association", "sub": "subtype", "log": "unkeyed", "v": "view"}
    draft = derive.derive("m", cat)
    assert [f.subject for f in draft.blockers()] == ["log"]
    assert draft.model.entities["Sub"].supertype == "A"


@pytest.mark.parametrize(
    ("check", "want"),
    [("fuel in ('diesel', 'it''s')", ("fuel", ("diesel", "it's"), None, None)), ("([hazard] between -1.5 and 3)", ("hazard", (), -1.5, 3.0)), ('"class" in (1, 2.5, -3)', ("class", (1, 2.5, -3), None, None)), ("x not in (1)", None), ("not (x between 1 and 2)", None), ("a > b", None), ("a in (b)", None), ("not sql at all (", None)],
)
def test_checks(spark, check, want):
    assert derive.parse_check(spark, check) == want


def test_crossed_keys_are_repaired_and_broken_references_found(spark):
    cat = catalog.from_json(json.dumps({"c": {"columns": {"x": "int", "y": "int"}, "foreign": [{"columns": ["x", "y"], "table": "p", "references": ["y", "x"]}]}, "p": {"columns": {"x": "int", "y": "int"}, "key": ["x", "y"]}}))
    assert cat["c"].foreign[0].references == ("x", "y")
    tables = frames(c=spark.createDataFrame([(1, 2), (3, 4)], "x int, y int"), p=spark.createDataFrame([(1, 2)], "x int, y int"))
    assert catalog.verify(cat, tables) == ["c(x, y): 1 of 2 values are not in p"]
    assert not cat["c"].foreign[0].enforced


def test_dependencies_patterns_comparisons(spark):
    df = spark.createDataFrame([("x", "1", None, 1, 5), ("x", "1", 3, 2, 2), ("y", "2", None, 9, 4)], "a string, b string, c int, low int, high int")
    fd = {(r.determinant, r.dependent): r.broken for r in mine.dependencies(df, [("a", "b"), ("b", "low")]).collect()}
    assert fd == {("a", "b"): 0, ("b", "low"): 1}
    p = {(r.left, r.right): (r.both, r.neither, r.one) for r in mine.null_patterns(df, ["a", "c"]).collect()}
    assert p == {("a", "c"): (1, 0, 2)}
    assert [(r.low, r.high, r.rows, r.broken) for r in mine.comparisons(df, [("low", "high")]).collect()] == [("low", "high", 3, 1)]


def test_computed_columns_stored_sums_and_rings(spark):
    lines = spark.createDataFrame([(1, 2.0, 3.0, 6.0), (1, 1.0, 4.0, 4.0), (2, 5.0, 2.0, 10.0)], "o int, q double, p double, total double")
    assert mine.computed(lines) == ["total = q * p"]
    orders = spark.createDataFrame([(1, 10.0, 2), (2, 10.0, 1)], "id int, amount double, lines int")
    assert mine.stored_aggregates(orders, "id", lines, "o") == ["lines = count of rows by o", "amount = sum of total by o"]
    assert mine.ring(spark.createDataFrame([(2, 1), (3, 2)], "a int, b int"), "a", "b") == {"irreflexive": True, "acyclic": True}
    assert mine.ring(spark.createDataFrame([(1, 2), (2, 1)], "a int, b int"), "a", "b") == {"irreflexive": True, "acyclic": False}


def test_spellings_cut_no_values_with_digits(spark):
    counts = {"Dresden": 60, "Dresdn": 3, "Dresdeen": 4, "Dre5den": 40, "Dreden": 2, "Dres7dn": 1, "Bonn": 19, "Bon": 1, "Bonm": 1, "Ulm 1\n2": 90, "Ulm 1\n": 1, "Trier": 20, "Triers": 1, "Triet": 2}
    df = spark.createDataFrame([(v, f"{i}.5") for v, n in counts.items() for i in range(n)], "town string, price string")
    values = mine.census(df, ["town", "price"])
    assert {r.value for r in mine.cuts(values).select("value").collect()} == {v for v in counts if v not in ("Bon", "Ulm 1\n2")}

    def left(v):
        return {v, *(v[:i] + v[i + 1 :] for i in range(len(v)))}

    want = [n for v, n in counts.items() if len(v) > 3 and not any(c.isdigit() for c in v) and any(left(v) & left(w) and m >= mine.COMMON * n for w, m in counts.items() if len(w) > 3)]
    assert [tuple(r) for r in mine.spellings(values).collect()] == [("town", "near a common value", len(want), sum(want))]


def test_value_quality(spark):
    df = spark.createDataFrame([(" x", "1"), ("X", "2"), ("n/a", "3")], "t string, n string")
    found = {(r.column, r.finding) for r in mine.quality(df).collect()}
    assert {("t", "padded"), ("t", "sentinel for null"), ("t", "variants in case or spacing"), ("n", "number as text")} <= found
    assert mine.storage_types(df) == {"t": "string", "n": "bigint"}


def test_json_shapes(spark):
    record = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2, "b": {"c": "y"}}',)], "d string")
    assert mine.json_shape(record, "d") == ("record", {"$.a": "bigint", "$.b.c": "string"})
    maps = spark.createDataFrame([(json.dumps({f"k{i}": 1}),) for i in range(10)], "d string")
    assert mine.json_shape(maps, "d")[0] == "map"
    assert mine.json_shape(spark.createDataFrame([("text",)], "d string"), "d")[0] == "bag"


def test_review_keeps_decisions_and_lint_finds_faults(spark):
    nations = spark.createDataFrame([(i, f"n{i}") for i in range(60)], "nation_id int, name string")
    draft = derive.recover("d", {"nations": nations})
    text = review.export(draft)
    decided = json.loads(text)
    decided["claims"][0]["decision"] = "reject"
    again = json.loads(review.export(draft, json.dumps(decided)))
    assert again["claims"][0]["decision"] == "reject"
    assert "Nation" not in review.apply(draft, json.dumps(decided)).model.entities
    nations.createOrReplaceTempView("nations")
    assert review.check(spark, text) == []
    draft.model.value("Unused")
    assert ("note", "unused value type", "Unused") in review.lint(draft.model)


def test_routes_structure_and_partitions(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, e int")
    b = spark.createDataFrame([(1, 10), (2, 30)], "k int, e int")
    r = mine.routes_agree(a, "k", a, b).first()
    assert (r.agree, r.differ) == (1, 1)
    s = mine.structure(b, "k", spark.createDataFrame([(1,), (2,), (3,)], "id int"), "id").first()
    assert (s.parents, s.covered, s.rows, s.most) == (3, 2, 2, 1)
    assert mine.partition_or_subtype(a, a) == "partition"


def test_references_to_large_parents_are_recovered(spark):
    parents = spark.range(60_000).selectExpr("id + 1 as c_custkey")
    children = spark.range(4000).selectExpr("id as o_orderkey", "id * 7919 % 60000 + 1 as o_custkey")
    counters = spark.range(4000).selectExpr("id as o_orderkey", "id % 100 + 1 as o_custkey")
    assert mine.spread(children, "o_custkey", parents, "c_custkey") > 0.9
    assert mine.spread(counters, "o_custkey", parents, "c_custkey") < 0.05
    found = lambda orders: [(i.column, i.parent) for i in mine.inclusions({"orders": orders, "customer": parents}, {"orders": mine.facts(orders), "customer": mine.facts(parents)}, {"orders": ("o_orderkey",), "customer": ("c_custkey",)}) if i.column == "o_custkey"]
    assert found(children) == [("o_custkey", "customer")] and found(counters) == []
    assert mine.spread(children, "o_custkey", parents.limit(4), "c_custkey") is None


def test_spread_of_texts_is_that_of_their_order(spark):
    parents = spark.range(1000).selectExpr("lpad(id, 4, '0') as code")
    assert mine.spread(parents.where("code like '%0'"), "code", parents, "code") > 0.95
    assert mine.spread(parents.where("code < '0050'"), "code", parents, "code") < 0.1


def test_rings_of_long_chains(spark):
    chain = [(i + 1, i) for i in range(70)]
    assert mine.ring(spark.createDataFrame(chain, "a int, b int").coalesce(1), "a", "b") == {"irreflexive": True, "acyclic": True}
    assert mine.ring(spark.createDataFrame([*chain, (0, 1)], "a int, b int"), "a", "b") == {"irreflexive": True, "acyclic": False}


def test_computed_columns_of_wide_tables(spark):
    wide = spark.range(1, 40).selectExpr("id as k", *[f"cast(hash(id, {i}) % 1000 as double) as m{i}" for i in range(7)]).selectExpr("*", "m5 + m6 as total")
    assert "total = m5 + m6" in mine.computed(wide)
    assert mine.computed(wide, skip=("k", "total")) == []


def test_every_pass_runs_on_the_way_to_a_draft(spark):
    parents = spark.createDataFrame([(i, f"C{i:03d}", 3 * i + 3, 3) for i in range(60)], "shop_id int, code string, sold int, sales int")
    sales = spark.createDataFrame(
        [(i, i // 3, i // 3 + 1, 1, i // 3 + 2, "2024-01-01" if i % 7 else "1/2/2024", "Paris" if i % 50 else "Pariss", None if i % 4 else i, None if i % 4 else 2 * i, f"{i}", i % 3 == 0) for i in range(180)],
        "sale_id int, shop_id int, units int, tax int, gross int, start string, town string, note int, tip int, label string, leading boolean",
    )
    draft = derive.recover("d", {"shops": parents, "sales": sales})
    found = {(f.kind, f.subject, f.said) for f in draft.findings}
    assert ("computed", "sales", "gross = units + tax") in found
    assert ("stored aggregate", "shops", "sold = sum of units by shop_id in sales") in found and ("stored aggregate", "shops", "sales = count of rows by shop_id in sales") in found
    assert ("code", "shops.code", "is an alternate key of one width") in found
    assert ("filled together", "sales.note, tip", "both or neither") in found
    assert any(k == "joint nulls" and "note, tip" in x for k, _, x in found)
    assert ("covers", "sales.shop_id", "every row of shops has rows here") in found
    assert ("one row per group", "sales", "leading marks one row for each shop_id") in found
    assert ("storage type", "sales.label", "every value is a bigint") in found
    assert any(s == "sales.start" and "several formats" in x for k, s, x in found if k == "quality")
    assert any(s == "sales.town" and "near a common value" in x for k, s, x in found if k == "quality")
    assert ("dependency", "sales.shop_id", "fixes units") in found
    assert any(c.name == "Sale has SaleUnits" for c in draft.model.constraints)


def test_declared_references_are_checked_and_completed(spark):
    cat = catalog.from_json(
        json.dumps(
            {
                "town": {"columns": {"id": "int", "code": "string"}, "key": ["id"], "unique": [["code"]]},
                "street": {"columns": {"nr": "int", "town_code": "string"}, "key": ["nr"], "foreign": [{"columns": ["town_code"], "table": "town", "references": ["code"]}]},
                "pair": {"columns": {"p": "int", "q": "int"}, "key": ["p", "q"]},
                "use": {"columns": {"n": "int", "a": "int", "b": "int"}, "key": ["n"], "foreign": [{"columns": ["a", "b"], "table": "pair", "references": ["p", "q"]}]},
            }
        )
    )
    town = spark.createDataFrame([(1, "x"), (2, "y")], "id int, code string")
    street = spark.createDataFrame([(1, "x"), (2, "z")], "nr int, town_code string")
    pair = spark.createDataFrame([(1, 10), (2, 20)], "p int, q int")
    use = spark.createDataFrame([(1, 10, 1), (2, 20, 2)], "n int, a int, b int")
    draft = derive.recover("d", {"town": town, "street": street, "pair": pair, "use": use}, declared=cat)
    assert draft.catalog["town"].key == ("code",)
    assert draft.catalog["use"].foreign[0].references == ("q", "p") and draft.catalog["use"].foreign[0].enforced
    assert any(f.kind == "declared reference" and "1 of 2 values" in f.said for f in draft.findings)


def test_joined_texts_and_units(spark):
    df = spark.createDataFrame([("a", "b", "a-b"), ("c", "d", "c-d")], "x string, y string, z string")
    assert mine.computed(df) == ["z = x || '-' || y"]
    from factweave.model import Model

    m = Model("m").entity("A", "a", "id").entity("B", "b", "id")
    m.attribute("A", "AWeight", "weight_kg", "double").attribute("B", "BLoad", "load_kg", "double")
    assert [f.subject for f in derive.one_unit(m)] == ["AWeight, BLoad"]


def test_objectified_and_n_ary_facts(spark):
    from factweave.model import Model, Role

    m = Model("m").entity("Crew", "crew", "crew_id").entity("Ship", "ship", "ship_id").entity("Rank", "rank", "rank_id")
    m.attribute("Crew", "CrewName", "name").attribute("Ship", "ShipName", "name").attribute("Rank", "RankName", "name")
    m.objectified("Service", "service", (("Crew", ("crew_id",), "is by", "has"), ("Ship", ("ship_id",), "is on", "is place of")))
    m.attribute("Service", "Months", "months", "int")
    m.fact("Posting", "posting", (Role("Crew", ("crew_id",)), Role("Ship", ("ship_id",), "PostedShip"), Role("Rank", ("rank_id",))), (("is posted to", 0, 1), ("is posted as", 0, 2), ("musters", 1, 0), ("needs", 1, 2)))
    source = frames(
        crew=spark.createDataFrame([(1, "Ada"), (2, "Bo")], "crew_id int, name string"), ship=spark.createDataFrame([(1, "Gull"), (2, "Tern")], "ship_id int, name string"), rank=spark.createDataFrame([(1, "mate"), (2, "cook")], "rank_id int, name string"),
        service=spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 2, 3)], "crew_id int, ship_id int, months int"), posting=spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 2, 2)], "crew_id int, ship_id int, rank_id int"),
    )
    ask = lambda t: sorted(tuple(r) for r in run(spark, m, source, t).collect())
    assert m.problems() == []
    assert ask("LIST n, s FROM Crew has CrewName n AND ALSO has Service is on Ship has ShipName s") == [("Ada", "Gull"), ("Ada", "Tern"), ("Bo", "Tern")]
    assert ask("LIST n, t FROM Ship has ShipName n AND ALSO is place of Service has Months x AND ALSO THE SUM OF x GROUPED BY n AS t") == [("Gull", 5), ("Tern", 10)]
    assert ask("LIST n, r FROM Crew has CrewName n AND ALSO is posted as Rank has RankName r") == [("Ada", "cook"), ("Ada", "mate"), ("Bo", "cook")]
    assert ask("LIST n, s FROM DISTINCT Crew has CrewName n AND ALSO is posted to PostedShip has ShipName s") == [("Ada", "Gull"), ("Bo", "Tern")]
    assert ask("THE SUM OF x IN Ship needs Rank AND ALSO is place of Service has Months x") == [(15,)]


def test_glossary_and_readings():
    from factweave.model import Model

    derive.glossary({"vsl": "Vessel", "tbl": ""})
    try:
        assert derive.type_name("tbl_vsls") == "Vsl" and derive.type_name("tbl_vsl") == "Vessel" and derive.value_name("Vessel", "vsl_nm") == "VesselVesselName"
    finally:
        derive.glossary({})
    m = Model("m").entity("Trip", "trip", "id").entity("Port", "port", "id")
    m.reference("Trip", "Port", ("from_port",), "has", "is of").reference("Trip", "Port", ("to_port",), "has", "is of")
    assert len(derive.distinct_readings(m)) == 2
    assert [f.readings for f in m.facts] == [(("has", 0, 1), ("is of", 1, 0)), (("has to port", 0, 1), ("is of to port", 1, 0))]
