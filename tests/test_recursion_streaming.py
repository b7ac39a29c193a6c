"""Recursive rules, constraints, streams, plan shapes."""

import re

import pytest

from factweave.language.parser import QueryError
from factweave.model import Constraint, Model, Rule
from factweave.plans import tpch
from factweave.plans.catalogue import PATHS
from factweave.plans.compiler import Compiler, Context, run, violations
from factweave.sources.tables import files, frames
from factweave.streaming import continuous

SF = "/root/testdata/sf0.001"


def chain(source):
    m = Model("chain").entity("Step", "steps", "step")
    m.attribute("Step", "StepNr", "step", "int")
    m.association("Precedes", "steps", ("Step", ("step",)), ("Step", ("next_step",)), "precedes", "follows", (frozenset((0, 1)),))
    m.rules.append(Rule("Reach", source))
    return m


LINEAR = "(LIST a, b FROM Step a precedes Step b) UNITED WITH (LIST a, c FROM Step a has Reach Step b AND ALSO b precedes Step c)"
DOUBLE = "(LIST a, b FROM Step a precedes Step b) UNITED WITH (LIST a, c FROM Step a has Reach Step b AND ALSO b has Reach Step c)"


@pytest.mark.parametrize("source", [LINEAR, DOUBLE])
def test_closure_of_a_cycle_and_of_a_chain(spark, source):
    cycle = frames(steps=spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "step int, next_step int"))
    assert len(run(spark, chain(source), cycle, "LIST a, b FROM Step a has Reach Step b").collect()) == 9
    line = frames(steps=spark.createDataFrame([(i, i + 1) for i in range(6)], "step int, next_step int"))
    assert len(run(spark, chain(source), line, "LIST a, b FROM Step a has Reach Step b").collect()) == 21


def test_a_chain_of_many_rounds(spark):
    line = frames(steps=spark.createDataFrame([(i, i + 1) for i in range(24)], "step int, next_step int"))
    assert len(run(spark, chain(LINEAR), line, "LIST a, b FROM Step a has Reach Step b").collect()) == 300
    with pytest.raises(QueryError, match="still grows"):
        compiler = Compiler(Context(spark, chain(LINEAR), line))
        compiler.recursive("Reach", LINEAR, rounds=5)


def test_constraints_report_counter_examples(spark, ferries):
    m = ferries.model.copy()
    m.constraints = [Constraint("counted", "Sailing BUT NOT has Riders"), Constraint("named", "Ferry BUT NOT has FerryName")]
    found = violations(spark, m, ferries.source)
    assert [r[0] for r in found["counted"]] == [4] and found["named"] == []


def test_sets_are_compared_without_products(spark):
    """D10 to D16 by hash joins alone, whatever may be broadcast; only one-row counts are joined without keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("D10_subset", "D11_superset", "D12_equal", "D13_not_equal", "D14_proper_subset", "D15_disjoint", "D16_bag_cut"):
            plan = run(spark, tpch.model(), files(spark, SF), PATHS[key][0])._jdf.queryExecution().optimizedPlan().toString()
            assert "CartesianProduct" not in plan
            for line in plan.splitlines():
                if re.search(r"Join Inner\s*$|Join Cross|Join Inner, rightHint", line):
                    assert "broadcast" in line, (key, line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_references_to_another_unique_column(spark):
    m = Model("m").entity("Country", "country", "id").entity("City", "city", "id")
    m.attribute("Country", "CountryName", "name").attribute("City", "CityName", "name")
    m.reference("City", "Country", ("country_code",), "is in", "contains", references=("code",))
    source = frames(country=spark.createDataFrame([(1, "AT", "Austria"), (2, "BE", "Belgium")], "id int, code string, name string"), city=spark.createDataFrame([(1, "Wien", "AT"), (2, "Graz", "AT"), (3, "Gent", "BE")], "id int, name string, country_code string"))
    ask = lambda t: sorted(tuple(r) for r in run(spark, m, source, t).collect())
    assert ask("LIST c, n FROM City has CityName c AND ALSO is in Country has CountryName n") == [("Gent", "Belgium"), ("Graz", "Austria"), ("Wien", "Austria")]
    assert ask("LIST n, c FROM Country has CountryName n AND ALSO contains City has CityName c")[0] == ("Austria", "Graz")


def test_dangling_references_are_no_instances(spark):
    m = Model("m").entity("A", "a", "id").entity("B", "b", "id")
    m.attribute("B", "BNr", "id", "int")
    m.reference("A", "B", ("b_id",), "has", "is of", enforced=False)
    source = frames(a=spark.createDataFrame([(1, 1), (2, 9)], "id int, b_id int"), b=spark.createDataFrame([(1,)], "id int"))
    assert [tuple(r) for r in run(spark, m, source, "LIST a, b FROM A a has B b").collect()] == [(1, 1)]


def test_facts_in_a_row_in_hand_cost_no_join(spark):
    plan = lambda t: run(spark, tpch.model(), files(spark, SF), t)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("LIST n, b FROM Customer has CustomerName n AND ALSO has Balance b AND ALSO has Segment: 'BUILDING'")
    assert plan("LIST k, n FROM Order has OrderKey k AND ALSO is placed by Customer has CustomerName n").count("Join") == 1
    assert "LeftSemi" in plan("LIST k FROM Order [has LineItem has ReturnFlag: 'R'] has OrderKey k")
    assert "LeftAnti" in plan("LIST k FROM Order has OrderKey k BUT NOT has LineItem")


def test_aggregates_of_one_bag_share_a_scan(spark):
    df = run(spark, tpch.model(), files(spark, SF), PATHS["E3_basic"][0])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_scans_read_only_what_is_asked(spark):
    plan = run(spark, tpch.model(), files(spark, SF), "LIST n FROM Customer has CustomerName n AND ALSO has Balance b WHERE b > 100")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "c_mktsegment" not in plan


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    static = files(spark, SF)
    growing = lambda name: spark.readStream.schema(schema).parquet(f"{SF}/events*.parquet") if name == "events" else static(name)
    text = "LIST t, c FROM Event e has EventType t AND ALSO is by Customer has Segment: 'BUILDING' AND ALSO THE COUNT OF e GROUPED BY t AS c"
    df = continuous.stream(spark, tpch.model(), growing, text)
    assert df.isStreaming
    q = continuous.start(df, str(tmp_path / "out"), str(tmp_path / "state"), "complete")
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in run(spark, tpch.model(), static, text).collect())


@pytest.mark.parametrize("text", ["LIST k FROM Event has EventKey k ORDERED WITH k", "LIST k FROM Event has EventKey k BUT NOT is by Customer", "LIST r FROM Event has EventValue v AND ALSO THE RANK OF v WITHIN 1 AS r"])
def test_streams_refuse_what_needs_all_rows(spark, text):
    with pytest.raises(QueryError, match="not over a stream"):
        continuous.stream(spark, tpch.model(), files(spark, SF), text)
