"""Functions and aggregates of one's own, row identities, order and gathers in corners."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave.functions import aggregates, scalar
from factweave.language.parser import QueryError
from factweave.reverse import mine
from factweave.sources.surrogate import with_row_id


def test_own_functions_and_aggregates(ferries):
    scalar.FUNCTIONS["shout"] = lambda s: F.concat(F.upper(s), F.lit("!"))

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    aggregates.register("spread", spread)
    aggregates.register("mode", F.mode)
    try:
        assert ferries("LIST t FROM Ferry: 12 has FerryName n AND ALSO shout(n) AS t") == [("BRISE!",)]
        assert sorted(ferries("LIST f, s FROM Ferry has Fuel f AND ALSO has Seats x AND ALSO THE SPREAD OF x GROUPED BY f AS s")) == [("diesel", 150.0), ("electric", 40.0), ("steam", 0.0)]
        assert ferries("THE MODE OF h IN Cargo is of Goods: 'FI' has Hazard h") == [(1,)]
    finally:
        del scalar.FUNCTIONS["shout"]
        aggregates.AGGREGATES.clear()


def test_row_identities_are_kept(spark):
    df = with_row_id(spark.range(100).repartition(5).select((F.col("id") % 3).alias("v")))
    assert df.select("row_id").distinct().count() == 100
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        with_row_id(df)


def test_order_by_head_and_tail_and_composites(ferries):
    assert [r[0] for r in ferries("LIST n FROM Ferry has FerryName n ORDERED DESCENDING")] == ["Elster", "Dorsch", "Condor", "Brise", "Albatros"]
    assert [r[0] for r in ferries("Ferry has FerryName ORDERED WITH TAIL DESCENDING THE FIRST 2")] == [15, 14]
    assert ferries("LIST t FROM Cargo c has Tonnes t ORDERED WITH c THE FIRST 3") == [(5,), (2,), (1,)]


def test_a_gathered_element_has_its_own_order_and_cut(ferries):
    rows = dict(ferries("runs Sailing has Riders x AS h ORDERED WITH x DESCENDING THE FIRST 1 EACH Ferry"))
    assert rows == {11: [150], 12: [75], 13: [300], 14: [38], 15: []}


def test_unconnected_ranges_only_where_permitted(ferries):
    text = "LIST n, g FROM Ferry has FerryName n AND ALSO Goods has GoodsName g"
    with pytest.raises(QueryError):
        ferries(text)
    assert len(ferries(text, permissive=True)) == 20


def test_labels_of_unnamed_expressions_are_their_text(spark, ferries):
    from factweave.plans.compiler import run

    df = run(spark, ferries.model, ferries.source, "LIST n, round(s / 12,  2) FROM Ferry has FerryName n AND ALSO has Seats s")
    assert df.columns == ["n", "round(s / 12, 2)"]


def test_document_quality_and_referenced_keys(spark):
    docs = spark.createDataFrame([('{"a": " x"}',), ('{"a": "n/a"}',)], "d string")
    found = {(r.column, r.finding) for r in mine.document_quality(docs, "d", {"$.a": "string"}).collect()}
    assert {("a", "padded"), ("a", "sentinel for null")} <= found
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, code string")
    assert mine.referenced_key(df, mine.facts(df), ("id",), [("code",), ("code",)]) == ("code",)
    assert mine.referenced_key(df, mine.facts(df), ("id",), [("id",), ("code",)]) == ("id",)


FUNCTION_TABLE = {
    "length('héé')": 3,
    "substr('abcdef', 2, 3)": "bcd",
    "substr('abcdef', -2)": "ef",
    "instr('banana', 'na')": 3,
    "concat('a', 1, 'b')": "a1b",
    "div(-7, 2)": -3,
    "div(7, 0)": None,
    "div(9007199254740993, 1)": 9007199254740993,
    "div(-9007199254740995, 2)": -4503599627370497,
    "7 / 2": 3.5,
    "1 / 0": None,
    "round(2.5)": 3.0,
    "round(-2.5)": -3.0,
    "2 ^ 3 ^ 2": 64.0,
    "sqrt(-1)": None,
    "ln(0)": None,
    "greatest(1, nullif(2, 2))": None,
    "least(3, 2)": 2,
    "coalesce(nullif('a', 'a'), 'z')": "z",
    "castInteger('104 days')": 104,
    "castNumber('-1.5e2x')": -150.0,
    "castNumber('x')": None,
    "year('2023/12/21')": 2023,
    "month('21/12/2023')": 12,
    "day('1/12/2023')": 1,
    "year('no date')": None,
    "days_between('2024-03-01', '2024-02-28')": 2,
    "if(like('Banana', '%AN%'), 1, 0)": 1,
    "if(contains('50% off', '%'), 1, 0)": 1,
    "if(contains('50 off', '%'), 1, 0)": 0,
    "jsonPath('{\"a\":{\"b\":5}}', '$.a.b')": "5",
    "jsonObject('k', 1, 'n', nullif(1, 1))": '{"k":1,"n":null}',
    "trim('  x ')": "x",
    "replace('aXa', 'X', '-')": "a-a",
}


@pytest.mark.parametrize("text", FUNCTION_TABLE)
def test_function(ferries, text):
    got = ferries(f"LIST {text} AS v FROM Port: 1 has PortName c")[0][0]
    want = FUNCTION_TABLE[text]
    assert got == want or (want is not None and isinstance(want, float) and abs(got - want) < 1e-9)
