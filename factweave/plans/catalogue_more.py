"""More registered queries: functions, refusals, definitions, and what is asked of catalogues, rows and models.

Each key names the operator that it shows, beside SQL over the same tables. What
no table holds (a refusal, a finding, a sentence) is compared with stated rows.
"""

from __future__ import annotations

import io
import json
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import explain, export
from ..functions import aggregates, scalar
from ..language import normal
from ..language.parser import QueryError, parse
from ..model import Constraint, Model, Role, Rule
from ..reverse import catalog as declared
from ..reverse import derive, mine, passes, review
from ..service import Service, loop, shown
from ..sources.surrogate import with_row_id
from ..sources.tables import files, frames, jdbc_options, unbound
from ..sqlguard import check
from . import tpch
from .compiler import run, violations

Query = Callable[[SparkSession, str], DataFrame]

#: key: (path query over the driver's model, SQL)
PATHS: dict[str, tuple[str, str]] = {
    "B3_label": ("LIST n, floor(b / 2) FROM Customer has CustomerName n AND ALSO has Balance b", 'select c_name as n, cast(floor(c_acctbal / 2) as bigint) as "floor(b / 2)" from customer'),
    "D2_where": ("LIST n, m FROM Customer has CustomerName n AND ALSO has Balance b WHERE b > 5000 AND ALSO is from Nation has NationName m", "select c_name as n, n_name as m from customer join nation on c_nationkey = n_nationkey where c_acctbal > 5000"),
    "D20_empty_subset": (
        "LIST k FROM Order has OrderKey k WHERE has LineItem has ReturnFlag IS A SUBSET OF Order: 1 has LineItem has ReturnFlag",
        "select o_orderkey as k from orders where not exists (select l_returnflag from lineitem where l_orderkey = o_orderkey except select l_returnflag from lineitem where l_orderkey = 1)",
    ),
    "E13_gathered": ("is base of Supplier has SupplierKey AS s EACH Nation has NationName n", "select n_nationkey as Nation, n_name as NationName, coalesce((select list(s_suppkey order by s_suppkey) from supplier where s_nationkey = n_nationkey), []) as s from nation"),
    "E25_text_operand": (
        "LIST t, s FROM Event has EventType t AND ALSO has EventProps p AND ALSO jsonPath(p, '$.k') AS k AND ALSO THE SUM OF k GROUPED BY t AS s",
        "select event_type as t, sum(cast(json_extract_string(props, '$.k') as double)) as s from events group by 1",
    ),
    "F7_dispersion": ("LIST k, round(d, 4) AS sd FROM Customer has CustomerKey k AND ALSO has Balance b AND ALSO is from Nation n AND ALSO THE STANDARD DEVIATION OF b WITHIN n AS d", "select c_custkey as k, round(stddev_samp(c_acctbal) over (partition by c_nationkey), 4) as sd from customer"),
    "G2_head": ("Nation has NationName ORDERED DESCENDING THE FIRST 7", "select n_nationkey as Nation, n_name as NationName from nation order by n_nationkey desc limit 7"),
    "G7_composite": ("LIST r FROM Turn t has SpeakerRole r ORDERED WITH t THE FIRST 31", "select role as r from conversations order by conv_id, turn limit 31"),
    "I3_whole_division": ("LIST k, div(k, 7) AS q, div(0 - k, 7) AS m, div(k, k - k) AS z FROM Part has PartKey k", "select p_partkey as k, p_partkey // 7 as q, cast(-(p_partkey // 7) as bigint) as m, cast(null as bigint) as z from part"),
    "I4_power": ("LIST k, s ^ 3 AS c, power(s, 2) AS q FROM Part has PartKey k AND ALSO has PartSize s", "select p_partkey as k, cast(pow(p_size, 3) as double) as c, cast(pow(p_size, 2) as double) as q from part"),
    "I8_substr": ("LIST k, substr(n, 3) AS a, substr(n, 2, 4) AS b, substr(n, -3) AS c FROM Part has PartKey k AND ALSO has PartName n", "select p_partkey as k, substr(p_name, 3) as a, substr(p_name, 2, 4) as b, right(p_name, 3) as c from part"),
    "I9_concat": ("LIST k, concat(n, ': ', s, nullif(s, s)) AS z, concat(n, ': ', s) AS c FROM Part has PartKey k AND ALSO has PartName n AND ALSO has PartSize s", "select p_partkey as k, cast(null as varchar) as z, p_name || ': ' || p_size as c from part"),
    "I10_instr": ("LIST k, instr(n, 'r') AS i FROM Part has PartKey k AND ALSO has PartType n", "select p_partkey as k, cast(instr(p_type, 'r') as integer) as i from part"),
    "I11_replace": ("LIST k, replace(b, 'Brand', 'B') AS r FROM Part has PartKey k AND ALSO has Brand b", "select p_partkey as k, replace(p_brand, 'Brand', 'B') as r from part"),
    "I13_trim": ("LIST k, trim(concat('  ', b, ' ')) AS t, ltrim(concat('  ', b, ' ')) AS l, rtrim(concat('  ', b, ' ')) AS r FROM Part has PartKey k AND ALSO has Brand b", "select p_partkey as k, p_brand as t, p_brand || ' ' as l, '  ' || p_brand as r from part"),
    "I16_affixes": (
        "LIST k FROM Part has PartKey k AND ALSO has PartType t AND ALSO has Brand b WHERE (starts_with(t, 'eco') OR ends_with(t, 'ALL') OR contains(b, '#2')) AND NOT contains(b, '%')",
        "select p_partkey as k from part where (lower(p_type) like 'eco%' or lower(p_type) like '%all' or p_brand like '%#2%') and instr(p_brand, '%') = 0",
    ),
    "I18_today": ("LIST k, days_between(today(), today()) AS d FROM Order has OrderKey k AND ALSO has OrderDate o WHERE days_between(today(), o) > 0", "select o_orderkey as k, cast(0 as integer) as d from orders where o_orderdate < current_date"),
    "I19_days_between": ("LIST k, days_between(s, d) AS n FROM Order has OrderKey k AND ALSO has OrderDate d AND ALSO has LineItem has ShipDate s", "select o_orderkey as k, cast(datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as integer) as n from lineitem join orders on l_orderkey = o_orderkey"),
    "I22_json_object": ("LIST k, jsonObject('name', n, 'none', nullif(k, k)) AS o FROM Nation has NationKey k AND ALSO has NationName n", "select n_nationkey as k, '{\"name\":\"' || n_name || '\",\"none\":null}' as o from nation"),
    "I23_json": ("LIST k, json(p) AS j, json('{broken') AS z FROM Event has EventKey k AND ALSO has EventProps p", "select event_id as k, replace(props, ' ', '') as j, cast(null as varchar) as z from events"),
    "I25_defaults": ("LIST k, round(b) AS r, substr(n, 10) AS s FROM Customer has CustomerKey k AND ALSO has Balance b AND ALSO has CustomerName n", "select c_custkey as k, round(c_acctbal, 0) as r, substr(c_name, 10) as s from customer"),
    "J3_implied_key": (
        "DEFINE Spent ::= LIST c, t FROM Customer c placed Order has TotalPrice p AND ALSO THE SUM OF p GROUPED BY c AS t\nLIST round(THE SUM OF t IN Customer has Spent SpentT t AND ALSO placed Order o, 2) AS s",
        "select round(sum(o_totalprice), 2) as s from orders",
    ),
    "J7_used_twice": (
        "DEFINE Rich ::= LIST c FROM Customer c has Balance b WHERE b > 8000\nLIST n, THE COUNT OF Rich AS w, x FROM Rich r is from Nation has NationName n AND ALSO THE COUNT OF r GROUPED BY n AS x",
        "with r as (select * from customer where c_acctbal > 8000) select n_name as n, (select count(*) from r) as w, count(*) as x from r join nation on c_nationkey = n_nationkey group by 1",
    ),
}


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def stated(columns: str, *rows: tuple) -> str:
    """SQL of stated rows."""
    lit = lambda v: "true" if v is True else "false" if v is False else "cast(null as varchar)" if v is None else f"cast({v} as bigint)" if isinstance(v, int) else f"cast({v} as double)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({columns})"


# -- models of their own over the driver's tables --------------------------------------------


def _ask(model: Model, text: str, source: Callable[[SparkSession, str], Callable], **more) -> Query:
    return lambda spark, d: run(spark, model, source(spark, d), text, **more)


def _labelled(spark: SparkSession, d: str):
    """Documents beside their labels, null where they have none."""
    read = files(spark, d)
    return frames(docs=read("documents").select("doc_id", "lang").join(read("labels"), "doc_id", "left"), labels=read("labels"))


def _documents() -> Model:
    m = Model("documents").entity("Doc", "docs", "doc_id").entity("Label", "labels", "doc_id")
    m.attribute("Doc", "DocNr", "doc_id", "long").attribute("Doc", "Language", "lang").attribute("Doc", "Quality", "quality", "int").attribute("Doc", "Toxic", "toxic", "int")
    m.reference("Doc", "Label", ("doc_id",), "bears", "is borne by", enforced=False)
    return m


def _by_name(spark: SparkSession, d: str):
    """Customers that refer to nations by name."""
    read = files(spark, d)
    named = read("customer").join(read("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", F.col("n_name").alias("nation"))
    return frames(customers=named, nation=read("nation"))


def _names() -> Model:
    m = Model("names").entity("Client", "customers", "c_custkey").entity("Nation", "nation", "n_nationkey")
    m.attribute("Client", "ClientNr", "c_custkey", "long").attribute("Nation", "RegionNr", "n_regionkey", "int")
    m.reference("Client", "Nation", ("nation",), "is from", "is home of", references=("n_name",))
    return m


def _supplies() -> Model:
    m = Model("supplies").entity("Part", "part", "p_partkey").entity("Supplier", "supplier", "s_suppkey").entity("Order", "orders", "o_orderkey")
    m.attribute("Part", "Brand", "p_brand").attribute("Supplier", "SupplierName", "s_name").attribute("Supplier", "SupplierNr", "s_suppkey", "long")
    m.objectified("Supply", "supply", (("Supplier", ("l_suppkey",), "is by", "makes"), ("Part", ("l_partkey",), "is of", "comes by")))
    m.attribute("Supply", "Units", "units", "double")
    m.fact("Shipping", "lineitem", (Role("Supplier", ("l_suppkey",), "Shipper"), Role("Part", ("l_partkey",), "Shipped"), Role("Order", ("l_orderkey",))), (("ships", 0, 1), ("is shipped by", 1, 0), ("serves", 0, 2)))
    return m


def _supply(spark: SparkSession, d: str):
    read = files(spark, d)
    supply = read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("units"))
    tables = {t: read(t) for t in ("part", "supplier", "orders", "lineitem")}
    return frames(supply=supply, **tables)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turns = files(spark, d)("conversations")
    step = F.col("conv_id") * 100_000 + F.col("turn")
    return turns.select("conv_id", step.alias("step"), F.lead(step).over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_step"))


def _ring() -> Model:
    m = Model("ring").entity("Step", "steps", "step")
    m.attribute("Step", "StepNr", "step", "long")
    m.reference("Step", "Step", ("next_step",), "has next", "is next of", role="NextStep")
    return m


def _ruled() -> Model:
    m = tpch.model()
    m.rules.append(Rule("Debtor", "LIST c FROM Customer c has Balance b WHERE b < 0"))
    m.rules.append(Rule("Volume", "LIST c, n FROM Customer c placed Order o AND ALSO THE COUNT OF o GROUPED BY c AS n"))
    return m


STEPS = "select conv_id * 100000 + turn as a, lead(conv_id * 100000 + turn) over (partition by conv_id order by turn) as b from conversations"
LABELLED = "select d.doc_id, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id"


def _own_function(spark: SparkSession, d: str) -> DataFrame:
    scalar.FUNCTIONS.setdefault("initial", lambda s: F.upper(F.left(s, F.lit(1))))
    return run(spark, tpch.model(), files(spark, d), "LIST k, initial(b) AS i FROM Customer has CustomerKey k AND ALSO has Segment b")


def _own_aggregate(spark: SparkSession, d: str) -> DataFrame:
    aggregates.register("span", lambda x: F.max(x) - F.min(x))
    return run(spark, tpch.model(), files(spark, d), "LIST s, r FROM Customer has Segment s AND ALSO has Balance b AND ALSO THE SPAN OF b GROUPED BY s AS x AND ALSO round(x, 2) AS r")


#: Queries without a single meaning, by the operator whose rule refuses them.
REFUSALS = {
    "B10": ["LIST k FROM Customer has CustomerKey k AND ALSO (has Balance b OR OTHERWISE has Segment: 'BUILDING')"],
    "C23": ["LIST n FROM Nation: 'FRANCE' has NationName n", "LIST r FROM Turn: 3 has SpeakerRole r"],
    "C26": ["LIST k FROM Order has OrderKey k AND ALSO is placed by Customer x AND ALSO has LineItem is for Part x"],
    "E21": ["LIST n, c FROM Customer k is from Nation has NationName n AND ALSO placed Order o AND ALSO THE COUNT OF k GROUPED BY n AS c"],
    "F9": ["LIST r FROM Part has PartSize s AND ALSO THE RANK OF s AS r", "LIST q FROM Part has PartSize s AND ALSO THE RANK OF s WITHIN 1 AS r AND ALSO THE RANK OF r WITHIN 1 AS q", "LIST n, c FROM Customer k has CustomerName n AND ALSO has Segment s AND ALSO placed Order o AND ALSO THE COUNT OF k WITHIN s AS c"],
    "G8": ["LIST n FROM Nation has NationName n ORDERED WITH nothing"],
    "H5": ["(LIST n FROM Nation has NationName n) UNITED WITH (LIST n, k FROM Nation has NationName n AND ALSO has NationKey k)"],
    "I24": ["LIST s FROM Part has PartSize x AND ALSO soundex(x) AS s"],
    "J12": ["THE REVERSE OF Part"],
}


def _refused(key: str) -> Query:
    def rows(spark: SparkSession, d: str) -> DataFrame:
        out = []
        for i, text in enumerate(REFUSALS[key]):
            try:
                run(spark, tpch.model(), files(spark, d), text)
                out.append((i, False))
            except QueryError:
                out.append((i, True))
        return _rows(spark, out, "query long, refused boolean")

    return rows


# -- sources, sinks, miners, models ----------------------------------------------------------

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """What Spark's catalogue says of the tables, as a session's views."""
    for t in ("nation", "supplier"):
        files(spark, d)(t).createOrReplaceTempView(f"listed_{t}")
    found = declared.from_spark(spark)
    return _rows(spark, [(n.removeprefix("listed_"), c.name) for n, t in found.items() if n.startswith("listed_") for c in t.columns], "table_name string, column_name string")


DECLARED = json.dumps({"orders": {"columns": {"o_orderkey": "long", "o_custkey": "long"}, "key": ["o_orderkey"], "foreign": [{"columns": ["o_custkey"], "table": "customer", "references": ["c_custkey"]}, {"columns": ["o_orderkey"], "table": "nation", "references": ["n_nationkey"]}]}, "customer": {"columns": {"c_custkey": "long"}, "key": ["c_custkey"]}, "nation": {"columns": {"n_nationkey": "int"}, "key": ["n_nationkey"]}})


def _keys(spark: SparkSession, d: str) -> DataFrame:
    found = declared.from_json(DECLARED)
    return _rows(spark, [(n, ", ".join(t.key), len(t.foreign)) for n, t in found.items()], "name string, key string, refs long")


def _crossed(spark: SparkSession, d: str) -> DataFrame:
    text = json.dumps({"a": {"columns": {"x": "int", "y": "int"}, "foreign": [{"columns": ["x", "y"], "table": "b", "references": ["y", "x"]}]}, "b": {"columns": {"x": "int", "y": "int"}, "key": ["x", "y"]}})
    f = declared.from_json(text)["a"].foreign[0]
    return _rows(spark, list(zip(f.columns, f.references)), "child string, parent string")


def _verified(spark: SparkSession, d: str) -> DataFrame:
    found = declared.from_json(DECLARED)
    declared.verify(found, files(spark, d))
    return _rows(spark, [(t.name, f.table, f.enforced) for t in found.values() for f in t.foreign], "child string, parent string, enforced boolean")


def _violated(spark: SparkSession, d: str) -> DataFrame:
    """A reference that rows break is not enforced, one that all keep is."""
    key = {"columns": {"doc_id": "long"}, "key": ["doc_id"]}
    refer = lambda t: {"foreign": [{"columns": ["doc_id"], "table": t, "references": ["doc_id"]}]}
    found = declared.from_json(json.dumps({"documents": key | refer("labels"), "labels": key | refer("documents")}))
    read = files(spark, d)
    declared.verify(found, read)
    return _rows(spark, [(n, mine.missing(read(n), ("doc_id",), read(t.foreign[0].table), ("doc_id",)).count(), t.foreign[0].enforced) for n, t in found.items()], "child string, orphans long, enforced boolean")


def _row_ids(spark: SparkSession, d: str) -> DataFrame:
    return with_row_id(files(spark, d)("lineitem")).agg(F.count_distinct("row_id").alias("ids"), F.count(F.lit(1)).alias("rows"))


def _said(text: str, *lines: str) -> list[tuple[str, bool]]:
    return [(x, x in text) for x in lines]


def _terminal(spark: SparkSession, d: str) -> DataFrame:
    ask = lambda t: shown(spark, run(spark, tpch.model(), files(spark, d), t), 10).splitlines()[-1].split(":")[0]
    return _rows(spark, [("some", ask("LIST n FROM Region has RegionName n")), ("many", ask("LIST n FROM Nation has NationName n")), ("none", ask("LIST n FROM Nation: 99 has NationName n"))], "asked string, said string")


def _exported(spark: SparkSession, d: str) -> DataFrame:
    m = tpch.model()
    back = Model.from_json(m.to_json())
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "model.html"
        path.write_text(export.html(m))
        drawn = sum(f">{e}<" in path.read_text() for e in m.entities)
    return _rows(spark, [("json keeps the model", int(back.to_json() == m.to_json())), ("faults of the xml", len(export.check_xml(export.orm_xml(m)))), ("entity types drawn", drawn)], "what string, n long")


def _text_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their faults: padded, as text, with sentinels, half empty."""
    o = files(spark, d)("orders")
    return o.select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderkey") % 5 == 0, "N/A").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.lit("EUR").alias("currency"), F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderstatus")).alias("note"),
    )


QUALITY_SQL = """
with t as (select case when o_orderkey % 3 = 0 then ' ' || o_orderstatus else o_orderstatus end as status, cast(o_totalprice as varchar) as price, strftime(o_orderdate, '%Y-%m-%d') as day,
  case when o_orderkey % 5 = 0 then 'N/A' else o_orderpriority end as priority, 'EUR' as currency, case when o_orderkey % 50 = 0 then o_orderstatus end as note from orders)
select 'status' as "column", 'padded' as finding, count(distinct status) as "values", count(*) as rows from t where status <> trim(status)
union all select 'status', 'variants in case or spacing', count(distinct status), count(*) from t
union all select 'price', 'number as text', (select count(distinct o_totalprice) from orders), count(*) from t
union all select 'day', 'date as text', count(distinct day), count(*) from t
union all select 'priority', 'sentinel for null', 1, count(*) from t where priority = 'N/A'
union all select 'currency', 'constant', 1, count(*) from t
union all select 'note', 'sparse', count(distinct note), count(note) from t
"""


def _null_table(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    return read("documents").select("doc_id", "lang").join(read("labels"), "doc_id", "left").withColumn("unlabelled", F.when(F.col("quality").isNull(), F.lit(1)))


def _computed(spark: SparkSession, d: str) -> DataFrame:
    df = files(spark, d)("lineitem").select("l_quantity", "l_extendedprice", "l_tax", (F.col("l_quantity") * F.col("l_tax")).alias("duty"), "l_returnflag", "l_linestatus", F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("both"))
    return _rows(spark, [(x,) for x in mine.computed(df)], "formula string")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    counts = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    parent = read("customer").select("c_custkey", "c_acctbal").join(counts, "c_custkey")
    return _rows(spark, [(x,) for x in mine.stored_aggregates(parent, "c_custkey", read("orders").select("o_custkey", "o_totalprice"), "o_custkey")], "said string")


def _ring_laws(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [mine.ring(_turns(spark, d), "step", "next_step")], "irreflexive boolean, acyclic boolean")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    pairs = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("nation", "n_regionkey", "customer", "c_custkey"))
    rows = [(f"{c}.{a}", p, (s := mine.spread(read(c), a, read(p), k)) is not None and s > 0.9, s is not None and s < 0.2) for c, a, p, k in pairs]
    return _rows(spark, rows, "child string, parent string, even boolean, at_one_end boolean")


def _spread_sql(child: str, column: str, parent: str, key: str) -> str:
    """1 - 2 W1 of exact quantiles."""
    return (
        f"select '{child}.{column}' as child, '{parent}' as parent, w > 0.9 as even, w < 0.2 as at_one_end from (select 1 - 2 * avg(abs(q - i / 20.0)) as w from (select unnest(range(21)) as i, unnest(list_transform(range(21), lambda j: s[greatest(1, cast(ceil(j * len(s) / 20.0) as bigint))])) as q from "
        f"(select list(p order by p) as s from (select distinct {column} as k from {child}) c join (select {key} as k, (row_number() over (order by {key}) - 1) / (count(*) over () - 1.0) as p from (select distinct {key} from {parent})) r using (k))))"
    )


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    out = []
    for n in ("region", "nation", "customer", "supplier", "part", "orders"):
        known = mine.facts(read(n))
        out.append((n, ", ".join(mine.choose_key(n, read(n), mine.unique_sets(read(n), known, 1), {}))))
    return _rows(spark, out, "name string, key string")


def _data(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> passes.Data:
    found = declared.from_frames(tables)
    for n, k in keys.items():
        found[n].key = k
    return passes.Data(tables, found, {n: mine.facts(df) for n, df in tables.items()}, {})


def _pass(run_pass, tables: Callable[[SparkSession, str], dict], keys: dict) -> Query:
    return lambda spark, d: _rows(spark, [(f.kind, f.subject, f.said) for f in run_pass(_data(spark, tables(spark, d), keys))], "kind string, subject string, said string")


def _pairs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    turns = files(spark, d)("conversations")
    return {"turns": turns.select("conv_id", "turn"), "answers": turns.where("role = 'assistant'").select("conv_id", "turn", "role")}


def _casts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    o = files(spark, d)("orders")
    return {"o": o.select(F.col("o_orderkey").cast("string").alias("nr"), F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")}


def _codes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"p": files(spark, d)("part").select("p_partkey", F.concat(F.lit("P-"), F.lpad("p_partkey", 8, "0")).alias("code"), "p_name")}


def _junk(spark: SparkSession, d: str) -> DataFrame:
    flags = files(spark, d)("lineitem").select("l_returnflag", "l_linestatus", (F.col("l_linenumber") > 3).cast("string").alias("late")).distinct()
    junk = flags.withColumn("nr", F.concat("l_returnflag", "l_linestatus", "late"))
    plain = files(spark, d)("nation")
    return _rows(spark, [("flags", mine.junk_dimension(mine.facts(junk), ("nr",))), ("nation", mine.junk_dimension(mine.facts(plain), ("n_nationkey",)))], "name string, junk boolean")


def _partition(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    rest = read("customer").select("c_custkey")
    return _rows(spark, [("labels", mine.partition_or_subtype(read("labels"), read("documents"))), ("rest", mine.partition_or_subtype(rest, read("customer")))], "name string, kind string")


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    n = files(spark, d)("nation")
    known = mine.facts(n)
    name, key = ("n_name",), ("n_nationkey",)
    return _rows(spark, [("by name", ", ".join(mine.referenced_key(n, known, key, [name, name]))), ("by key", ", ".join(mine.referenced_key(n, known, key, [key, name])))], "referred string, key string")


def _draft(spark: SparkSession, d: str) -> derive.Draft:
    read = files(spark, d)
    found = declared.from_frames({n: read(n) for n in ("nation", "customer", "orders")})
    found["nation"].key, found["customer"].key, found["orders"].key = ("n_nationkey",), ("c_custkey",), ("o_orderkey",)
    found["nation"].checks = ["n_regionkey between 0 and 4"]
    found["orders"].checks = ["o_orderstatus in ('F', 'O', 'P')"]
    found["customer"].foreign = [declared.ForeignKey(("c_nationkey",), "nation", ("n_nationkey",), True)]
    found["orders"].foreign = [declared.ForeignKey(("o_custkey",), "customer", ("c_custkey",), True)]
    for t in found.values():
        for c in t.columns:
            c.nullable = False
    return derive.derive("drafted", found)


def _drafted(text: str) -> Query:
    """A query over a model that was derived, not written."""
    return lambda spark, d: run(spark, _draft(spark, d).model, files(spark, d), text)


def _checked(spark: SparkSession, d: str) -> DataFrame:
    m = _draft(spark, d).model
    return _rows(spark, [(v.name, ", ".join(v.allowed), v.low, v.high) for v in m.values.values() if v.allowed or v.low is not None], "value string, allowed string, low double, high double")


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    draft = derive.Draft(Model("m").entity("Nation", "reviewed_nation", "n_nationkey"), {}, [derive.Finding("key", "reviewed_nation", "is identified", "select n_nationkey from reviewed_nation group by all having count(*) > 1"), derive.Finding("domain", "reviewed_nation.n_name", "only one", "select * from reviewed_nation where n_name <> 'NATION_1'", applied=False)])
    read("nation").createOrReplaceTempView("reviewed_nation")
    text = review.export(draft)
    fails = review.check(spark, text)
    rejected = json.loads(text)
    rejected["claims"][0]["decision"] = "reject"
    kept = json.loads(review.export(draft, json.dumps(rejected)))["claims"][0]["decision"]
    review.verdicts(draft, json.dumps({"domain: reviewed_nation.n_name": True}))
    return _rows(spark, [("claims that rows refute", fails[0][0], fails[0][1]), ("decision kept", kept, 1), ("open claims after verdicts", str(json.loads(review.candidates(draft))), 0)], "what string, said string, n long")


def _linted(spark: SparkSession, d: str) -> DataFrame:
    m = _draft(spark, d).model
    m.value("Unused")
    m.entity("Lonely", "nation", "n_name")
    m.value("Narrow", "int", low=5, high=2)
    found = review.lint(m)
    return _rows(spark, [x for x in found if x[2] in ("Unused", "Narrow") or "Lonely" in x[2]], "severity string, check string, said string")


GUARDED = {"fan": "select sum(c_acctbal) from customer join orders on o_custkey = c_custkey", "plain": "select sum(o_totalprice) from customer join orders on o_custkey = c_custkey", "product": "select count(*) from region cross join nation", "distinct": "select sum(distinct o_totalprice) from orders", "key": "select count(*) from customer join nation on c_custkey = n_nationkey", "through another": "select count(*) from customer c join nation n on c_nationkey = n_nationkey join region r on r_regionkey = n_regionkey"}


def _guarded(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    columns = {}
    for t in ("region", "nation", "customer", "orders"):
        read(t).createOrReplaceTempView(t)
        columns[t] = read(t).columns
    out = [(k, ", ".join(sorted({g.kind for g in check(spark.sql(sql), tpch.model(), columns)}))) for k, sql in GUARDED.items()]
    for t in ("region", "nation", "customer", "orders"):
        spark.catalog.dropTempView(t)
    return _rows(spark, out, "query string, found string")


def _model_says(work: Callable[[Model], list[tuple]], schema: str) -> Query:
    return lambda spark, d: _rows(spark, work(tpch.model()), schema)


def _fixed_points(m: Model) -> list[tuple]:
    from .catalogue import PATHS as first

    out = []
    for k, (text, _) in sorted((first | PATHS).items()):
        if "DEFINE" not in text:
            once = normal.query(parse(m, text).query)
            out.append((k, normal.query(parse(m, once).query) == once))
    return out


def _same_rows(spark: SparkSession, d: str) -> DataFrame:
    """L4: the normal form of a query gives its rows."""
    text = "list n, c from Customer k is from Nation has NationName n and also the count of k grouped by n as c where c is greater than 50"
    return run(spark, tpch.model(), files(spark, d), normal.query(parse(tpch.model(), text).query))


RISKY = {"any two": "LIST n FROM Nation has NationName n THE FIRST 2", "two by name": "LIST n FROM Nation has NationName n ORDERED WITH n THE FIRST 2", "all": "LIST n FROM Nation has NationName n"}


def _served(spark: SparkSession, d: str) -> DataFrame:
    s = Service(spark, tpch.model(), files(spark, d))
    ask = lambda **a: s.answer(json.dumps(a))
    strict = ask(tool="query", arguments={"query": RISKY["any two"], "strict": True})
    rows = ask(tool="query", arguments={"query": "LIST n FROM Nation has NationName n", "limit": 1000})
    return _rows(spark, [("rows", len(rows["result"]["rows"])), ("refused when strict", int("refused" in strict["result"])), ("tools", len([x for x in dir(s) if x.startswith("tool_")])), ("unknown tool", int("error" in ask(tool="none")))], "what string, n long")


def _restricted(spark: SparkSession, d: str) -> DataFrame:
    narrow = Service(spark, tpch.model(), files(spark, d), {"Nation", "NationName"})
    out = []
    for text in ("LIST n FROM Nation has NationName n", "LIST n FROM Customer has CustomerName n"):
        try:
            out.append((text, len(narrow.tool_query(text, 1000)["rows"])))
        except QueryError:
            out.append((text, -1))
    return _rows(spark, out, "query string, n long")


def _looped(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a session, each with the last line of its answer."""
    asked = [":normalise list n from Nation has NationName n", "LIST n FROM Region \\", " has RegionName n", "LIST n FROM Nation has Nothing n", ":quit", "LIST n FROM Nation has NationName n"]
    out = io.StringIO()
    loop(spark, tpch.model(), files(spark, d), asked, out)
    lines = [x for x in out.getvalue().splitlines() if x]
    return _rows(spark, [("normal", lines[0]), ("rows", next(x for x in lines if x.endswith(" rows"))), ("refusals", str(sum("expected" in x for x in lines)))], "asked string, said string")


def _reported(spark: SparkSession, d: str) -> DataFrame:
    text = export.report(_draft(spark, d))
    return _rows(spark, _said(text, "# drafted", "3 entity types", "## Shared domain", "* customer.c_acctbal: unknown"), "line string, said boolean")


def _known(spark: SparkSession, d: str) -> DataFrame:
    draft = _draft(spark, d)
    text = explain.schema(draft.model, {"Order"}, knowledge=draft.findings)
    return _rows(spark, _said(text, "  orders.o_totalprice: additive (additivity)", "  customer.c_acctbal: unknown (additivity)"), "line string, said boolean")


def _violations(spark: SparkSession, d: str) -> DataFrame:
    m = tpch.model()
    m.constraints = [Constraint("every order has a line", "Order BUT NOT has LineItem"), Constraint("prices are positive", "LIST k FROM Order has OrderKey k AND ALSO has TotalPrice t WHERE t <= 0"), Constraint("nobody is in debt", "Customer has Balance b WHERE b < 0")]
    return _rows(spark, [(k, len(v)) for k, v in violations(spark, m, files(spark, d), 20).items()], "rule string, shown long")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    read = files(spark, d)
    return mine.comparisons(read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_shipdate", "o_orderdate"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    m = Model("m").entity("Part", "part", "p_partkey").entity("Doc", "docs", "doc_id")
    m.attribute("Part", "PartSize", "p_size", "int", low=5, high=45).attribute("Part", "Brand", "p_brand", allowed=("Brand#11", "Brand#12"), unique=True).attribute("Part", "PartName", "p_name", mandatory=True)
    m.attribute("Doc", "Quality", "quality", "int", mandatory=True)
    both = _labelled(spark, d)
    return _rows(spark, review.measured(m, lambda t: files(spark, d)("part") if t == "part" else both(t)), "severity string, finding string, subject string, rows long")


def _bound(spark: SparkSession, d: str) -> DataFrame:
    m = tpch.model()
    m.attribute("Nation", "Anthem", "n_anthem").entity("Planet", "planet", "name")
    return _rows(spark, [("as it is", x) for x in unbound(tpch.model(), files(spark, d))] + [("with more", x) for x in unbound(m, files(spark, d))], "model string, lacks string")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """What is asked of a database's session."""
    rows = []
    for url in ("jdbc:postgresql://host/db", "jdbc:sqlite:file.db"):
        o = jdbc_options(url, 60)
        rows.append((url, o["queryTimeout"], o.get("sessionInitStatement", o.get("open_mode"))))
    return _rows(spark, rows, "url string, seconds string, guard string")


def _restricted_sql(spark: SparkSession, d: str) -> DataFrame:
    s = Service(spark, tpch.model(), files(spark, d), {"Nation", "NationName"})
    ask = lambda q: "error" in s.answer(json.dumps({"tool": "sql", "arguments": {"sql": q}}))
    asked = {"allowed": "select n_name from nation", "column": "select n_regionkey from nation", "file": f"select * from parquet.`{d}/customer.parquet`", "write": "drop view nation"}
    out = _rows(spark, [(k, ask(q)) for k, q in asked.items()], "asked string, refused boolean")
    spark.catalog.dropTempView("nation")
    return out


FRAMES: dict[str, tuple[Query, str | None]] = {
    # -- language over models of their own
    "C3_asserted": (_ask(_documents(), "LIST d, q FROM Doc has DocNr d AND ALSO has Quality q", _labelled), "select doc_id as d, quality as q from labels where quality is not null"),
    "C4_existence": (_ask(_documents(), "LIST d FROM Doc has DocNr d AND ALSO bears Label", _labelled), "select doc_id as d from documents where doc_id in (select doc_id from labels)"),
    "C6_unique_column": (_ask(_names(), "LIST k, r FROM Client has ClientNr k AND ALSO is from Nation has RegionNr r", _by_name), "select c_custkey as k, n_regionkey as r from customer join nation on c_nationkey = n_nationkey"),
    "C8_objectified": (_ask(_supplies(), "LIST n, u FROM Supplier has SupplierName n AND ALSO makes Supply [is of Part has Brand: 'Brand#11'] has Units x AND ALSO THE SUM OF x GROUPED BY n AS u", _supply), "select s_name as n, sum(l_quantity) as u from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where p_brand = 'Brand#11' group by 1"),
    "C9_ternary": (_ask(_supplies(), "LIST s, b FROM DISTINCT Supplier has SupplierNr s AND ALSO ships Shipped has Brand b", _supply), "select distinct l_suppkey as s, p_brand as b from lineitem join part on p_partkey = l_partkey"),
    "C10_ring": (_ask(_ring(), "LIST a, b FROM Step has StepNr a AND ALSO has next NextStep has StepNr b", lambda s, d: frames(steps=_turns(s, d))), f"select a, b from ({STEPS}) where b is not null"),
    "C14_product": (_ask(tpch.model(), "LIST r, n FROM Region has RegionName r AND ALSO Nation has NationName n", files, permissive=True), "select r_name as r, n_name as n from region, nation"),
    "D7_unknown": (_ask(_documents(), "LIST d FROM Doc has DocNr d AND ALSO OPTIONALLY has Quality q AND ALSO OPTIONALLY has Toxic t WHERE NOT (q = 1 AND t = 0)", _labelled), f"select doc_id as d from ({LABELLED}) where not (quality = 1 and toxic = 0)"),
    "G3_nulls": (_ask(_documents(), "LIST d, q FROM Doc has DocNr d AND ALSO OPTIONALLY has Quality q ORDERED WITH q DESCENDING, d THE FIRST 300", _labelled), f"select doc_id as d, quality as q from ({LABELLED}) order by quality desc nulls last, doc_id limit 300"),
    "J5_rules": (_ask(_ruled(), "LIST n, v FROM Debtor has CustomerName n AND ALSO has Volume VolumeN v", files), "select c_name as n, count(*) as v from customer join orders on o_custkey = c_custkey where c_acctbal < 0 group by c_custkey, c_name"),
    "J8_constraints": (_violations, "select 'every order has a line' as rule, least(20, count(*)) as shown from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'prices are positive', least(20, count(*)) from orders where o_totalprice <= 0 union all select 'nobody is in debt', least(20, count(*)) from customer where c_acctbal < 0"),
    "J9_own_function": (_own_function, "select c_custkey as k, upper(left(c_mktsegment, 1)) as i from customer"),
    "J10_own_aggregate": (_own_aggregate, "select c_mktsegment as s, round(max(c_acctbal) - min(c_acctbal), 2) as r from customer group by 1"),
    "J13_permissive": (_ask(tpch.model(), "LIST n, c FROM Customer k is from Nation has NationName n AND ALSO placed Order o AND ALSO THE COUNT OF k GROUPED BY n AS c", files, permissive=True), "select n_name as n, count(*) as c from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey group by 1"),
    **{f"{k}_refused": (_refused(k), stated("query, refused", *[(i, True) for i in range(len(v))])) for k, v in REFUSALS.items()},
    # -- sources and sinks
    "A5_bound": (_bound, stated("model, lacks", ("with more", "nation has no column n_anthem"), ("with more", "there is no table planet"))),
    "A6_sessions": (_sessions, stated("url, seconds, guard", ("jdbc:postgresql://host/db", "60", "set session characteristics as transaction read only"), ("jdbc:sqlite:file.db", "60", "1"))),
    "A8_declared_keys": (_keys, stated("name, key, refs", ("orders", "o_orderkey", 2), ("customer", "c_custkey", 0), ("nation", "n_nationkey", 0))),
    "A9_catalogue": (_listed, "select table_name, column_name from information_schema.columns where table_name in ('nation', 'supplier')"),
    "A10_declared_json": (lambda spark, d: _rows(spark, [(n, c.name, c.type) for n, t in declared.from_json(DECLARED).items() for c in t.columns], "name string, field string, type string"), stated("name, field, type", ("orders", "o_orderkey", "long"), ("orders", "o_custkey", "long"), ("customer", "c_custkey", "long"), ("nation", "n_nationkey", "int"))),
    "A11_crossed": (_crossed, stated("child, parent", ("x", "x"), ("y", "y"))),
    "A13_row_ids": (_row_ids, "select count(*) as ids, count(*) as rows from lineitem"),
    "A14_terminal": (_terminal, "select 'some' as asked, count(*) || ' rows' as said from region union all select 'many', 'more than 10 rows' from nation having count(*) > 10 union all select 'none', 'no rows' from nation where n_nationkey = 99 having count(*) = 0"),
    "A15_export": (_exported, stated("what, n", ("json keeps the model", 1), ("faults of the xml", 0), ("entity types drawn", 13))),
    "A15_report": (_reported, stated("line, said", ("# drafted", True), ("3 entity types", True), ("## Shared domain", True), ("* customer.c_acctbal: unknown", True))),
    "A16_diagram": (_model_says(lambda m: [(e, f">{e}<" in export.html(m)) for e in ("Order", "Customer", "LabelledDocument")] + [("the same twice", export.html(m) == export.html(m))], "what string, drawn boolean"), stated("what, drawn", ("Order", True), ("Customer", True), ("LabelledDocument", True), ("the same twice", True))),
    # -- rows say
    "K2_derived": (_drafted("LIST n, c FROM Order o has Customer has Nation has NationName n AND ALSO THE COUNT OF o GROUPED BY n AS c"), "select n_name as n, count(*) as c from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1"),
    "K3_checks": (_checked, stated("value, allowed, low, high", ("NationRegionkey", "", 0.0, 4.0)).replace("as t(", "as u(") + " union all select 'OrderOrderstatus', 'F, O, P', null, null"),
    "K4_names": (lambda spark, d: _rows(spark, [(t, derive.type_name(t), derive.value_name(derive.type_name(t), c, p)) for t, c, p in (("customers", "cust_nr", ""), ("order_lines", "l_qty", "l_"), ("addresses", "zipCode", ""), ("Companies", "vat_no", ""))], "name string, type string, value string"), stated("name, type, value", ("customers", "Customer", "CustomerCustomerNumber"), ("order_lines", "OrderLine", "OrderLineQuantity"), ("addresses", "Address", "AddressZipCode"), ("Companies", "Company", "CompanyVatNumber"))),
    "K7_keys": (_chosen, stated("name, key", ("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))),
    "K9_spread": (_spread, " union all ".join(_spread_sql(*x) for x in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("nation", "n_regionkey", "customer", "c_custkey")))),
    "K10_verified": (_verified, "select 'orders' as child, 'customer' as parent, not exists (select 1 from orders where o_custkey not in (select c_custkey from customer)) as enforced union all select 'orders', 'nation', false where exists (select 1 from orders where o_orderkey in (select n_nationkey from nation))"),
    "K11_violated": (_violated, "select 'documents' as child, count(*) as orphans, false as enforced from documents where doc_id not in (select doc_id from labels) union all select 'labels', count(*), count(*) = 0 from labels where doc_id not in (select doc_id from documents)"),
    "K12_shared_pairs": (
        _pass(passes.shared_pairs, _pairs, {}),
        "select 'shared pair' as kind, 'answers(conv_id, turn)' as subject, 'finds a row of turns' as said from (select count(*) as n, count(distinct (conv_id, turn)) as m from conversations) where n = m",
    ),
    "K13_all_columns": (
        lambda spark, d: mine.domains(files(spark, d)("customer")),
        " union all ".join(
            f"select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as n from customer where (select count(distinct {c}) between 2 and 25 and count({c}) >= 4 * count(distinct {c}) from customer) group by 2" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        ),
    ),
    "K16_dates": (_ordered, " union all ".join(f"select '{a}' as low, '{b}' as high, count(*) as rows, cast(sum(case when {a} > {b} then 1 else 0 end) as bigint) as broken from lineitem join orders on l_orderkey = o_orderkey" for a, b in (("l_shipdate", "o_orderdate"), ("o_orderdate", "l_shipdate")))),
    "K19_all_pairs": (
        lambda spark, d: mine.dependencies(files(spark, d)("nation")),
        " union all ".join(f"select '{a}' as determinant, '{b}' as dependent, count(*) as groups, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as broken from (select {a}, count(distinct {b}) as n from nation group by 1)" for a in ("n_nationkey", "n_name", "n_regionkey") for b in ("n_nationkey", "n_name", "n_regionkey") if a != b),
    ),
    "K14_types": (_pass(passes.storage_types, _casts, {}), stated("kind, subject, said", ("storage type", "o.nr", "every value is a bigint"), ("storage type", "o.price", "every value is a double"), ("storage type", "o.day", "every value is a date"))),
    "K15_null_table": (
        lambda spark, d: mine.null_patterns(_null_table(spark, d), ["quality", "toxic", "unlabelled"]),
        " union all ".join(
            f"select '{a}' as \"left\", '{b}' as \"right\", count(*) as rows, cast(sum(case when {a} is not null and {b} is not null then 1 else 0 end) as bigint) as both, cast(sum(case when {a} is null and {b} is null then 1 else 0 end) as bigint) as neither, cast(sum(case when ({a} is null) <> ({b} is null) then 1 else 0 end) as bigint) as one from (select quality, toxic, case when quality is null then 1 end as unlabelled from ({LABELLED}))"
            for a, b in (("quality", "toxic"), ("quality", "unlabelled"), ("toxic", "unlabelled"))
        ),
    ),
    "K17_computed": (_computed, stated("formula", ("duty = l_quantity * l_tax",), ("both = l_returnflag || '-' || l_linestatus",))),
    "K18_stored": (_stored, stated("said", ("n_orders = count of rows by o_custkey",), ("spent = sum of o_totalprice by o_custkey",))),
    "K20_ring": (_ring_laws, f"select not exists (select 1 from ({STEPS}) where a = b) as irreflexive, not exists (select 1 from ({STEPS}) where b <= a) as acyclic"),
    "K21_codes": (_pass(passes.coded, _codes, {"p": ("p_partkey",)}), stated("kind, subject, said", ("code", "p.code", "is an alternate key of one width"))),
    "K22_junk": (_junk, stated("name, junk", ("flags", True), ("nation", False))),
    "K23_quality": (lambda spark, d: mine.quality(_text_table(spark, d)), QUALITY_SQL),
    "K24_document_quality": (lambda spark, d: mine.document_quality(files(spark, d)("events"), "props", {"$.k": "string"}), "select 'k' as \"column\", 'number as text' as finding, count(distinct json_extract(props, '$.k')) as \"values\", count(*) as rows from events"),
    "K26_joint_nulls": (lambda spark, d: _rows(spark, [(", ".join(g), n) for g, n in mine.joint_nulls(_null_table(spark, d), mine.facts(_null_table(spark, d)))], "columns string, rows long"), f"select 'quality, toxic' as columns, count(*) as rows from ({LABELLED}) where quality is null and toxic is null"),
    "K27_partition": (_partition, "select 'labels' as name, case when (select count(*) from labels) >= 0.995 * (select count(*) from documents) then 'partition' else 'subtype' end as kind union all select 'rest', 'partition'"),
    "K28_referenced": (_referenced, stated("referred, key", ("by name", "n_name"), ("by key", "n_nationkey"))),
    "K30_shared_domains": (lambda spark, d: _rows(spark, [(f.subject,) for f in derive.shared_domains(_draft(spark, d).model)], "types string"), stated("types", ("CustomerName, NationName",))),
    "K31_additivity": (lambda spark, d: _rows(spark, [(c, derive.additivity(c, True)) for c in ("l_quantity", "l_discount", "c_acctbal", "o_totalprice", "account_balance", "p_size")], "name string, kind string"), stated("name, kind", ("l_quantity", "additive"), ("l_discount", "nonAdditive"), ("c_acctbal", "unknown"), ("o_totalprice", "additive"), ("account_balance", "semiAdditive"), ("p_size", "unknown"))),
    "K32_deontic": (lambda spark, d: _rows(spark, [(c.name, run(spark, (x := _draft(spark, d)).model, files(spark, d), c.violation).count()) for c in derive.deontic(_draft(spark, d))], "rule string, broken long"), " union all ".join(f"select '{o} has {v}' as rule, count(*) as broken from {t} where {c} is null" for o, v, t, c in (("Nation", "NationName", "nation", "n_name"), ("Nation", "NationRegionkey", "nation", "n_regionkey"), ("Customer", "CustomerName", "customer", "c_name"), ("Customer", "CustomerAcctbal", "customer", "c_acctbal"), ("Customer", "CustomerMktsegment", "customer", "c_mktsegment"), ("Order", "OrderOrderstatus", "orders", "o_orderstatus"), ("Order", "OrderTotalprice", "orders", "o_totalprice"), ("Order", "OrderOrderdate", "orders", "o_orderdate"), ("Order", "OrderOrderpriority", "orders", "o_orderpriority")))),
    "K33_shapes": (lambda spark, d: _rows(spark, [(f.kind, f.subject) for f in derive.shapes(declared.from_frames({"events": files(spark, d)("events"), "visit": files(spark, d)("nation").select(F.lit(1).alias("phone1"), F.lit(2).alias("phone2"), F.lit("x").alias("kind_type"))}), {})], "kind string, subject string"), stated("kind, subject", ("polymorphic", "events"), ("repeating group", "visit"), ("discriminator", "visit"))),
    "K34_review": (_reviewed, "select 'claims that rows refute' as what, 'domain: reviewed_nation.n_name' as said, count(*) as n from nation where n_name <> 'NATION_1' union all select 'decision kept', 'reject', 1 union all select 'open claims after verdicts', '[]', 0"),
    "K35_judged": (lambda spark, d: _rows(spark, [(c["id"], c["said"]) for c in json.loads(review.candidates(_draft(spark, d))) if c["id"].startswith("shared")], "id string, said string"), stated("id, said", ("shared domain: CustomerName, NationName", "may be one value type, Name"))),
    "K36_measured": (
        _measured,
        "select 'error' as severity, 'absent value' as finding, 'Doc has Quality' as subject, count(*) as rows from documents where doc_id not in (select doc_id from labels) union all select 'error', 'repeated value', 'Part has Brand', count(*) from part where p_brand in (select p_brand from part group by 1 having count(*) > 1) union all select 'error', 'value not allowed', 'Part has Brand', count(*) from part where p_brand not in ('Brand#11', 'Brand#12') union all select 'error', 'value out of range', 'Part has PartSize', count(*) from part where p_size not between 5 and 45",
    ),
    "K36_lint": (_linted, stated("severity, check, said", ("warning", "isolated type", "Lonely plays no role"), ("note", "unused value type", "Unused"), ("note", "unused value type", "Narrow"), ("error", "empty range", "Narrow")).replace("check,", '"check",')),
    # -- a model says
    "L1_explained": (_model_says(lambda m: _said(explain.explain(m, "LIST n FROM Customer [placed Order] has CustomerName n AND ALSO has Balance b WHERE b > 0").text(), "Customer placed Order: OrderIsPlacedByCustomer", "Customer must have a Balance: rows without one are dropped", "List n for each Customer"), "line string, said boolean"), stated("line, said", ("Customer placed Order: OrderIsPlacedByCustomer", True), ("Customer must have a Balance: rows without one are dropped", True), ("List n for each Customer", True))),
    "L2_risks": (_model_says(lambda m: [(k, explain.explain(m, t).risks) for k, t in RISKY.items()], "query string, risks long"), stated("query, risks", ("any two", 1), ("two by name", 0), ("all", 0))),
    "L3_strict": (lambda spark, d: _rows(spark, [(k, "refused" in Service(spark, tpch.model(), files(spark, d)).tool_query(t, strict=True)) for k, t in RISKY.items()], "query string, refused boolean"), stated("query, refused", ("any two", True), ("two by name", False), ("all", False))),
    "L4_normal": (_same_rows, "select n_name as n, count(*) as c from customer join nation on c_nationkey = n_nationkey group by 1 having count(*) > 50"),
    "L5_schema": (_model_says(lambda m: _said(explain.schema(m, relational=True), "  Turn, identified by conv_id, turn", "  LabelledDocument (a Document), identified by doc_id", "  LineItem, identified by , without identity"), "line string, said boolean"), stated("line, said", ("  Turn, identified by conv_id, turn", True), ("  LabelledDocument (a Document), identified by doc_id", True), ("  LineItem, identified by , without identity", True))),
    "L5_knowledge": (_known, stated("line, said", ("  orders.o_totalprice: additive (additivity)", True), ("  customer.c_acctbal: unknown (additivity)", False))),
    "L6_linked": (_model_says(lambda m: [(t,) for t in ("Customer", "Balance", "Nation", "Page", "EventType") if t in explain.link(m, "What is the balance of customers from each nation?")], "type string"), stated("type", ("Customer",), ("Balance",), ("Nation",))),
    "L7_guard": (_guarded, stated("query, found", ("fan", "fan trap"), ("plain", ""), ("product", "cross product"), ("distinct", "sum of distinct"), ("key", "join key"), ("through another", ""))),
    "L8_rules": (_model_says(lambda m: [(x,) for x in explain.rules(m) if x.startswith("Each Nation")], "rule string"), stated("rule", ("Each Nation is identified by its n_nationkey.",), ("Each Nation has exactly one NationKey.",), ("Each Nation has at most one NationName.",), ("Each Nation is in exactly one Region.",), ("Each NationKey is of at most one Nation.",), ("Each NationName is of at most one Nation.",))),
    "L9_ladder": (_model_says(lambda m: [(i, len(x)) for i, x in enumerate(explain.abstraction(m))], "level long, types long"), stated("level, types", (0, 13), (1, 6), (2, 3), (3, 1))),
    "L10_problems": (lambda spark, d: _rows(spark, [(x,) for x in Model("x").entity("A", "a", "id", supertype="B").entity("C", "c").problems()], "problem string"), stated("problem", ("A is a subtype of B, which the model lacks",), ("C has no identifying columns",))),
    "L11_xml": (_model_says(lambda m: [("as written", len(export.check_xml(export.orm_xml(m))) == 0), ("with a role of nobody", len(export.check_xml(export.orm_xml(m).replace('id="_Order"', 'id="_Gone"', 1))) == 0)], "what string, sound boolean"), stated("what, sound", ("as written", True), ("with a role of nobody", False))),
    "L12_ddl": (_model_says(lambda m: [(b, len(explain.annotated_ddl(m, b)) <= b + 40) for b in (500, 2000, 8000)], "budget long, within boolean"), stated("budget, within", (500, True), (2000, True), (8000, True))),
    "L13_service": (_served, "select 'rows' as what, count(*) as n from nation union all select 'refused when strict', 1 union all select 'tools', 7 union all select 'unknown tool', 1"),
    "L15_session": (_looped, "select 'normal' as asked, 'LIST n FROM Nation has NationName n' as said union all select 'rows', count(*) || ' rows' from region union all select 'refusals', '1'"),
    "L14_restricted_sql": (_restricted_sql, stated("asked, refused", ("allowed", False), ("column", True), ("file", True), ("write", True))),
    "L14_restricted": (_restricted, "select 'LIST n FROM Nation has NationName n' as query, count(*) as n from nation union all select 'LIST n FROM Customer has CustomerName n', -1"),
}


def queries() -> dict[str, Query]:
    path = lambda text: lambda spark, d: run(spark, tpch.model(), files(spark, d), text)
    return {k: path(text) for k, (text, _) in PATHS.items()} | {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in (PATHS | FRAMES).items() if sql}
