"""The registered queries over the driver's tables, each with its SQL.

A key is the operator that the query shows. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..reverse import derive, mine
from ..sources.tables import files, frames
from . import catalogue_more, tpch
from .compiler import run

FLAGSHIP = "LIST n, c FROM Order o is placed by Customer is from Nation has NationName n AND ALSO THE COUNT OF o GROUPED BY n AS c ORDERED WITH c DESCENDING, n"

#: key: (path query, SQL)
PATHS: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "select n_name as n, count(*) as c from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"),
    # -- ranges, scans --------------------------------------------------------------
    "A1_range": ("LIST k FROM Nation has NationKey k", "select n_nationkey as k from nation"),
    "A2_value_range": ("LIST THE AVERAGE Balance AS a", "select avg(c_acctbal) as a from customer"),
    "A3_value_head": ("LIST b, n FROM Brand b is of Part has PartName n", "select p_brand as b, p_name as n from part"),
    "A4_subtype_range": ("DEFINE Rich ::= LIST c FROM Customer c has Balance b WHERE b > 9000\nLIST n FROM Rich has CustomerName n", "select c_name as n from customer where c_acctbal > 9000"),
    "A12_json": ("LIST t, s FROM Event has EventType t AND ALSO has EventK k AND ALSO THE SUM OF k GROUPED BY t AS s WHERE k > 50", "select event_type as t, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as s from events where cast(json_extract(props, '$.k') as bigint) > 50 group by event_type"),
    # -- projection -----------------------------------------------------------------
    "B1_list": ("LIST n, round(b * 2, 2) AS twice FROM Customer has CustomerName n AND ALSO has Balance b", "select c_name as n, round(c_acctbal * 2, 2) as twice from customer"),
    "B2_default": ("Nation is in Region has RegionName", "select n_nationkey as Nation, r_name as RegionName from nation join region on n_regionkey = r_regionkey"),
    "B4_closed": ("LIST THE COUNT OF Customer AS customers, THE COUNT OF Order AS orders, THE COUNT OF Customer * 100 / THE COUNT OF Order AS share", "select (select count(*) from customer) as customers, (select count(*) from orders) as orders, (select count(*) from customer) * 100.0 / (select count(*) from orders) as share"),
    "B5_as": ("LIST n, m FROM Customer has CustomerName n AND ALSO has Balance b AND ALSO (b - 1000) AS m WHERE m > 0", "select c_name as n, c_acctbal - 1000 as m from customer where c_acctbal - 1000 > 0"),
    "B6_distinct": ("LIST s, n FROM DISTINCT Customer has Segment s AND ALSO is from Nation has NationName n", "select distinct c_mktsegment as s, n_name as n from customer join nation on c_nationkey = n_nationkey"),
    "B7_composite": ("LIST t, r FROM Turn t has SpeakerRole r", "select conv_id as t_conv_id, turn as t_turn, role as r from conversations"),
    "B8_only": ("ONLY Nation is in Region: 1", "select n_nationkey as Nation from nation where n_regionkey = 1"),
    "B9_macro": ("LIST k, r FROM LineItem is of Order has OrderKey k AND ALSO has ExtendedPrice p AND ALSO has Discount d AND ALSO revenue(p, d) AS v AND ALSO THE SUM OF v GROUPED BY k AS t AND ALSO round(t, 4) AS r", "select l_orderkey as k, round(sum(l_extendedprice * (1 - l_discount)), 4) as r from lineitem group by l_orderkey"),
    # -- joins ----------------------------------------------------------------------
    "C1_join": ("LIST k, n FROM Order has OrderKey k AND ALSO is placed by Customer is from Nation has NationName n", "select o_orderkey as k, n_name as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"),
    "C2_inverse": ("LIST r, n FROM Region has RegionName r AND ALSO contains Nation has NationName n", "select r_name as r, n_name as n from region join nation on r_regionkey = n_regionkey"),
    "C5_optional": ("LIST n, s FROM Nation has NationName n AND ALSO OPTIONALLY is base of Supplier s", "select n_name as n, s_suppkey as s from nation left join supplier on s_nationkey = n_nationkey"),
    "C7_composite_join": ("LIST c, r FROM Turn has ConversationKey c AND ALSO has SpeakerRole r", "select conv_id as c, role as r from conversations"),
    "C11_round_trip": ("LIST THE COUNT OF Nation is in Region contains Nation AS pairs", "select count(*) as pairs from nation a join nation b on a.n_regionkey = b.n_regionkey"),
    "C12_subtype": ("LIST k, l FROM LabelledDocument has DocumentKey k AND ALSO has Language l AND ALSO has Quality: 1", "select d.doc_id as k, lang as l from documents d join labels l on d.doc_id = l.doc_id where quality = 1"),
    "C13_unify": ("LIST k FROM Order has OrderKey k AND ALSO is placed by Customer is from Nation n AND ALSO has LineItem is supplied by Supplier is based in Nation n", "select o_orderkey as k from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where c_nationkey = s_nationkey"),
    "C15_semi": ("LIST k FROM Order [has LineItem has ReturnFlag: 'R'] has OrderKey k", "select o_orderkey as k from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')"),
    "C16_bind": ("LIST k, q FROM Order [has LineItem [has Quantity q] has ReturnFlag: 'R'] has OrderKey k", "select o_orderkey as k, l_quantity as q from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R'"),
    "C17_anti": ("LIST k FROM Order has OrderKey k BUT NOT has LineItem", "select o_orderkey as k from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"),
    "C18_also": ("LIST n FROM Customer has CustomerName n AND ALSO placed Order has Priority: '1-URGENT'", "select c_name as n from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')"),
    "C19_or": ("LIST n FROM Customer has CustomerName n AND ALSO (placed Order has Priority: '1-URGENT' OR OTHERWISE has Segment: 'BUILDING')", "select c_name as n from customer where c_mktsegment = 'BUILDING' or exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')"),
    "C20_some": ("LIST n FROM Region has RegionName n WHERE SOME (Supplier has SupplierBalance b WHERE b > 100)", "select r_name as n from region where exists (select 1 from supplier where s_acctbal > 100)"),
    "C21_exists": ("LIST n FROM Nation has NationName n WHERE is base of Supplier OR n = 'NATION_3'", "select n_name as n from nation where exists (select 1 from supplier where s_nationkey = n_nationkey) or n_name = 'NATION_3'"),
    "C22_denote": ("LIST n FROM Nation: 3 has NationName n", "select n_name as n from nation where n_nationkey = 3"),
    "C22_denote_composite": ("LIST r FROM Turn: (0, 0) has SpeakerRole r", "select role as r from conversations where conv_id = 0 and turn = 0"),
    "C24_correlate": ("LIST k FROM Order has OrderKey k AND ALSO has TotalPrice t AND ALSO is placed by Customer c WHERE t > THE AVERAGE Order [is placed by Customer: !c] has TotalPrice", "select o_orderkey as k from orders o where o_totalprice > (select avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)"),
    "C25_confluence": ("has RegionName AS region, is home of Customer has Balance AS top ORDERED WITH Balance DESCENDING THE FIRST 2 EACH Nation", ""),
    # -- conditions -----------------------------------------------------------------
    "D1_compare": ("LIST n FROM Customer has CustomerName n AND ALSO has Balance b WHERE b IS GREATER THAN OR EQUAL TO 5000 AND n <> 'x'", "select c_name as n from customer where c_acctbal >= 5000"),
    "D3_logic": ("LIST k FROM Part has PartKey k AND ALSO has PartSize s AND ALSO has Brand b WHERE NOT s > 10 OR (s > 40 AND b = 'Brand#11')", "select p_partkey as k from part where not p_size > 10 or (p_size > 40 and p_brand = 'Brand#11')"),
    "D4_xor": ("LIST k FROM Part has PartKey k AND ALSO has PartSize s AND ALSO has RetailPrice p WHERE s > 25 EXCLUSIVE OR p > 1000", "select p_partkey as k from part where (p_size > 25) <> (p_retailprice > 1000)"),
    "D5_implies": ("LIST k FROM Part has PartKey k AND ALSO has PartSize s AND ALSO has RetailPrice p WHERE s > 25 IMPLIES p > 1000", "select p_partkey as k from part where not (p_size > 25) or p_retailprice > 1000"),
    "D6_iff": ("LIST k FROM Part has PartKey k AND ALSO has PartSize s AND ALSO has RetailPrice p WHERE s > 25 IFF p > 1000", "select p_partkey as k from part where (p_size > 25) = (p_retailprice > 1000)"),
    "D8_choice": ("LIST k, IF s > 25 THEN 'big' ELSE 'small' AS size FROM Part has PartKey k AND ALSO has PartSize s", "select p_partkey as k, case when p_size > 25 then 'big' else 'small' end as size from part"),
    "D9_boolean_call": ("LIST n FROM Nation has NationName n WHERE ends_with(n, '1')", "select n_name as n from nation where n_name like '%1'"),
    "D10_subset": ("LIST k FROM Customer has CustomerKey k AND ALSO placed Order has Priority WHICH ARE ALL IN Customer: 1 placed Order has Priority", "select c_custkey as k from customer where not exists (select o_orderpriority from orders where o_custkey = c_custkey except select o_orderpriority from orders where o_custkey = 1)"),
    "D11_superset": ("LIST k FROM Customer has CustomerKey k AND ALSO placed Order has Priority THAT INCLUDES ALL Customer: 1 placed Order has Priority", "select c_custkey as k from customer where not exists (select o_orderpriority from orders where o_custkey = 1 except select o_orderpriority from orders where o_custkey = c_custkey)"),
    "D12_equal": ("LIST k FROM Customer has CustomerKey k AND ALSO placed Order has Priority MATCHING ALL Customer: 1 placed Order has Priority", "select c_custkey as k from customer where not exists (select o_orderpriority from orders where o_custkey = 1 except select o_orderpriority from orders where o_custkey = c_custkey) and not exists (select o_orderpriority from orders where o_custkey = c_custkey except select o_orderpriority from orders where o_custkey = 1)"),
    "D13_not_equal": ("LIST k FROM Customer has CustomerKey k WHERE placed Order has Priority DOES NOT EQUAL Customer: 1 placed Order has Priority", "select c_custkey as k from customer where exists (select o_orderpriority from orders where o_custkey = 1 except select o_orderpriority from orders where o_custkey = c_custkey) or exists (select o_orderpriority from orders where o_custkey = c_custkey except select o_orderpriority from orders where o_custkey = 1)"),
    "D14_proper_subset": ("LIST k FROM Customer has CustomerKey k WHERE placed Order has Priority IS A PROPER SUBSET OF Customer: 1 placed Order has Priority", "select c_custkey as k from customer where exists (select o_orderpriority from orders where o_custkey = 1 except select o_orderpriority from orders where o_custkey = c_custkey) and not exists (select o_orderpriority from orders where o_custkey = c_custkey except select o_orderpriority from orders where o_custkey = 1)"),
    "D15_disjoint": (
        "LIST k FROM Order has OrderKey k WHERE has LineItem has ReturnFlag IS DISJOINT FROM Order: 1 has LineItem [has LineNumber: 1] has ReturnFlag",
        "select o_orderkey as k from orders where not exists (select l_returnflag from lineitem where l_orderkey = o_orderkey intersect select l_returnflag from lineitem where l_orderkey = 1 and l_linenumber = 1)",
    ),
    "D16_bag_cut": ("LIST n FROM Nation has NationName n WHERE is home of Customer has Segment IS A SUPERSET OF (LIST s FROM Customer has Segment s AND ALSO has CustomerKey k ORDERED WITH k THE FIRST 3)", "select n_name as n from nation where not exists (select s from (select c_mktsegment as s from customer order by c_custkey limit 3) except select c_mktsegment from customer where c_nationkey = n_nationkey)"),
    "D17_restrict": ("LIST k, s FROM Part has PartKey k AND ALSO has medium MediumSize s", "select p_partkey as k, p_size as s from part where p_size between 10 and 20"),
    "D17_enumerated": ("LIST n, s FROM Customer has CustomerName n AND ALSO has big BigSegment s", "select c_name as n, c_mktsegment as s from customer where c_mktsegment in ('BUILDING', 'AUTOMOBILE')"),
    "D18_having": ("LIST n, c FROM Customer k is from Nation has NationName n AND ALSO THE COUNT OF k GROUPED BY n AS c WHERE c > 60", "select n_name as n, count(*) as c from customer join nation on c_nationkey = n_nationkey group by n_name having count(*) > 60"),
    "D19_window_filter": ("LIST k, t FROM Order has OrderKey k AND ALSO has TotalPrice t AND ALSO is placed by Customer c AND ALSO THE RANK OF t WITHIN c AS r WHERE r = 1", "select o_orderkey as k, o_totalprice as t from orders qualify rank() over (partition by o_custkey order by o_totalprice desc) = 1"),
    # -- aggregates -----------------------------------------------------------------
    "E1_count": ("LIST THE COUNT OF LineItem AS c", "select count(*) as c from lineitem"),
    "E2_distinct": ("LIST THE DISTINCT COUNT OF b IN Part has Brand b AS brands, THE DISTINCT SUM OF s IN Part has PartSize s AS sizes", "select count(distinct p_brand) as brands, cast(sum(distinct p_size) as bigint) as sizes from part"),
    "E3_basic": ("LIST round(THE SUM OF q IN LineItem has Quantity q, 2) AS s, THE MINIMUM q IN LineItem has Quantity q AS low, THE MAXIMUM q IN LineItem has Quantity q AS high, round(THE AVERAGE q IN LineItem has Quantity q, 4) AS mean", "select round(sum(l_quantity), 2) as s, min(l_quantity) as low, max(l_quantity) as high, round(avg(l_quantity), 4) as mean from lineitem"),
    "E4_median": ("LIST s, m FROM Customer has Segment s AND ALSO has Balance b AND ALSO THE MEDIAN b GROUPED BY s AS m", "select c_mktsegment as s, median(c_acctbal) as m from customer group by 1"),
    "E5_dispersion": ("LIST s, round(d, 4) AS sd, round(v, 2) AS var FROM Customer has Segment s AND ALSO has Balance b AND ALSO THE STANDARD DEVIATION OF b GROUPED BY s AS d AND ALSO THE VARIANCE OF b GROUPED BY s AS v", "select c_mktsegment as s, round(stddev_samp(c_acctbal), 4) as sd, round(var_samp(c_acctbal), 2) as var from customer group by 1"),
    "E6_list": ("LIST k, l FROM Customer has CustomerKey k AND ALSO placed Order has OrderStatus s AND ALSO THE DISTINCT LIST OF s GROUPED BY k AS l", "select o_custkey as k, list(distinct o_orderstatus order by o_orderstatus) as l from orders group by 1"),
    "E7_joined": ("LIST r, l FROM Region has RegionName r AND ALSO contains Nation has NationName n AND ALSO THE LIST OF n SEPARATED BY ', ' GROUPED BY r AS l", "select r_name as r, string_agg(n_name, ', ' order by n_name) as l from region join nation on n_regionkey = r_regionkey group by 1"),
    "E8_object": ("LIST r, o FROM Region has RegionName r AND ALSO contains Nation n has NationName m AND ALSO n has NationKey k AND ALSO THE OBJECT OF k BY m GROUPED BY r AS o", "select r_name as r, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_name) || '}' as o from region join nation on n_regionkey = r_regionkey group by 1"),
    "E9_group": ("LIST s, y, c FROM Order o is placed by Customer has Segment s AND ALSO has OrderDate d AND ALSO THE COUNT OF o GROUPED BY s, year(d) AS c AND ALSO year(d) AS y", ""),
    "E10_constant": ("LIST c FROM Order o has TotalPrice t AND ALSO THE COUNT OF o GROUPED BY one AS c", "select count(*) as c from orders"),
    "E11_fixed": ("LIST n, s, t FROM Customer c has CustomerName n AND ALSO has Segment s AND ALSO placed Order has TotalPrice p AND ALSO THE SUM OF p GROUPED BY c AS u AND ALSO round(u, 2) AS t", "select c_name as n, c_mktsegment as s, round(sum(o_totalprice), 2) as t from customer join orders on o_custkey = c_custkey group by c_custkey, c_name, c_mktsegment"),
    "E12_expression": ("LIST THE SUM OF round(b, 0) IN Customer has Balance b AS s", "select sum(round(c_acctbal, 0)) as s from customer"),
    "E14_scalar": ("LIST n FROM Customer has CustomerName n AND ALSO has Balance b WHERE b > THE AVERAGE Customer has Balance", "select c_name as n from customer where c_acctbal > (select avg(c_acctbal) from customer)"),
    "E15_correlated": ("LIST n, o FROM Customer c has CustomerName n AND ALSO THE COUNT OF Order [is placed by Customer: !c] AS o", "select c_name as n, (select count(*) from orders where o_custkey = c_custkey) as o from customer"),
    "E16_enclosing": ("LIST n, m FROM Customer has CustomerName n AND ALSO has Balance b AND ALSO THE MAXIMUM (b * 2) AS m WHERE b < 5000", "select c_name as n, max(c_acctbal * 2) over () as m from customer where c_acctbal < 5000"),
    "E17_of_groups": ("LIST round(THE AVERAGE c IN (Order o is placed by Customer k AND ALSO THE COUNT OF o GROUPED BY k AS c), 6) AS mean", "select round(avg(c), 6) as mean from (select count(*) as c from orders group by o_custkey)"),
    "E18_fan": ("LIST round(THE SUM OF t IN Order has TotalPrice t AND ALSO has LineItem l, 2) AS s", "select round(sum(o_totalprice), 2) as s from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)"),
    "E19_pin": ("LIST k, s FROM Order o has OrderKey k AND ALSO has TotalPrice t AND ALSO has LineItem l AND ALSO THE SUM OF t GROUPED BY o AS s", "select o_orderkey as k, o_totalprice as s from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)"),
    "E20_regroup": ("LIST n, s FROM Supplier is based in Nation has NationName n AND ALSO supplies LineItem is of Order has TotalPrice t AND ALSO THE SUM OF t GROUPED BY n AS u AND ALSO round(u, 2) AS s", "select n, round(sum(t), 2) as s from (select distinct n_name as n, o_orderkey, o_totalprice as t from supplier join nation on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey) group by n"),
    "E22_exempt": ("LIST n, m FROM Supplier is based in Nation has NationName n AND ALSO supplies LineItem is of Order has TotalPrice t AND ALSO THE MAXIMUM t GROUPED BY n AS m", "select n_name as n, max(o_totalprice) as m from supplier join nation on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey group by 1"),
    "E23_distinct_path": ("LIST THE COUNT OF DISTINCT Customer [placed Order has Priority: '1-URGENT'] AS c", "select count(distinct o_custkey) as c from orders where o_orderpriority = '1-URGENT'"),
    "E24_operand": ("LIST THE COUNT OF Customer has Segment: 'BUILDING' BUT NOT placed Order has OrderStatus: 'F' AS c", "select count(*) as c from customer where c_mktsegment = 'BUILDING' and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')"),
    # -- windows --------------------------------------------------------------------
    "F1_share": ("LIST k, round(b / t, 6) AS share FROM Customer has CustomerKey k AND ALSO has Balance b AND ALSO is from Nation n AND ALSO THE SUM OF b WITHIN n AS t", "select c_custkey as k, round(c_acctbal / sum(c_acctbal) over (partition by c_nationkey), 6) as share from customer"),
    "F2_rank": ("LIST k, r FROM Customer has CustomerKey k AND ALSO has Balance b AND ALSO has Segment s AND ALSO THE RANK OF b WITHIN s AS r", "select c_custkey as k, cast(rank() over (partition by c_mktsegment order by c_acctbal desc) as integer) as r from customer"),
    "F3_percent_rank": ("LIST k, round(p, 8) AS pr FROM Customer has CustomerKey k AND ALSO has Balance b AND ALSO has Segment s AND ALSO THE PERCENT RANK OF b ASCENDING WITHIN s AS p", "select c_custkey as k, round(percent_rank() over (partition by c_mktsegment order by c_acctbal), 8) as pr from customer"),
    "F4_previous": ("LIST k, p FROM Supplier has SupplierKey k AND ALSO has SupplierBalance b AND ALSO is based in Nation n AND ALSO THE PREVIOUS b BY k WITHIN n AS p", "select s_suppkey as k, lag(s_acctbal) over (partition by s_nationkey order by s_suppkey) as p from supplier"),
    "F5_whole": ("LIST n, r FROM Supplier has SupplierName n AND ALSO has SupplierBalance b AND ALSO THE RANK OF b ASCENDING WITHIN 1 AS r", "select s_name as n, cast(rank() over (order by s_acctbal) as integer) as r from supplier"),
    "F6_computed": ("LIST k, c FROM Order o has OrderKey k AND ALSO has OrderDate d AND ALSO THE COUNT OF o WITHIN year(d) AS c", "select o_orderkey as k, count(*) over (partition by year(o_orderdate)) as c from orders"),
    "F8_over_groups": ("LIST n, c, r FROM Customer k is from Nation has NationName n AND ALSO THE COUNT OF k GROUPED BY n AS c AND ALSO THE RANK OF c WITHIN 1 AS r", "select n_name as n, count(*) as c, cast(rank() over (order by count(*) desc) as integer) as r from customer join nation on c_nationkey = n_nationkey group by 1"),
    # -- order, cuts ----------------------------------------------------------------
    "G1_sort": ("LIST k, b FROM Customer has CustomerKey k AND ALSO has Balance b ORDERED WITH abs(b) DESCENDING, k THE FIRST 20", "select c_custkey as k, c_acctbal as b from customer order by abs(c_acctbal) desc, c_custkey limit 20"),
    "G4_cut": ("LIST k, t FROM Order has OrderKey k AND ALSO has TotalPrice t ORDERED WITH t DESCENDING, k THE FIRST 10 AFTER 5", "select o_orderkey as k, o_totalprice as t from orders order by o_totalprice desc, o_orderkey limit 10 offset 5"),
    "G5_per": ("LIST s, k, b FROM Customer has CustomerKey k AND ALSO has Segment s AND ALSO has Balance b ORDERED WITH b DESCENDING, k THE FIRST 3 PER s", "select c_mktsegment as s, c_custkey as k, c_acctbal as b from customer qualify row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) <= 3"),
    "G6_ties": ("LIST k, s FROM Part has PartKey k AND ALSO has PartSize s ORDERED WITH s DESCENDING THE FIRST 5 WITH TIES", "select p_partkey as k, p_size as s from part qualify rank() over (order by p_size desc) <= 5"),
    # -- set operations -------------------------------------------------------------
    "H1_union": ("(LIST n FROM Customer is from Nation has NationName n) UNITED WITH (LIST n FROM Supplier is based in Nation has NationName n)", "select n_name as n from customer join nation on c_nationkey = n_nationkey union select n_name from supplier join nation on s_nationkey = n_nationkey"),
    "H2_intersect": ("(LIST n FROM Customer [has Segment: 'BUILDING'] is from Nation has NationName n) INTERSECTED WITH (LIST n FROM Supplier is based in Nation has NationName n)", "select n_name as n from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' intersect select n_name from supplier join nation on s_nationkey = n_nationkey"),
    "H3_minus": ("(LIST k FROM Order has OrderKey k) MINUS (LIST k FROM Order [has LineItem] has OrderKey k)", "select o_orderkey as k from orders except select l_orderkey from lineitem"),
    "H4_chain": ("(LIST k FROM Part has PartKey k AND ALSO has PartSize s WHERE s < 10) UNITED WITH (LIST k FROM Part has PartKey k AND ALSO has Brand: 'Brand#11') MINUS (LIST k FROM LineItem [has Quantity q] is for Part has PartKey k WHERE q > 45) ORDERED WITH k", "(select p_partkey as k from part where p_size < 10 union select p_partkey from part where p_brand = 'Brand#11') except select l_partkey from lineitem where l_quantity > 45"),
    # -- functions ------------------------------------------------------------------
    "I1_arithmetic": ("LIST k, -s + 3 * 2 - 1 AS a, round(s / 7, 6) AS d, div(s, 7) AS q, s ^ 2 AS p FROM Part has PartKey k AND ALSO has PartSize s", "select p_partkey as k, -p_size + 5 as a, round(p_size / 7.0, 6) as d, cast(p_size // 7 as bigint) as q, cast(pow(p_size, 2) as double) as p from part"),
    "I2_divide_by_zero": ("LIST k, s / (s - s) AS z FROM Part has PartKey k AND ALSO has PartSize s", "select p_partkey as k, cast(null as double) as z from part"),
    "I5_rounding": ("LIST k, abs(b) AS a, round(b) AS r, floor(b) AS f, ceil(b) AS c FROM Customer has CustomerKey k AND ALSO has Balance b", "select c_custkey as k, abs(c_acctbal) as a, round(c_acctbal, 0) as r, cast(floor(c_acctbal) as bigint) as f, cast(ceil(c_acctbal) as bigint) as c from customer"),
    "I6_roots": ("LIST k, round(sqrt(b), 6) AS q, round(ln(s), 6) AS l, round(exp(s / 100), 6) AS e, round(log10(s), 6) AS t FROM Part has PartKey k AND ALSO has PartSize s AND ALSO has RetailPrice b", "select p_partkey as k, round(sqrt(p_retailprice), 6) as q, round(ln(p_size), 6) as l, round(exp(p_size / 100.0), 6) as e, round(log10(p_size), 6) as t from part"),
    "I7_text": ("LIST k, length(n) AS l, upper(n) AS u, lower(n) AS w, substr(n, 2, 3) AS s, concat(n, '-', b) AS c, instr(n, 'a') AS i, replace(n, 'a', 'o') AS r, trim(concat('  ', n, ' ')) AS t FROM Part has PartKey k AND ALSO has PartName n AND ALSO has Brand b", "select p_partkey as k, cast(length(p_name) as integer) as l, upper(p_name) as u, lower(p_name) as w, substr(p_name, 2, 3) as s, p_name || '-' || p_brand as c, cast(instr(p_name, 'a') as integer) as i, replace(p_name, 'a', 'o') as r, p_name as t from part"),
    "I12_nulls": ("LIST n, coalesce(s, -1) AS s, nullif(k, 3) AS z FROM Nation has NationName n AND ALSO has NationKey k AND ALSO OPTIONALLY is base of Supplier s", "select n_name as n, coalesce(s_suppkey, -1) as s, nullif(n_nationkey, 3) as z from nation left join supplier on s_nationkey = n_nationkey"),
    "I14_greatest": ("LIST k, greatest(s, 20) AS g, least(s, 20) AS l FROM Part has PartKey k AND ALSO has PartSize s", "select p_partkey as k, greatest(p_size, 20) as g, least(p_size, 20) as l from part"),
    "I15_like": ("LIST k FROM Part has PartKey k AND ALSO has PartType t WHERE like(t, '%a%') AND contains(t, 'E') AND NOT starts_with(t, 'zz')", "select p_partkey as k from part where p_type ilike '%a%' and contains(lower(p_type), 'e')"),
    "I17_dates": ("LIST k, year(d) AS y, month(d) AS m, day(d) AS x, days_between(d, '1995-01-01') AS n FROM Order has OrderKey k AND ALSO has OrderDate d", "select o_orderkey as k, cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast(day(o_orderdate) as integer) as x, cast(datediff('day', date '1995-01-01', cast(o_orderdate as date)) as integer) as n from orders"),
    "I20_casts": ("LIST k, castInteger(concat(s, ' pieces')) AS i, castNumber('x') AS z FROM Part has PartKey k AND ALSO has PartSize s", "select p_partkey as k, cast(p_size as bigint) as i, cast(null as double) as z from part"),
    "I21_json": ("LIST k, castInteger(jsonPath(p, '$.k')) AS v, jsonObject('a', k, 'b', t) AS o FROM Event has EventKey k AND ALSO has EventProps p AND ALSO has EventType t", "select event_id as k, cast(json_extract(props, '$.k') as bigint) as v, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' as o from events"),
    # -- definitions ----------------------------------------------------------------
    "J1_subtype": ("DEFINE Busy ::= LIST c FROM Customer c placed Order o AND ALSO THE COUNT OF o GROUPED BY c AS n WHERE n > 15\nLIST s, k FROM Busy b has Segment s AND ALSO THE COUNT OF b GROUPED BY s AS k", "select c_mktsegment as s, count(*) as k from customer where c_custkey in (select o_custkey from orders group by 1 having count(*) > 15) group by 1"),
    "J2_fact": ("DEFINE Spent ::= LIST c, t FROM Customer c placed Order has TotalPrice p AND ALSO THE SUM OF p GROUPED BY c AS t\nLIST n, round(t, 2) AS spent FROM Customer has CustomerName n AND ALSO has Spent SpentT t", "select c_name as n, round(sum(o_totalprice), 2) as spent from customer join orders on o_custkey = c_custkey group by c_custkey, c_name"),
    "J4_chain": ("DEFINE Spent ::= LIST c, t FROM Customer c placed Order has TotalPrice p AND ALSO THE SUM OF p GROUPED BY c AS t\nDEFINE Big ::= LIST c FROM Customer c has Spent SpentT t WHERE t > 2000000\nLIST n, k FROM Big b is from Nation has NationName n AND ALSO THE COUNT OF b GROUPED BY n AS k", "with s as (select o_custkey, sum(o_totalprice) as t from orders group by 1) select n_name as n, count(*) as k from s join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where t > 2000000 group by 1"),
    # -- well-known reports -----------------------------------------------------------
    "report_pricing": ("LIST f, s, round(q, 2) AS sum_qty, round(p, 2) AS sum_price, round(v, 2) AS sum_disc, round(m, 6) AS avg_disc, c FROM LineItem l has ReturnFlag f AND ALSO has LineStatus s AND ALSO has Quantity x AND ALSO has ExtendedPrice y AND ALSO has Discount d AND ALSO has ShipDate h AND ALSO THE SUM OF x GROUPED BY f, s AS q AND ALSO THE SUM OF y GROUPED BY f, s AS p AND ALSO THE SUM OF revenue(y, d) GROUPED BY f, s AS v AND ALSO THE AVERAGE d GROUPED BY f, s AS m AND ALSO THE COUNT OF l GROUPED BY f, s AS c WHERE days_between(h, '1998-09-02') <= 0", "select l_returnflag as f, l_linestatus as s, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as c from lineitem where cast(l_shipdate as date) <= date '1998-09-02' group by 1, 2"),
    "report_local_suppliers": ("LIST n, round(r, 2) AS revenue FROM LineItem is of Order is placed by Customer is from Nation n1 AND ALSO is supplied by Supplier is based in Nation n1 AND ALSO n1 has NationName n AND ALSO has ExtendedPrice p AND ALSO has Discount d AND ALSO THE SUM OF revenue(p, d) GROUPED BY n AS r", "select n_name as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = c_nationkey group by 1"),
}
PATHS["C25_confluence"] = (
    "is in Region AS region, is home of Customer [has Segment: 'BUILDING'] has Balance AS balances EACH Nation",
    "select n_nationkey as Nation, n_regionkey as region, coalesce((select list(c_acctbal order by c_acctbal) from customer where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING'), []) as balances from nation",
)
PATHS["E9_group"] = (
    "LIST s, y, c FROM Order o is placed by Customer has Segment s AND ALSO has OrderDate d AND ALSO year(d) AS y AND ALSO THE COUNT OF o GROUPED BY s, y AS c",
    "select c_mktsegment as s, cast(year(o_orderdate) as integer) as y, count(*) as c from orders join customer on o_custkey = c_custkey group by 1, 2",
)


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of turns each conversation's chain connects."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    step = F.col("conv_id") * 100_000 + F.col("turn")
    order = Window.partitionBy("conv_id").orderBy("turn")
    steps = turns.select("conv_id", step.alias("step"), F.lead(step).over(order).alias("next_step"))
    text = "LIST c, n FROM Step a has ConversationKey c AND ALSO a has Reach Step b AND ALSO THE COUNT OF b GROUPED BY c AS n"
    return run(spark, tpch.conversations(), frames(steps=steps), text)


def _mined(table: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: work(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def unique_rows(df: DataFrame) -> DataFrame:
    found = mine.unique_sets(df, mine.facts(df), 2)
    return df.sparkSession.createDataFrame([(", ".join(u),) for u in found], "columns string")


REFERENCES = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("events", "user_id", "customer", "c_custkey"), ("customer", "c_custkey", "events", "user_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("documents", "doc_id", "labels", "doc_id"))


def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: for each pair, how many of the child's values the parent lacks."""
    read = files(spark, sf_dir)
    out = None
    for child, column, parent, key in REFERENCES:
        one = mine.missing(read(child), (column,), read(parent), (key,)).agg(F.count(F.lit(1)).alias("orphans"))
        one = one.select(F.lit(f"{child}.{column}").alias("child"), F.lit(f"{parent}.{key}").alias("parent"), "orphans")
        out = one if out is None else out.union(one)
    return out


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, K7: keys and references that the rows alone give, as rows."""
    read = files(spark, sf_dir)
    catalog, _, _ = derive.mine_keys({n: read(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})
    # lineitem has no key of its own: any unique combination of its columns is one by chance
    rows = [(n, "key", ", ".join(t.key), "") for n, t in catalog.items() if n != "lineitem"]
    rows += [(n, "reference", ", ".join(f.columns), f.table) for n, t in catalog.items() for f in t.foreign]
    return spark.createDataFrame(rows, "table string, kind string, columns string, target string")


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape, leaves = mine.json_shape(spark.read.parquet(f"{sf_dir}/events.parquet"), "props")
    return spark.createDataFrame([(shape, p, k) for p, k in leaves.items()], "shape string, path string, kind string")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do an order's customer and its suppliers lead to the same nations?"""
    ask = lambda t: run(spark, tpch.model(), files(spark, sf_dir), t)
    customers = ask("LIST o, n FROM Order o is placed by Customer is from Nation n")
    suppliers = ask("LIST o, n FROM Order o has LineItem is supplied by Supplier is based in Nation n")
    return mine.routes_agree(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", customers, suppliers)


def _profile_sql(table: str, *columns: str) -> str:
    return " union all ".join(f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\" from {table}" for c in columns)


#: What mining finds at every size from sf0.01 on, as it can be read off the tables; smaller ones have too few rows for references.
RECOVERED = " union all ".join(
    [f"select '{t}' as \"table\", 'key' as kind, '{k}' as columns, '' as target" for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))]
    + [f"select '{c}', 'reference', '{a}', '{p}' where not exists (select 1 from {c} where {a} not in (select {k} from {p})) and (select count(*) from {c}) >= 50" for c, a, p, k in (("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))]
)

#: key: (function, SQL or none)
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "J6_closure": (closure, "with recursive t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as p from conversations), r(conv_id, a, b) as (select conv_id, p, p + 1 from t where p < (select count(*) from t x where x.conv_id = t.conv_id) union select r.conv_id, r.a, r.b + 1 from r where r.b < (select count(*) from t x where x.conv_id = r.conv_id)) select conv_id as c, count(*) as n from r group by 1"),
    "K1_recovered": (recovered, RECOVERED),
    "K5_profile": (_mined("orders", mine.profile), _profile_sql("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "K6_unique": (_mined("nation", unique_rows), "select 'n_nationkey' as columns from nation having count(distinct n_nationkey) = count(*) union all select 'n_name' from nation having count(distinct n_name) = count(*)"),
    "K8_orphans": (orphan_counts, " union all ".join(f"select '{c}.{a}' as child, '{p}.{k}' as parent, count(distinct {a}) as orphans from {c} where {a} is not null and {a} not in (select {k} from {p})" for c, a, p, k in REFERENCES)),
    "K13_domains": (_mined("customer", lambda df: mine.domains(df.select("c_mktsegment", "c_name"))), "select 'c_mktsegment' as \"column\", c_mktsegment as value, count(*) as n from customer group by 2"),
    "K15_null_patterns": (_mined("supplier", lambda df: mine.null_patterns(df, ["s_name", "s_acctbal"])), "select 's_name' as \"left\", 's_acctbal' as \"right\", count(*) as rows, cast(sum(case when s_name is not null and s_acctbal is not null then 1 else 0 end) as bigint) as both, cast(sum(case when s_name is null and s_acctbal is null then 1 else 0 end) as bigint) as neither, cast(sum(case when (s_name is null) <> (s_acctbal is null) then 1 else 0 end) as bigint) as one from supplier"),
    "K16_comparisons": (_mined("lineitem", lambda df: mine.comparisons(df, [("l_discount", "l_quantity"), ("l_quantity", "l_tax")])), " union all ".join(f"select '{a}' as low, '{b}' as high, count(*) as rows, cast(sum(case when {a} > {b} then 1 else 0 end) as bigint) as broken from lineitem" for a, b in (("l_discount", "l_quantity"), ("l_quantity", "l_tax")))),
    "K19_dependencies": (_mined("part", lambda df: mine.dependencies(df, [("p_partkey", "p_brand"), ("p_brand", "p_type"), ("p_size", "p_type")])), " union all ".join(f"select '{a}' as determinant, '{b}' as dependent, count(*) as groups, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as broken from (select {a}, count(distinct {b}) as n from part group by 1)" for a, b in (("p_partkey", "p_brand"), ("p_brand", "p_type"), ("p_size", "p_type")))),
    "K25_routes": (routes, "with a as (select o_orderkey as k, [c_nationkey] as x from orders join customer on o_custkey = c_custkey), b as (select l_orderkey as k, list_sort(list(distinct s_nationkey)) as y from lineitem join supplier on l_suppkey = s_suppkey group by 1) select cast(sum(case when x = y then 1 else 0 end) as bigint) as agree, cast(sum(case when x <> y then 1 else 0 end) as bigint) as differ, cast(sum(case when y is null then 1 else 0 end) as bigint) as only_first, cast(0 as bigint) as only_second from a left join b using (k)"),
    "K26_structure": (lambda spark, d: mine.structure(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", spark.read.parquet(f"{d}/customer.parquet"), "c_custkey"), "select count(*) as parents, count(n) as covered, cast(coalesce(sum(n), 0) as bigint) as rows, coalesce(max(n), 0) as most from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey"),
    "K29_json_shape": (json_leaves, "select 'record' as shape, '$.k' as path, 'bigint' as kind"),
}


def _path(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, tpch.model(), files(spark, sf_dir), text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(FLAGSHIP)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _path(text) for k, (text, _) in PATHS.items()} | {k: f for k, (f, _) in FRAMES.items()} | catalogue_more.queries()


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in PATHS.items() if sql} | {k: sql for k, (_, sql) in FRAMES.items() if sql} | catalogue_more.oracle_sql()
