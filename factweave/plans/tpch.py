"""The model of the driver's tables."""

from __future__ import annotations

from ..model import Model, Rule


def model() -> Model:
    m = Model("orders")
    m.entity("Region", "region", "r_regionkey").entity("Nation", "nation", "n_nationkey")
    m.entity("Customer", "customer", "c_custkey").entity("Supplier", "supplier", "s_suppkey").entity("Part", "part", "p_partkey")
    m.entity("Order", "orders", "o_orderkey").entity("LineItem", "lineitem", keyless=True)
    m.entity("Event", "events", "event_id").entity("Document", "documents", "doc_id")
    m.entity("LabelledDocument", "labels", "doc_id", supertype="Document")
    m.entity("Turn", "conversations", "conv_id", "turn").entity("Page", "pages", "page_id").entity("BenchmarkItem", "benchmark", "item_id")

    m.attribute("Region", "RegionKey", "r_regionkey", "int", mandatory=True).attribute("Region", "RegionName", "r_name", unique=True)
    m.attribute("Nation", "NationKey", "n_nationkey", "int", mandatory=True).attribute("Nation", "NationName", "n_name", unique=True)
    for owner, prefix, columns in (
        ("Customer", "c_", (("CustomerKey", "custkey", "long"), ("CustomerName", "name", "string"), ("Balance", "acctbal", "double"), ("Segment", "mktsegment", "string"))),
        ("Supplier", "s_", (("SupplierKey", "suppkey", "long"), ("SupplierName", "name", "string"), ("SupplierBalance", "acctbal", "double"))),
        ("Part", "p_", (("PartKey", "partkey", "long"), ("PartName", "name", "string"), ("Brand", "brand", "string"), ("PartType", "type", "string"), ("PartSize", "size", "int"), ("RetailPrice", "retailprice", "double"))),
        ("Order", "o_", (("OrderKey", "orderkey", "long"), ("OrderStatus", "orderstatus", "string"), ("TotalPrice", "totalprice", "double"), ("OrderDate", "orderdate", "timestamp"), ("Priority", "orderpriority", "string"))),
        ("LineItem", "l_", (("LineNumber", "linenumber", "int"), ("Quantity", "quantity", "double"), ("ExtendedPrice", "extendedprice", "double"), ("Discount", "discount", "double"), ("Tax", "tax", "double"), ("ReturnFlag", "returnflag", "string"), ("LineStatus", "linestatus", "string"), ("ShipDate", "shipdate", "timestamp"))),
        ("Event", "", (("EventKey", "event_id", "long"), ("EventTime", "ts", "timestamp"), ("EventType", "event_type", "string"), ("EventValue", "value", "double"), ("EventProps", "props", "string"))),
        ("Document", "", (("DocumentKey", "doc_id", "long"), ("Language", "lang", "string"), ("SourceName", "source", "string"), ("CharCount", "n_chars", "long"))),
        ("LabelledDocument", "", (("Quality", "quality", "int"), ("Toxic", "toxic", "int"))),
        ("Turn", "", (("ConversationKey", "conv_id", "long"), ("TurnNumber", "turn", "long"), ("SpeakerRole", "role", "string"))),
        ("Page", "", (("Url", "url", "string"),)),
    ):
        for value, column, kind in columns:
            m.attribute(owner, value, prefix + column, kind)
    m.attribute("Event", "EventK", "props", "long", path="$.k")
    m.attribute("Customer", "BigSegment", "c_mktsegment", "string", verb="has big", allowed=("BUILDING", "AUTOMOBILE"))
    m.attribute("Part", "MediumSize", "p_size", "int", verb="has medium", low=10, high=20)

    m.reference("Nation", "Region", ("n_regionkey",), "is in", "contains", mandatory=True)
    m.reference("Customer", "Nation", ("c_nationkey",), "is from", "is home of", mandatory=True)
    m.reference("Supplier", "Nation", ("s_nationkey",), "is based in", "is base of", mandatory=True)
    m.reference("Order", "Customer", ("o_custkey",), "is placed by", "placed", mandatory=True)
    m.reference("LineItem", "Order", ("l_orderkey",), "is of", "has", mandatory=True)
    m.reference("LineItem", "Part", ("l_partkey",), "is for", "is ordered in", mandatory=True)
    m.reference("LineItem", "Supplier", ("l_suppkey",), "is supplied by", "supplies", mandatory=True)
    m.reference("Event", "Customer", ("user_id",), "is by", "caused", mandatory=True)

    m.macros["revenue"] = (("price", "discount"), "(price * (1 - discount))")
    m.macros["late"] = (("day",), "year(day) >= 2000")
    return m


def conversations() -> Model:
    """Turns as a chain: the next turn of a conversation follows the one before."""
    m = Model("turns")
    m.entity("Step", "steps", "step")
    m.attribute("Step", "ConversationKey", "conv_id", "long")
    m.association("StepPrecedesStep", "steps", ("Step", ("step",)), ("Step", ("next_step",)), "precedes", "follows", (frozenset((0,)), frozenset((1,))))
    m.rules.append(Rule("Reach", "(LIST a, b FROM Step a precedes Step b) UNITED WITH (LIST a, c FROM Step a has Reach Step b AND ALSO b precedes Step c)"))
    return m
