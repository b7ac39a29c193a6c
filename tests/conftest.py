"""Ferries, their ports, sailings and cargo: one small world for the tests of the language."""

import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from factweave.model import Model
from factweave.plans.compiler import run
from factweave.sources.tables import frames

ROWS = {
    "port": ("port_id int, port_name string, depth double", [(1, "Arnis", 4.5), (2, "Kappeln", 6.0), (3, "Maasholm", 3.0), (4, "Hallig", 2.5)]),
    "ferry": (
        "hull int, ferry_name string, seats int, fuel string, built string, home int, relief int",
        [(11, "Albatros", 200, "diesel", "1998-04-02", 1, None), (12, "Brise", 80, "electric", "2019-06-30", 1, 11), (13, "Condor", 350, "diesel", "1987/09/12", 2, 11), (14, "Dorsch", 40, "steam", "2/5/1931", 3, 12), (15, "Elster", 120, "electric", "2022-02-28", None, 13)],
    ),
    "icebreaker": ("hull int, thickness int", [(13, 60), (14, 25)]),
    "sailing": (
        "sailing_nr int, hull int, start_port int, goal_port int, day string, fare double, riders int",
        [(1, 11, 1, 2, "2024-05-01", 12.5, 150), (2, 11, 2, 1, "2024-05-01", 12.5, 90), (3, 12, 1, 3, "2024-05-02", 8.0, 75), (4, 13, 2, 4, "2024-05-02", 30.0, None), (5, 13, 4, 2, "2024-05-03", 30.0, 300), (6, 14, 3, 1, "2024-05-04", 20.0, 38), (7, 12, 3, 1, "2024-05-04", 8.0, 10)],
    ),
    "goods": ("goods_code string, goods_name string, hazard int", [("FI", "Fish", 1), ("OI", "Oil", 3), ("SA", "Salt", 1), ("WO", "Wool", 2)]),
    "cargo": ("sailing_nr int, goods_code string, tonnes int", [(1, "FI", 5), (1, "SA", 2), (3, "FI", 1), (4, "OI", 40), (5, "SA", 10), (5, "FI", 3), (6, "WO", 7)]),
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def ferry_model() -> Model:
    m = Model("ferries")
    m.entity("Port", "port", "port_id").entity("Ferry", "ferry", "hull").entity("Icebreaker", "icebreaker", "hull", supertype="Ferry")
    m.entity("Sailing", "sailing", "sailing_nr").entity("Goods", "goods", "goods_code").entity("Cargo", "cargo", "sailing_nr", "goods_code")
    m.attribute("Port", "PortName", "port_name", unique=True, mandatory=True).attribute("Port", "Depth", "depth", "double", mandatory=True)
    for value, column, kind in (("HullNr", "hull", "int"), ("FerryName", "ferry_name", "string"), ("Seats", "seats", "int"), ("Fuel", "fuel", "string"), ("Built", "built", "string")):
        m.attribute("Ferry", value, column, kind)
    m.attribute("Icebreaker", "Thickness", "thickness", "int")
    for value, column, kind in (("SailingNr", "sailing_nr", "int"), ("Day", "day", "string"), ("Fare", "fare", "double"), ("Riders", "riders", "int")):
        m.attribute("Sailing", value, column, kind)
    m.attribute("Goods", "GoodsCode", "goods_code").attribute("Goods", "GoodsName", "goods_name").attribute("Goods", "Hazard", "hazard", "int", low=1, high=3)
    m.attribute("Cargo", "Tonnes", "tonnes", "int")
    m.reference("Ferry", "Port", ("home",), "lies in", "shelters")
    m.reference("Ferry", "Ferry", ("relief",), "has relief", "is relief of", role="Reliever")
    m.reference("Sailing", "Ferry", ("hull",), "is run by", "runs", mandatory=True)
    m.reference("Sailing", "Port", ("start_port",), "starts in", "is start of", mandatory=True)
    m.reference("Sailing", "Port", ("goal_port",), "goes to", "is goal of", mandatory=True)
    m.reference("Cargo", "Sailing", ("sailing_nr",), "is on", "carries", mandatory=True)
    m.reference("Cargo", "Goods", ("goods_code",), "is of", "travels as", mandatory=True)
    m.macros["dear"] = (("x",), "x >= 20")
    return m


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name, (schema, rows) in ROWS.items():
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).convert_dtypes()
        con.register(f"{name}_rows", frame)
        con.execute(f"create table {name} as select * from {name}_rows")
    return con


@pytest.fixture(scope="session")
def ferries(spark):
    tables = {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in ROWS.items()}
    source = frames(**tables)
    model = ferry_model()

    def ask(text, **more):
        return [tuple(r) for r in run(spark, more.pop("model", model), source, text, **more).collect()]

    ask.model, ask.source, ask.tables = model, source, tables
    return ask
