"""Tables by name, from files of any format that Spark reads, or from JDBC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..model import Model


def files(spark: SparkSession, folder: str, kind: str = "parquet", schemas: dict | None = None, **options) -> Callable[[str], DataFrame]:
    """``folder/<table>.<kind>``, read when a query first names the table."""
    found: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in found:
            reader = spark.read.format(kind).options(**options)
            if schemas and name in schemas:
                reader = reader.schema(schemas[name])
            found[name] = reader.load(f"{folder}/{name}.{kind}")
        return found[name]

    return table


def read_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, a table as often as it is read; what states no size counts nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 60)


def frames(**tables: DataFrame) -> Callable[[str], DataFrame]:
    return lambda name: tables[name]


def catalogue(spark: SparkSession, database: str | None = None) -> Callable[[str], DataFrame]:
    """Tables and views of Spark's own catalogue."""
    return lambda name: spark.table(f"{database}.{name}" if database else name)


#: What makes a database's session refuse to write, by the start of its address.
READ_ONLY = {
    "jdbc:postgresql:": {"sessionInitStatement": "set session characteristics as transaction read only"},
    "jdbc:mysql:": {"sessionInitStatement": "set session transaction read only"},
    "jdbc:sqlite:": {"open_mode": "1"},
}


def jdbc_options(url: str, timeout: int = 120, **options) -> dict[str, str]:
    """Options of a session that only reads, and whose statements end after ``timeout`` seconds."""
    guards = next((o for start, o in READ_ONLY.items() if url.startswith(start)), {})
    return {"url": url, "queryTimeout": str(timeout), **guards, **{k: str(v) for k, v in options.items()}}


def jdbc(spark: SparkSession, url: str, partitions: dict[str, dict] | None = None, timeout: int = 120, **options) -> Callable[[str], DataFrame]:
    """Tables of a database; ``partitions`` gives column, bounds and number of parallel reads by table."""
    return lambda name: spark.read.format("jdbc").options(dbtable=name, **jdbc_options(url, timeout, **options), **(partitions or {}).get(name, {})).load()


def unbound(model: Model, source: Callable[[str], DataFrame]) -> list[str]:
    """What a model names that the tables lack: tables, and columns of keys and roles."""
    named: dict[str, set[str]] = {}
    for e in model.entities.values():
        named.setdefault(e.table, set()).update(e.key)
    for f in model.facts:
        named.setdefault(f.table, set()).update(c for r in f.roles for c in r.columns)
    out = []
    for table, columns in sorted(named.items()):
        try:
            there = set(source(table).columns)
        except (KeyError, AnalysisException):
            out.append(f"there is no table {table}")
            continue
        out += [f"{table} has no column {c}" for c in sorted(columns - there)]
    return out
