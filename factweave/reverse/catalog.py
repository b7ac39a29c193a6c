"""What is declared: tables, columns, keys, checks.

Parquet declares types only; keys come from a JSON file, from a database's
information schema, or from mining.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True


@dataclass
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    enforced: bool = False


@dataclass
class Table:
    name: str
    columns: list[Column]
    key: tuple[str, ...] = ()
    uniques: list[tuple[str, ...]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    view: bool = False

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


Catalog = dict[str, Table]


def from_frames(tables: dict[str, DataFrame]) -> Catalog:
    return {n: Table(n, [Column(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]) for n, df in tables.items()}


def from_spark(spark: SparkSession, database: str | None = None) -> Catalog:
    out: Catalog = {}
    for t in spark.catalog.listTables(database):
        name = f"{database}.{t.name}" if database else t.name
        out[t.name] = Table(t.name, [Column(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(name)], view=t.tableType in ("VIEW", "TEMPORARY"))
    return out


def from_json(text: str) -> Catalog:
    """``{table: {columns: {name: type}, key: [...], unique: [[...]], foreign: [{columns, table, references}], checks: [...]}}``"""
    out: Catalog = {}
    for name, d in json.loads(text).items():
        required = set(d.get("required", []))
        out[name] = Table(
            name,
            [Column(c, k, c not in required) for c, k in d.get("columns", {}).items()],
            tuple(d.get("key", ())),
            [tuple(u) for u in d.get("unique", [])],
            [ForeignKey(tuple(f["columns"]), f["table"], tuple(f["references"])) for f in d.get("foreign", [])],
            list(d.get("checks", [])),
            bool(d.get("view")),
        )
    return repair_crossed(out)


def from_jdbc(spark: SparkSession, url: str, schema: str = "public", **options) -> Catalog:
    """Columns and keys by a database's information schema."""
    from ..sources.tables import jdbc_options

    read = lambda q: spark.read.format("jdbc").options(query=q, **jdbc_options(url, **options)).load().collect()
    out: Catalog = {}
    for r in read(f"select table_name, column_name, data_type, is_nullable from information_schema.columns where table_schema = '{schema}' order by table_name, ordinal_position"):
        out.setdefault(r[0], Table(r[0], [])).columns.append(Column(r[1], r[2], r[3] == "YES"))
    for r in read(f"select k.table_name, c.constraint_type, k.constraint_name, k.column_name from information_schema.key_column_usage k join information_schema.table_constraints c on c.constraint_name = k.constraint_name and c.table_schema = k.table_schema where k.table_schema = '{schema}' and c.constraint_type = 'PRIMARY KEY' order by k.table_name, k.ordinal_position"):
        if r[0] in out:
            out[r[0]].key += (r[3],)
    return out


def repair_crossed(catalog: Catalog) -> Catalog:
    """Composite references whose columns are paired in another order than their names say are paired by name."""
    for t in catalog.values():
        for f in t.foreign:
            if len(f.columns) > 1 and set(f.columns) == set(f.references) and f.columns != f.references:
                f.references = f.columns
    return catalog


def verify(catalog: Catalog, source: Callable[[str], DataFrame]) -> list[str]:
    """Mark declared references that the rows keep, drop those that no row keeps, and say so.

    A composite reference that fails as declared is tried with its columns paired in every other order.
    """
    from .mine import missing

    said = []
    for t in catalog.values():
        for f in list(t.foreign):
            child, parent = source(t.name), source(f.table)
            for references in [f.references, *([p for p in permutations(f.references) if p != f.references] if len(f.references) > 1 else [])]:
                bad = missing(child, f.columns, parent, references).count()
                if not bad:
                    break
            if not bad:
                if references != f.references:
                    said.append(f"{t.name}({', '.join(f.columns)}): paired with {', '.join(references)}")
                f.references, f.enforced = references, True
                continue
            bad = missing(child, f.columns, parent, f.references).count()
            total = child.select(*[F.col(f"`{c}`") for c in f.columns]).dropna().distinct().count()
            if bad == total:
                t.foreign.remove(f)
                said.append(f"{t.name}({', '.join(f.columns)}) refers to no row of {f.table}: dropped")
            else:
                said.append(f"{t.name}({', '.join(f.columns)}): {bad} of {total} values are not in {f.table}")
    return said
