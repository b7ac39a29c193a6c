"""Passes over the rows, once keys and references are known; each gives findings with the query that would refute them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mine
from .catalog import Catalog, ForeignKey, Table
from .derive import Finding, classify

#: Types of numbers that may have a unit.
MEASURES = ("double", "float", "decimal")


@dataclass
class Data:
    """The tables, and what is known of them."""

    tables: dict[str, DataFrame]
    catalog: Catalog
    known: dict[str, dict[str, mine.ColumnFacts]]
    documents: dict[tuple[str, str], dict[str, str]]

    def rows(self, table: str) -> int:
        return next((k.rows for k in self.known[table].values()), 0)

    def references(self) -> list[tuple[Table, ForeignKey]]:
        return [(t, f) for t in self.catalog.values() for f in t.foreign if f.table in self.tables]

    def measures(self, table: str) -> tuple[str, ...]:
        """Columns that are no key and no reference."""
        t = self.catalog[table]
        keys = {*t.key, *(c for f in t.foreign for c in f.columns)}
        return tuple(c.name for c in t.columns if c.name not in keys)


def prefer_referenced_keys(catalog: Catalog, tables: dict[str, DataFrame]) -> None:
    """A table is identified by what others refer to, if no reference uses its declared key."""
    for n, t in catalog.items():
        used = [f.references for other in catalog.values() for f in other.foreign if f.table == n]
        if t.key and used:
            t.key = mine.referenced_key(tables[n], mine.facts(tables[n]), t.key, used)


def shared_pairs(d: Data) -> list[Finding]:
    """Pairs of columns, of the same names, by which one table's rows are found in another."""
    out = []
    for a, b in combinations(sorted(d.tables), 2):
        same = [c for c in d.tables[a].columns if c in d.tables[b].columns and c in d.known[a] and c in d.known[b]]
        linked = {c for t, f in d.references() if {t.name, f.table} == {a, b} for c in f.columns}
        alone = {c for n in (a, b) for c in same if d.known[n][c].distinct == d.rows(n)}
        for pair in combinations([c for c in same if c not in linked | alone], 2):
            for child, parent in ((a, b), (b, a)):
                found = mine.shared_pairs(d.tables[child], d.tables[parent], pair)
                if found["unique_left"] and found["unique_right"] and found["contained"] and d.rows(child):
                    names = ", ".join(pair)
                    out.append(Finding("shared pair", f"{child}({names})", f"finds a row of {parent}", f"select {names} from {child} except select {names} from {parent}", applied=False))
                    break
    return out


def storage_types(d: Data) -> list[Finding]:
    """Text columns whose values are all of one other type."""
    out = []
    for n, df in d.tables.items():
        for c, kind in mine.storage_types(df).items():
            if kind != "string":
                out.append(Finding("storage type", f"{n}.{c}", f"every value is a {kind}", f"select * from {n} where {c} is not null and try_cast({c} as {kind}) is null", applied=False))
    return out


def null_patterns(d: Data) -> list[Finding]:
    """Nullable columns that are filled together, or never together."""
    out = []
    for n, df in d.tables.items():
        columns = [c for c, k in d.known[n].items() if 0 < k.nulls < k.rows]
        if len(columns) < 2:
            continue
        for r in mine.null_patterns(df, columns).collect():
            a, b = r["left"], r["right"]
            if not r["one"]:
                out.append(Finding("filled together", f"{n}.{a}, {b}", "both or neither", f"select * from {n} where ({a} is null) <> ({b} is null)"))
            elif not r["both"]:
                out.append(Finding("never together", f"{n}.{a}, {b}", "one at most" if r["neither"] else "exactly one", f"select * from {n} where {a} is not null and {b} is not null"))
    return out


def comparisons(d: Data) -> list[Finding]:
    """Pairs of which the first never exceeds the second."""
    return [
        Finding("order of values", f"{n}.{r['low']} <= {r['high']}", "in every row", f"select * from {n} where {r['low']} > {r['high']}")
        for n, df in d.tables.items()
        for r in mine.comparisons(df).collect()
        if r["rows"] and not r["broken"]
    ]


def computed(d: Data) -> list[Finding]:
    """Columns that others compute."""
    out = []
    for n, df in d.tables.items():
        keys = tuple(c for c in df.columns if c not in d.measures(n))
        out += [Finding("computed", n, said, applied=False) for said in mine.computed(df, skip=keys)]
    return out


def stored_aggregates(d: Data) -> list[Finding]:
    """parents' columns that hold counts or sums of their children."""
    out = []
    for t, f in d.references():
        if len(f.columns) == 1:
            out += [Finding("stored aggregate", f.table, f"{said} in {t.name}", applied=False) for said in mine.stored_aggregates(d.tables[f.table], f.references[0], d.tables[t.name], f.columns[0])]
    return out


def dependencies(d: Data) -> list[Finding]:
    """Columns that fix others without being a key. One that has fewer values than another can't fix it."""
    out = []
    for n, df in d.tables.items():
        known = {c: k for c, k in d.known[n].items() if 1 < k.distinct < k.rows}
        pairs = [(a, b) for a in known for b in known if a != b and known[a].distinct >= known[b].distinct and 2 * known[a].distinct <= known[a].rows]
        if pairs:
            out += [
                Finding("dependency", f"{n}.{r['determinant']}", f"fixes {r['dependent']}", f"select {r['determinant']} from {n} group by all having count(distinct {r['dependent']}) > 1", applied=False)
                for r in mine.dependencies(df, pairs).where("broken = 0").orderBy("determinant", "dependent").collect()
            ]
    return out


def rings(d: Data) -> list[Finding]:
    """What holds of a reference from a table to itself."""
    out = []
    for t, f in d.references():
        if f.table == t.name and len(f.columns) == 1:
            laws = mine.ring(d.tables[t.name], f.references[0], f.columns[0])
            out += [Finding("ring", f"{t.name}.{f.columns[0]}", law) for law, holds in laws.items() if holds]
    return out


def coded(d: Data) -> list[Finding]:
    """Unique texts that look like codes, beside the key."""
    return [Finding("code", f"{n}.{c}", "is an alternate key of one width", f"select {c} from {n} group by all having count(*) > 1") for n, df in d.tables.items() for c in mine.coded(df, d.known[n]) if (c,) != d.catalog[n].key]


def quality(d: Data) -> list[Finding]:
    """Values that look wrong, in columns and in the leaves of documents."""
    out = []
    for n, df in d.tables.items():
        own = [c.name for c in d.catalog[n].columns if (n, c.name) not in d.documents and c.name in d.known[n] and d.known[n][c.name].distinct < d.rows(n)]
        found = [(n, r) for r in mine.quality(df.select(*[f"`{c}`" for c in own])).orderBy("column", "finding").collect()] if own else []
        for (t, c), leaves in d.documents.items():
            if t == n:
                found += [(f"{n}.{c}", r) for r in mine.document_quality(df, c, {p: k for p, k in leaves.items() if k == 'string'}).orderBy("column", "finding").collect()]
        out += [Finding("quality", f"{where}.{r['column']}", f"{r['finding']}: {r['values']} values in {r['rows']} rows", applied=False, severity="caution") for where, r in found]
    return out


def routes(d: Data) -> list[Finding]:
    """Two chains of two references from one table to another: do they lead to the same rows?"""
    out = []
    steps: dict[str, list[tuple[str, str, str, str]]] = {}
    for t, f in d.references():
        if len(f.columns) == 1 and f.table != t.name:
            steps.setdefault(t.name, []).append((f.columns[0], f.table, f.references[0], t.name))
    for n, own in steps.items():
        key = d.catalog[n].key
        if len(key) != 1:
            continue
        chains = [(a, b) for a in own for b in steps.get(a[1], ())]
        for (a, b), (c, e) in combinations(chains, 2):
            if b[1] != e[1] or (a, b) == (c, e):
                continue
            def walk(first, second):
                left, right = d.tables[n], d.tables[first[1]]
                left = left.select(F.col(f"`{key[0]}`").alias("k"), F.col(f"`{first[0]}`").alias("m"))
                return left.join(right.select(F.col(f"`{first[2]}`").alias("m"), F.col(f"`{second[0]}`").alias("e")), "m").select("k", "e")

            r = mine.routes_agree(d.tables[n], key[0], walk(a, b), walk(c, e)).first()
            if r["agree"] and not r["differ"]:
                out.append(Finding("routes agree", n, f"{a[0]} and {c[0]} lead to the same {b[1]}", applied=False))
    return out


def structure(d: Data) -> list[Finding]:
    """References that reach every parent, that reach each at most once, and groups of columns that are null in the same rows."""
    out = []
    for t, f in d.references():
        if len(f.columns) != 1 or f.columns == t.key:
            continue
        r = mine.structure(d.tables[t.name], f.columns[0], d.tables[f.table], f.references[0]).first()
        where = f"{t.name}.{f.columns[0]}"
        if r["parents"] and r["parents"] == r["covered"]:
            out.append(Finding("covers", where, f"every row of {f.table} has rows here", f"select {f.references[0]} from {f.table} except select {f.columns[0]} from {t.name}", applied=False))
        if r["most"] == 1:
            out.append(Finding("one to one", where, f"each row of {f.table} has one row here at most", f"select {f.columns[0]} from {t.name} where {f.columns[0]} is not null group by all having count(*) > 1", applied=False))
    for n, df in d.tables.items():
        out += [Finding("joint nulls", n, f"{', '.join(group)} are null in the same {rows} rows", applied=False) for group, rows in mine.joint_nulls(df, d.known[n])]
        out += [Finding("one row per group", n, f"{c} marks one row for each {g}", applied=False) for c, g in mine.marked_rows(df, d.known[n])]
    return out


def subtypes(d: Data) -> list[Finding]:
    """A table with another's key is the rest of its rows, or a subtype."""
    out = []
    for t, f in d.references():
        if classify(t) == "subtype" and set(f.columns) == set(t.key):
            out.append(Finding("one identity", t.name, f"{mine.partition_or_subtype(d.tables[t.name], d.tables[f.table])} of {f.table}", applied=False))
    return out


def units_in_columns(d: Data) -> list[Finding]:
    """A column that names units, beside numbers that are in several."""
    out = []
    for n, df in d.tables.items():
        for c in d.catalog[n].columns:
            if c.type == "string" and re.search(r"(^|_)(unit|uom|currency)s?$", c.name, re.I) and 1 < d.known[n][c.name].distinct <= 20:
                numbers = [x.name for x in d.catalog[n].columns if x.name in d.measures(n) and x.type.startswith(MEASURES)]
                if numbers:
                    out.append(Finding("several units", f"{n}.{c.name}", f"{', '.join(numbers)} must not be summed across it", applied=False, severity="caution"))
    return out


PASSES: tuple[Callable[[Data], list[Finding]], ...] = (shared_pairs, storage_types, null_patterns, comparisons, computed, stored_aggregates, dependencies, rings, coded, quality, routes, structure, subtypes, units_in_columns)
