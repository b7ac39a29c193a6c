"""From a catalogue, declared or mined, to a draft model with a report.

A table with a key of its own is an entity type; one whose key is another
table's key is a subtype; one whose key is made of references is an association;
a view is reported only; a table without any key is blocked unless rows may
stand for themselves. Columns become value facts, references become facts
between entity types. Names, units and additivity are guesses that the review
file lets a person accept or reject.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..model import Constraint, Model, Role
from . import mine
from .catalog import Catalog, ForeignKey, Table, from_frames, verify

# Fixed vocabularies: usual short forms, unit suffixes, and words that say whether sums make sense.
ABBREVIATIONS = {"nr": "Number", "no": "Number", "num": "Number", "qty": "Quantity", "amt": "Amount", "dt": "Date", "desc": "Description", "addr": "Address", "cust": "Customer", "acct": "Account", "bal": "Balance", "pct": "Percent", "cd": "Code", "nm": "Name"}
UNITS = {"celsius": "°C", "tempc": "°C", "degc": "°C", "fahrenheit": "°F", "tempf": "°F", "km": "km", "kg": "kg", "usd": "USD", "eur": "EUR", "pct": "%", "percent": "%", "ms": "ms", "sec": "s", "seconds": "s", "minutes": "min", "hours": "h", "cm": "cm", "mm": "mm"}
ADDITIVE = ("quantity", "amount", "cost", "revenue", "sales", "count", "total", "hours", "units", "price")
NOT_ADDITIVE = ("rate", "ratio", "percent", "discount", "average", "score", "temperature", "age", "year", "index")
SEMI_ADDITIVE = ("balance", "stock", "inventory", "headcount", "level")
SIGNIFICANT = (50, 3)


@dataclass
class Finding:
    """A claim about the data, with the query that would refute it."""

    kind: str
    subject: str
    said: str
    probe: str = ""
    applied: bool = True
    severity: str = "note"


@dataclass
class Draft:
    model: Model
    catalog: Catalog
    findings: list[Finding] = field(default_factory=list)

    def blockers(self) -> list[Finding]:
        return [f for f in self.findings if f.severity == "blocker"]


#: Words of one's own, by their short forms; ``glossary`` sets them.
GLOSSARY: dict[str, str] = {}


def glossary(terms: dict[str, str]) -> None:
    """K4: what short forms stand for in one's own tables, before the usual ones. An empty text leaves a word out."""
    GLOSSARY.clear()
    GLOSSARY.update({k.lower(): v for k, v in terms.items()})


def words(name: str) -> list[str]:
    parts = [p for p in re.split(r"[_\W]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)) if p]
    known = ABBREVIATIONS | GLOSSARY
    return [w for p in parts if (w := known.get(p.lower(), p[:1].upper() + p[1:].lower()))]


def singular(word: str) -> str:
    if word.lower().endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if re.search(r"(ss|us|is)$", word.lower()) or not word.lower().endswith("s"):
        return word
    return word[:-2] if re.search(r"(xes|ches|shes|sses)$", word.lower()) else word[:-1]


def type_name(table: str) -> str:
    parts = words(table)
    return "".join(parts[:-1] + [singular(parts[-1])]) if parts else table


def value_name(owner: str, column: str, prefix: str = "") -> str:
    parts = words(column[len(prefix) :] if prefix and column.startswith(prefix) else column) or [column]
    return owner + "".join(parts)


def common_prefix(table: Table) -> str:
    """``o_`` where every column starts so."""
    found = {m[1] for c in table.names() if (m := re.match(r"([a-z]{1,3}_)\w", c))}
    return next(iter(found)) if len(found) == 1 and all(c.startswith(tuple(found)) for c in table.names()) else ""


def unit_of(column: str) -> str | None:
    return next((u for w in re.split(r"[_\W]+", column.lower()) for k, u in UNITS.items() if w == k or w.endswith(k) and len(k) > 3), None)


def additivity(column: str, dated: bool) -> str:
    """A guess from the name, and from whether a date stands beside it."""
    w = " ".join(words(column)).lower()
    if any(x in w for x in NOT_ADDITIVE):
        return "nonAdditive"
    if any(x in w for x in SEMI_ADDITIVE):
        return "semiAdditive" if dated else "nonAdditive"
    return "additive" if any(x in w for x in ADDITIVE) else "unknown"


def parse_check(spark: SparkSession, check: str) -> tuple[str, tuple, float | None, float | None] | None:
    """K3: (column, values, low, high) of a check on one column: a list of values, or a range; others give none.

    Spark's parser reads the expression, so quoting, parentheses and escapes are
    those of SQL; double-quoted and bracketed names become its own quoting.
    """
    text = re.sub(r'"(\w+)"|\[(\w+)\]', lambda m: f"`{m[1] or m[2]}`", check)
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as why:
        if "PARSE" in str(why):
            return None
        raise
    parts = [tree.children().apply(i) for i in range(tree.children().size())]
    kind = tree.getClass().getSimpleName()
    kinds = [p.getClass().getSimpleName() for p in parts]
    if kinds[:1] != ["UnresolvedAttribute"] or set(kinds[1:]) != {"Literal"}:
        return None
    column = parts[0].name().strip("`")

    def value(x):
        raw, stated = x.toString(), x.dataType().typeName()
        return raw if stated == "string" else float(raw) if "." in raw else int(raw)

    values = [value(x) for x in parts[1:]]
    if kind == "In":
        return column, tuple(values), None, None
    if kind == "UnresolvedFunction" and tree.toString().startswith("'between(") and len(values) == 2:
        return column, (), float(values[0]), float(values[1])
    return None


def classify(table: Table) -> str:
    """K1: entity, subtype, association, unkeyed or view."""
    if table.view:
        return "view"
    if not table.key:
        return "unkeyed"
    if any(set(f.columns) == set(table.key) for f in table.foreign):
        return "subtype"
    covered = {c for f in table.foreign if set(f.columns) <= set(table.key) for c in f.columns}
    if len(table.key) > 1 and covered == set(table.key) and sum(set(f.columns) <= set(table.key) for f in table.foreign) >= 2:
        return "association"
    return "entity"


def mine_keys(tables: dict[str, DataFrame], catalog: Catalog | None = None) -> tuple[Catalog, dict[str, dict[str, mine.ColumnFacts]], list[Finding]]:
    """Keys first, then references, for what the catalogue does not declare."""
    catalog = catalog or from_frames(tables)
    known = {n: mine.facts(df) for n, df in tables.items()}
    sets = {n: mine.unique_sets(df, known[n]) for n, df in tables.items()}
    singles = {n: [u[0] for u in s if len(u) == 1] for n, s in sets.items()}
    findings = []
    for n, t in catalog.items():
        for c in t.columns:
            c.nullable = not known[n].get(c.name, mine.ColumnFacts(0, 0, 0)).never_null
        if not t.key and not t.view:
            t.key = mine.choose_key(n, tables[n], sets[n], singles)
            if not t.key and len(singles[n]) == 1:
                t.key = (singles[n][0],)
            if t.key:
                t.uniques += [u for u in sets[n] if u != t.key]
                findings.append(Finding("key", n, f"{n} is identified by {', '.join(t.key)}", f"select {', '.join(t.key)} from {n} group by all having count(*) > 1"))
    keys = {n: t.key for n, t in catalog.items() if t.key}
    for i in mine.inclusions(tables, known, keys, *SIGNIFICANT):
        t = catalog[i.child]
        if any(i.column in f.columns for f in t.foreign):
            continue
        t.foreign.append(ForeignKey((i.column,), i.parent, (i.key,), True))
        findings.append(Finding("reference", f"{i.child}.{i.column}", f"refers to {i.parent}.{i.key} (names {i.score:.1f}, spread {'unknown' if i.spread is None else format(i.spread, '.2f')})", f"select {i.column} from {i.child} where {i.column} is not null and {i.column} not in (select {i.key} from {i.parent})"))
    return catalog, known, findings


def derive(name: str, catalog: Catalog, known: dict[str, dict[str, mine.ColumnFacts]] | None = None, domains: dict[tuple[str, str], list[str]] | None = None, keyless: bool = False, documents: dict[tuple[str, str], dict[str, str]] | None = None) -> Draft:
    """K2: the draft model of a catalogue.

    domains: values by (table, column), as mining found them; documents: leaves
    and their types by (table, column). keyless: let rows of a table without a
    key stand for themselves.
    """
    m = Model(name)
    draft = Draft(m, catalog)
    say = lambda *a, **k: draft.findings.append(Finding(*a, **k))
    kinds = {n: classify(t) for n, t in catalog.items()}
    types: dict[str, str] = {}
    for n, t in catalog.items():
        if kinds[n] == "view":
            say("view", n, "a view is reported, not modelled")
        elif kinds[n] == "unkeyed" and not keyless:
            say("unkeyed", n, f"{n} has no key: name one, or let its rows stand for themselves", severity="blocker")
        else:
            types[n] = type_name(n)
    parents = {n: next(f.table for f in catalog[n].foreign if set(f.columns) == set(catalog[n].key)) for n in types if kinds[n] == "subtype"}
    for n, entity in types.items():
        m.entity(entity, n, *catalog[n].key, supertype=types.get(parents.get(n, "")), keyless=not catalog[n].key)
    for n, entity in types.items():
        t = catalog[n]
        prefix = common_prefix(t)
        dated = any(re.search(r"date|time", c.type) for c in t.columns)
        checks = {c[0]: c for c in (parse_check(SparkSession.active(), x) for x in t.checks) if c}
        for f in t.foreign:
            if f.table not in types or n in parents and set(f.columns) == set(t.key):
                continue
            stem = "".join(words(f.columns[-1][len(prefix) :] if prefix else f.columns[-1])[:-1]) or types[f.table]
            ring = f.table == n
            verb = f"has {stem.lower()}" if ring else "has"
            inverse = f"is {stem.lower()} of" if ring else "is of"
            several = sum(g.table == f.table for g in t.foreign) > 1
            m.reference(entity, types[f.table], f.columns, verb if ring or not several else f"has {stem.lower()}", inverse if ring or not several else f"is {stem.lower()} of", role=stem + types[f.table] if several or ring else None, enforced=f.enforced, references=f.references if f.references != catalog[f.table].key else (), mandatory=not any(t.column(c).nullable for c in f.columns))
        referring = {c for f in t.foreign for c in f.columns if f.table in types}
        for c in t.columns:
            if c.name in referring and c.name not in t.key or re.match(r"(array|map|struct|binary|variant)", c.type):
                continue
            value = value_name(entity, c.name, prefix)
            check = checks.get(c.name)
            values = check[1] if check else tuple(domains.get((n, c.name), ())) if domains and c.type == "string" else ()
            unique = (c.name,) in t.uniques or t.key == (c.name,)
            m.attribute(entity, value, c.name, c.type, mandatory=not c.nullable, unique=unique, allowed=values if check else (), low=check[2] if check else None, high=check[3] if check else None)
            if values and not check:
                say("domain", f"{n}.{c.name}", f"only {', '.join(values[:8])}", f"select * from {n} where {c.name} not in ({', '.join(repr(v) for v in values)})", applied=False)
            if u := unit_of(c.name):
                say("unit", f"{n}.{c.name}", f"is measured in {u}")
            if re.match(r"(double|float|decimal|int|bigint|long)", c.type) and not unique and c.name not in t.key:
                say("additivity", f"{n}.{c.name}", additivity(c.name, dated))
            for path, kind in (documents or {}).get((n, c.name), {}).items():
                leaf = value + "".join(words(path.replace("$.", "").replace(".", "_")))
                m.value(leaf, kind)
                m.attribute(entity, leaf, c.name, kind, path=path)
        for u in t.uniques:
            say("unique", n, f"{', '.join(u)} is unique too", f"select {', '.join(u)} from {n} group by all having count(*) > 1")
    draft.findings += shapes(catalog, known or {})
    draft.findings += one_unit(m) + distinct_readings(m)
    draft.findings += shared_domains(m)
    return draft


def shapes(catalog: Catalog, known: dict[str, dict[str, mine.ColumnFacts]]) -> list[Finding]:
    """Shapes that a person should look at; nothing is changed."""
    out = []
    for n, t in catalog.items():
        groups: dict[str, list[str]] = {}
        for c in t.names():
            if m := re.match(r"(.*?)_?(\d+)$", c):
                groups.setdefault(m[1], []).append(c)
        for stem, cols in groups.items():
            if len(cols) > 1:
                out.append(Finding("repeating group", n, f"{', '.join(cols)} look like one list of {stem}", applied=False, severity="caution"))
        for c in t.names():
            if (m := re.match(r"(.*)_type$", c)) and f"{m[1]}_id" in t.names():
                out.append(Finding("polymorphic", n, f"{c} says what {m[1]}_id refers to", applied=False, severity="caution"))
            elif re.search(r"(_type|_kind|discriminator)$", c):
                out.append(Finding("discriminator", n, f"{c} may tell subtypes apart", applied=False))
        if len(t.key) == 1 and classify(t) == "entity" and len(t.foreign) >= 2 and len(t.columns) <= len(t.foreign) + 2:
            out.append(Finding("surrogate association", n, f"{n} may be a fact between {', '.join(f.table for f in t.foreign)} with a key of its own", applied=False))
        if len(t.key) > 1 and any(set(f.columns) < set(t.key) for f in t.foreign) and classify(t) == "entity":
            out.append(Finding("mixed key", n, f"part of ({', '.join(t.key)}) is a reference", applied=False))
        if n in known and t.key and mine.junk_dimension(known[n], t.key):
            out.append(Finding("junk dimension", n, "lists combinations of a few flags", applied=False))
    return out


def shared_domains(m: Model) -> list[Finding]:
    """Value types that may be one: the same last words and type."""
    groups: dict[tuple[str, str], list[str]] = {}
    for v in m.values.values():
        stem = re.sub(r"^[A-Z][a-z]+", "", v.name)
        if stem:
            groups.setdefault((stem, v.datatype), []).append(v.name)
    return [Finding("shared domain", ", ".join(sorted(g)), f"may be one value type, {k[0]}", applied=False) for k, g in sorted(groups.items()) if len(g) > 1]


def distinct_readings(m: Model) -> list[Finding]:
    """K4: where one verb leads from a type to another by several facts, all but the first say from which columns."""
    seen: set[tuple[str, str, str, str | None]] = set()
    out = []
    for k, f in enumerate(m.facts):
        readings = []
        for verb, a, b in f.readings:
            to = f.roles[b]
            if (f.roles[a].player, verb, to.player, to.name) in seen:
                holder = f.roles[b] if to.columns != (m.entities[to.player].key if to.player in m.entities else ()) else f.roles[a]
                more = " ".join(w.lower() for w in words(holder.columns[-1]))
                out.append(Finding("reading", f"{f.table}.{holder.columns[-1]}", f"is read '{verb} {more}', as '{verb}' is taken"))
                verb = f"{verb} {more}"
            seen.add((f.roles[a].player, verb, to.player, to.name))
            readings.append((verb, a, b))
        m.facts[k] = replace(f, readings=tuple(readings))
    return out


def one_unit(m: Model) -> list[Finding]:
    """Value types of one unit and type that may be merged into one."""
    groups: dict[tuple[str, str], list[str]] = {}
    for f in m.facts:
        for r in f.roles:
            if r.player in m.values and len(r.columns) == 1 and (u := unit_of(r.columns[0])):
                groups.setdefault((u, m.values[r.player].datatype), []).append(r.player)
    return [Finding("one unit", ", ".join(sorted(set(g))), f"all measured in {k[0]}", applied=False) for k, g in sorted(groups.items()) if len(set(g)) > 1]


def deontic(draft: Draft) -> list[Constraint]:
    """Mined claims as rules that rows ought to keep, each with its refuting query in the path language where it has one.

    Mandatory values, and orders between two values of a row that no row breaks.
    """
    out = []
    named = {}
    for f in draft.model.facts:
        if f.roles[0].player in draft.model.entities and f.roles[1].player in draft.model.values and f.readings[0][0] == "has" and len(f.roles[1].columns) == 1 and not f.roles[1].path:
            named[f.table, f.roles[1].columns[0]] = f
    for (n, column), fact in named.items():
        t = draft.catalog[n]
        owner, value = fact.roles[0].player, fact.roles[1].player
        if not t.column(column).nullable and column not in t.key:
            out.append(Constraint(f"{owner} has {value}", f"{owner} BUT NOT has {value}"))
    for x in draft.findings:
        if x.kind == "order of values" and x.applied:
            n, _, pair = x.subject.partition(".")
            low, high = (named.get((n, c)) for c in pair.split(" <= "))
            if low and high:
                out.append(Constraint(f"{x.subject}", f"LIST x, y FROM {low.roles[0].player} has {low.roles[1].player} x AND ALSO has {high.roles[1].player} y WHERE x > y"))
    return out


def recover(name: str, tables: dict[str, DataFrame], keyless: bool = True, declared: Catalog | None = None) -> Draft:
    """The whole way from rows to a draft: keys, references, domains, documents, model, and every pass over the rows.

    declared: a catalogue whose keys and references are checked against the rows
    and completed by mining. Claims that no row refutes become constraints.
    """
    from . import passes

    if declared:
        passes.prefer_referenced_keys(declared, tables)
        said = verify(declared, tables.__getitem__)
    else:
        said = []
    catalog, known, findings = mine_keys(tables, declared)
    findings += [Finding("declared reference", x.split(":")[0], x, applied=False, severity="caution") for x in said]
    domains: dict[tuple[str, str], list[str]] = {}
    documents: dict[tuple[str, str], dict[str, str]] = {}
    for n, df in tables.items():
        for r in mine.domains(df).orderBy("column", "value").collect():
            domains.setdefault((n, r["column"]), []).append(r["value"])
        for c in catalog[n].columns:
            if c.type == "string" and known[n][c.name].rows and df.where(f"`{c.name}` like '{{%'").limit(1).count():
                shape, leaves = mine.json_shape(df, c.name)
                if shape == "record":
                    documents[n, c.name] = leaves
    draft = derive(name, catalog, known, domains, keyless, documents)
    draft.findings = findings + draft.findings
    for run in passes.PASSES:
        draft.findings += run(passes.Data(tables, catalog, known, documents))
    draft.model.constraints += deontic(draft)
    return draft


__all__ = ["Draft", "Finding", "Role", "classify", "derive", "recover"]
