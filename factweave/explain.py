"""Reading a query or a model back: in English, as a listing, as rules, by relevance."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .language import normal
from .language import syntax as S
from .language.parser import QueryError, parse
from .model import Entity, Fact, Model

STOP = {"the", "of", "a", "an", "has", "have", "is", "are", "and", "for", "in", "with", "what", "which", "how", "many", "each", "all", "list"}
SEVERITY = {"risk": "!", "caution": "?", "note": "-"}


@dataclass
class Reading:
    """What a query says, what it takes for granted, and what is worth checking."""

    sentence: str = ""
    normal: str = ""
    resolved: list[str] = field(default_factory=list)
    expanded: list[str] = field(default_factory=list)
    requires: list[str] = field(default_factory=list)
    checks: list[tuple[str, str]] = field(default_factory=list)

    @property
    def risks(self) -> int:
        return sum(s == "risk" for s, _ in self.checks)

    def as_dict(self) -> dict:
        return self.__dict__ | {"checks": [{"severity": s, "said": t} for s, t in self.checks], "risk_count": self.risks}

    def text(self) -> str:
        out = [self.sentence, "", "Normalised: " + self.normal]
        for title, lines in (("Resolved", self.resolved), ("Expanded", self.expanded), ("This query requires", self.requires)):
            if lines:
                out += ["", title + ":", *[f"  {x}" for x in lines]]
        if self.checks:
            out += ["", "Worth checking:", *[f"  {SEVERITY[s]} {t}" for s, t in self.checks]]
        return "\n".join(out)


class _Reader:
    def __init__(self, model: Model):
        self.model = model
        self.out = Reading()
        self.types: dict[str, str] = {}

    def resolve(self, verb: str, here: str, target: str | None) -> tuple[Fact, int, int] | None:
        from .plans.compiler import Compiler

        try:
            return Compiler.resolve(self, verb, here, target)
        except QueryError as why:
            self.out.checks.append(("risk", str(why)))
            return None

    def path(self, p: S.Path, head: str | None, optional: bool = False) -> tuple[str, str | None]:
        here = head
        words = []
        if p.head is not None:
            here = p.head.type or self.types.get(p.head.var or "", head)
            if p.head.type and p.head.var:
                self.types[p.head.var] = p.head.type
            words.append(f"each {p.head.type or p.head.var}" + (f" identified by {normal.atom(S.Atom(denoted=p.head.denoted))}" if p.head.denoted else ""))
        fans = 0
        for s in p.steps:
            if isinstance(s, S.Bracket):
                words.append(f"(where it {self.body(s.body, here)})")
                continue
            found = self.resolve(s.verb, here, s.atom.type if s.atom else None) if here else None
            if not found:
                words.append(f"{s.verb} {normal.atom(s.atom) if s.atom else ''}".strip())
                here = s.atom.type if s.atom else None
                continue
            fact, i, j = found
            there = s.atom.type if s.atom and s.atom.type in self.model.entities else fact.roles[j].player
            self.out.resolved.append(f"{here} {s.verb} {there}: {fact.name}")
            if not fact.functional(i):
                fans += 1
            if not s.optional and not fact.roles[i].mandatory and fact.functional(i):
                self.out.requires.append(f"{here} must have a {there}: rows without one are dropped")
                if fact.roles[j].player in self.model.values:
                    self.out.checks.append(("caution", f"{here} without {there} is dropped; write OPTIONALLY {s.verb} to keep it"))
            if s.atom and s.atom.denoted:
                self.out.expanded.append(f"{normal.atom(s.atom)} compares what identifies {there}")
            if s.atom and s.atom.var:
                self.types[s.atom.var] = there
            words.append(("possibly " if s.optional else "") + f"{s.verb} {normal.atom(s.atom) if s.atom else there}")
            here = there
        self.fans += fans
        return " ".join(words), here

    fans = 0

    def body(self, tree: Any, head: str | None) -> str:
        if isinstance(tree, S.Path):
            return self.path(tree, head)[0]
        if isinstance(tree, S.Combined):
            left = self.body(tree.left, head)
            first = self.first(tree.left)
            start = head or (first.head.type if first and first.head else None)
            return left + {"also": ", and also ", "or": ", or otherwise ", "but not": ", but not "}[tree.op] + self.body(tree.right, start)
        if isinstance(tree, S.Where):
            return f"{self.body(tree.body, head)}, where {normal.text(tree.condition)}"
        if isinstance(tree, S.SetCompare):
            self.out.checks.append(("caution", f"'{normal.text(tree)}' compares whole sets: an empty set is within any other"))
        if isinstance(tree, S.Named) and isinstance(tree.value, S.Aggregate):
            self.aggregate(tree.value)
            return f"{tree.name} being {normal.text(tree.value)}"
        return normal.text(tree)

    def aggregate(self, a: S.Aggregate) -> None:
        if a.function in ("sum", "avg") and self.fans:
            self.out.checks.append(("note", f"the path repeats rows: {normal.text(a)} takes each value once for what has it"))
        if a.function == "count" and a.body is not None and isinstance(a.body, S.Path) and a.body.steps and isinstance(a.body.steps[-1], S.Step):
            self.out.checks.append(("caution", f"{normal.text(a)} counts the end of its path; put steps in [ ] to count its head"))

    def first(self, tree: Any) -> S.Path | None:
        while not isinstance(tree, S.Path):
            if isinstance(tree, (S.Combined, S.SetOf)):
                tree = tree.left
            elif isinstance(tree, S.Where):
                tree = tree.body
            else:
                return None
        return tree


def explain(model: Model, text: str) -> Reading:
    """L1, L2: what a query says and what is worth checking, without running it."""
    r = _Reader(model)
    script = parse(model, text)
    if script.query is None:
        r.out.sentence = "Definitions: " + ", ".join(n for n, _ in script.definitions)
        r.out.normal = text
        return r.out
    q = script.query
    said = r.body(q.body, None) if q.body is not None else "nothing"
    for i in q.items or []:
        if isinstance(i.value, S.Aggregate):
            r.aggregate(i.value)
    listed = ", ".join(normal.text(i.value) for i in q.items) if q.items else "what is at both ends"
    r.out.sentence = f"List {listed} for {said}."
    r.out.normal = normal.query(q)
    if q.cut and not q.order:
        r.out.checks.append(("risk", f"the first {q.cut.first} of rows in no order are any {q.cut.first} rows"))
    elif q.cut and not q.cut.ties:
        r.out.checks.append(("caution", "rows that tie at the cut are left out by chance: write WITH TIES, or sort by more"))
    if r.fans > 1:
        r.out.checks.append(("caution", "two branches reach many each: rows pair all of one with all of the other"))
    return r.out


def schema(model: Model, relevant: set[str] | None = None, relational: bool = False, knowledge: list | None = None) -> str:
    """Types, how they are identified, their domains, and every reading.

    knowledge: findings of a draft; those about listed tables are listed too.
    """
    out = [f"Model {model.name}", "", "Entity types:"]
    for e in model.entities.values():
        if relevant is None or e.name in relevant:
            out.append(f"  {e.name}" + (f" (a {e.supertype})" if e.supertype else "") + (f", identified by {', '.join(e.key)}" if relational else "") + (", without identity" if e.keyless else ""))
    out += ["", "Value types:"]
    for v in model.values.values():
        if relevant is None or v.name in relevant:
            limits = f" in {', '.join(map(str, v.allowed))}" if v.allowed else f" from {v.low} to {v.high}" if v.low is not None else ""
            out.append(f"  {v.name}: {v.datatype}{limits}")
    out += ["", "Readings:"]
    for f in model.facts:
        for verb, i, j in f.readings:
            a, b = f.roles[i].player, f.roles[j].player
            if relevant is None or {a, b} <= relevant:
                many = "" if f.functional(i) else " (many)"
                out.append(f"  {a} {verb} {f.roles[j].name or b}{many}" + (f"    {f.table}.{', '.join(f.roles[j].columns)}" if relational else ""))
    if model.macros:
        out += ["", "Macros:", *[f"  {k}({', '.join(p)}) = {b}" for k, (p, b) in model.macros.items()]]
    if model.rules:
        out += ["", "Defined terms:", *[f"  {r.name} ::= {r.source}" for r in model.rules]]
    if knowledge:
        tables = {e.table for e in model.entities.values() if relevant is None or e.name in relevant}
        said = [f"  {f.subject}: {f.said} ({f.kind})" for f in knowledge if re.split(r"[.(]", f.subject)[0] in tables]
        out += ["", "Known of the rows:", *said]
    return "\n".join(out)


def tokens(text: str) -> set[str]:
    found = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|\d+", text)} - STOP
    return {w.rstrip("s") for w in found}


def link(model: Model, question: str, seeds: int = 40, hops: int = 1) -> set[str]:
    """The types that a question speaks of, and what connects them."""
    asked = tokens(question)
    score: dict[str, float] = {}
    for name in [*model.entities, *model.values]:
        own = tokens(name)
        hit = len(own & asked) / max(1, len(own))
        v = model.values.get(name)
        if v and any(str(a).lower() in question.lower() for a in v.allowed):
            hit += 1
        for f in model.facts:
            if any(r.player == name for r in f.roles):
                hit += 0.1 * len({w for verb, _, _ in f.readings for w in tokens(verb)} & asked)
        if hit:
            score[name] = hit
    found = {n for n, _ in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:seeds]}
    links: dict[str, set[str]] = {}
    for f in model.facts:
        for r in f.roles:
            links.setdefault(r.player, set()).update(x.player for x in f.roles if x.player in model.entities)
    for n in list(found):
        if n in model.values:
            found |= links.get(n, set())
    entities = {n for n in found if n in model.entities}
    for a in entities:
        for b in entities:
            if a < b:
                found |= set(shortest(links, a, b))
    for _ in range(hops - 1):
        found |= {x for n in list(found) for x in links.get(n, ())}
    for e in [n for n in found if n in model.entities]:
        found |= {f.roles[1].player for f in model.facts if f.roles[0].player == e and f.roles[1].columns == model.entities[e].key}
    return found


def shortest(links: dict[str, set[str]], a: str, b: str, most: int = 4) -> list[str]:
    paths = [[a]]
    seen = {a}
    for _ in range(most):
        grown = []
        for p in paths:
            for n in sorted(links.get(p[-1], ())):
                if n == b:
                    return [*p, n]
                if n not in seen:
                    seen.add(n)
                    grown.append([*p, n])
        paths = grown
    return []


def rules(model: Model) -> list[str]:
    """The model's constraints and rules as sentences."""
    out = []
    for e in model.entities.values():
        if e.supertype:
            out.append(f"Each {e.name} is a {e.supertype}.")
        if e.key:
            out.append(f"Each {e.name} is identified by its {' and '.join(e.key)}.")
    for f in model.facts:
        verb, i, j = f.readings[0]
        a, b = f.roles[i].player, f.roles[j].name or f.roles[j].player
        if f.functional(i):
            out.append(f"Each {a} {verb} {'exactly' if f.roles[i].mandatory else 'at most'} one {b}.")
        else:
            out.append(f"It is possible that some {a} {verb} more than one {b}.")
        if f.functional(j) and not f.functional(i) or f.functional(j) and len(f.readings) > 1:
            back = next((v for v, x, y in f.readings if (x, y) == (j, i)), None)
            out.append(f"Each {b} {back} at most one {a}." if back else f"No two {a} instances share a {b}.")
    for v in model.values.values():
        if v.allowed:
            out.append(f"The possible values of {v.name} are {', '.join(repr(x) for x in v.allowed)}.")
        if v.low is not None or v.high is not None:
            out.append(f"The possible values of {v.name} are from {v.low} to {v.high}.")
    out += [f"{r.name} holds if and only if {r.source}." for r in model.rules]
    out += [f"It is forbidden that {c.violation}." for c in model.constraints]
    return out


def _parts(m: Model, name: str) -> list[tuple[Fact, int]]:
    return [(f, i) for f in m.facts for i, r in enumerate(f.roles) if r.player == name]


def _meets_entity(m: Model, f: Fact, i: int) -> bool:
    return any(r.player in m.entities for k, r in enumerate(f.roles) if k != i)


#: What makes an entity type weigh: a rule's name, its weight, and how often it holds of the type.
WEIGHTS: tuple[tuple[str, float, Callable[[Model, Entity], float]], ...] = (
    ("facts with other entity types", 2.0, lambda m, e: sum(_meets_entity(m, f, i) for f, i in _parts(m, e.name))),
    ("facts with values", 0.5, lambda m, e: sum(not _meets_entity(m, f, i) for f, i in _parts(m, e.name))),
    ("mandatory roles", 0.5, lambda m, e: sum(f.roles[i].mandatory for f, i in _parts(m, e.name))),
    ("roles that fix the rest", 0.25, lambda m, e: sum(f.functional(i) for f, i in _parts(m, e.name))),
    ("others that refer to it", 0.5, lambda m, e: len({f.table for f, i in _parts(m, e.name) if f.table != e.table})),
    ("subtypes", 1.0, lambda m, e: sum(x.supertype == e.name for x in m.entities.values())),
    ("facts of three roles and more", 0.5, lambda m, e: sum(len(f.roles) > 2 for f, _ in _parts(m, e.name))),
    ("references to itself", 0.5, lambda m, e: len({f.name for f, _ in _parts(m, e.name) if sum(r.player == e.name for r in f.roles) > 1})),
    ("values of a stated domain", 0.25, lambda m, e: sum(bool((v := m.values.get(r.player)) and (v.allowed or v.low is not None)) for f, _ in _parts(m, e.name) for r in f.roles)),
    ("rules and constraints that name it", 1.0, lambda m, e: sum(bool(re.search(rf"\b{e.name}\b", t)) for t in [*(r.source for r in m.rules), *(c.violation for c in m.constraints)])),
    ("being a subtype", -1.0, lambda m, e: bool(e.supertype)),
    ("having no identity", -1.0, lambda m, e: e.keyless),
)


def abstraction(model: Model, keep: float = 0.5) -> list[list[str]]:
    """Entity types by the sum of WEIGHTS, heaviest first, as a ladder of smaller and smaller views."""
    weight = {e.name: sum(w * rule(model, e) for _, w, rule in WEIGHTS) for e in model.entities.values()}
    ranked = sorted(weight, key=lambda n: (-weight[n], n))
    out = []
    while ranked:
        out.append(list(ranked))
        if len(ranked) == 1:
            break
        ranked = ranked[: max(1, int(len(ranked) * keep))]
    return out


def annotated_ddl(model: Model, budget: int = 8000) -> str:
    """The tables with what the model knows of their columns, cut at whole tables to a budget of characters."""
    out: list[str] = []
    size = 0
    for ladder in abstraction(model)[:1]:
        for name in ladder:
            e = model.entities[name]
            lines = [f"create table {e.table} ( -- {name}" + (f", a {e.supertype}" if e.supertype else "")]
            for f in model.facts:
                if f.table == e.table and f.roles[0].player == name:
                    r = f.roles[1]
                    v = model.values.get(r.player)
                    kind = v.datatype if v else "reference"
                    lines.append(f"  {', '.join(r.columns)} {kind}, -- {f.readings[0][0]} {r.name or r.player}" + (f": {', '.join(map(str, v.allowed[:6]))}" if v and v.allowed else ""))
            lines.append(f"  primary key ({', '.join(e.key)}));" if e.key else ");")
            block = "\n".join(lines)
            if size + len(block) > budget:
                return "\n".join(out) + f"\n-- {len(ladder) - len(out)} more tables"
            out.append(block)
            size += len(block)
    return "\n".join(out)


def restricted(model: Model, allowed: set[str]) -> Model:
    """The model without what may not be read; facts that touch other types go."""
    m = model.copy()
    m.entities = {k: e for k, e in m.entities.items() if k in allowed}
    m.values = {k: v for k, v in m.values.items() if k in allowed}
    m.facts = [f for f in m.facts if all(m.has_type(r.player) for r in f.roles)]
    m.rules, m.constraints = [], []
    return m
