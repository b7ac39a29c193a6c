"""The conceptual model: what there is, which facts relate it, where rows hold them.

Entity types are identified by columns of a table. Fact types relate two roles;
each role is a list of columns of the table that stores the fact. Readings name
the verbs by which a fact is walked. Uniqueness says which roles determine the
rest: the compiler uses it to find joins that can't multiply rows, and values
that must not be summed twice.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


class ModelError(ValueError):
    """A model that does not hold together."""


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    key: tuple[str, ...]
    supertype: str | None = None
    #: A row identity without key columns: instances are the table's rows.
    keyless: bool = False


@dataclass(frozen=True)
class Value:
    name: str
    datatype: str = "string"
    allowed: tuple = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Role:
    player: str
    columns: tuple[str, ...]
    name: str | None = None
    #: JSON path within the (one) column, read as the player's data type.
    path: str | None = None
    mandatory: bool = False
    #: Whether every referenced instance is known to exist.
    enforced: bool = True
    #: The referenced columns, where these are not the player's key.
    references: tuple[str, ...] = ()


@dataclass(frozen=True)
class Fact:
    name: str
    table: str
    roles: tuple[Role, ...]
    #: (verb, from role, to role)
    readings: tuple[tuple[str, int, int], ...]
    #: Sets of roles that fix the others.
    unique: tuple[frozenset[int], ...] = ()

    def functional(self, role: int) -> bool:
        return frozenset((role,)) in self.unique


@dataclass(frozen=True)
class Rule:
    """A derived subtype (one item) or fact type (several), as query text."""

    name: str
    source: str


@dataclass(frozen=True)
class Constraint:
    """A query whose rows are counter-examples."""

    name: str
    violation: str


@dataclass
class Model:
    name: str
    entities: dict[str, Entity] = field(default_factory=dict)
    values: dict[str, Value] = field(default_factory=dict)
    facts: list[Fact] = field(default_factory=list)
    macros: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)

    def entity(self, name: str, table: str, *key: str, supertype: str | None = None, keyless: bool = False) -> Model:
        self.entities[name] = Entity(name, table, key, supertype, keyless)
        return self

    def value(self, name: str, datatype: str = "string", allowed: tuple = (), low: float | None = None, high: float | None = None) -> Model:
        self.values[name] = Value(name, datatype, allowed, low, high)
        return self

    def attribute(self, owner: str, value: str, column: str, datatype: str = "string", verb: str = "has", path: str | None = None, mandatory: bool = False, unique: bool = False, **restriction) -> Model:
        """A value that each instance has at most once, in its own table."""
        e = self.entities[owner]
        if value not in self.values:
            self.value(value, datatype, **restriction)
        keys = (frozenset((0,)), frozenset((1,))) if unique or (column,) == e.key else (frozenset((0,)),)
        self.facts.append(Fact(f"{owner}Has{value}", e.table, (Role(owner, e.key, mandatory=mandatory), Role(value, (column,), path=path)), _both_ways(verb), keys))
        return self

    def reference(self, owner: str, target: str, columns: tuple[str, ...], verb: str, inverse: str, role: str | None = None, enforced: bool = True, references: tuple[str, ...] = (), mandatory: bool = False) -> Model:
        """A functional fact held as a foreign key in the owner's table."""
        e = self.entities[owner]
        self.facts.append(
            Fact(f"{owner}{verb.title().replace(' ', '')}{role or target}", e.table, (Role(owner, e.key, mandatory=mandatory), Role(target, columns, role, enforced=enforced, references=references)), ((verb, 0, 1), (inverse, 1, 0)), (frozenset((0,)),))
        )
        return self

    def association(self, name: str, table: str, left: tuple[str, tuple[str, ...]], right: tuple[str, tuple[str, ...]], verb: str, inverse: str, unique: tuple[frozenset[int], ...] = (frozenset((0, 1)),)) -> Model:
        """A many-to-many fact held in a table of its own."""
        self.facts.append(Fact(name, table, (Role(*left), Role(*right)), ((verb, 0, 1), (inverse, 1, 0)), unique))
        return self

    def fact(self, name: str, table: str, roles: tuple[Role, ...], readings: tuple[tuple[str, int, int], ...], unique: tuple[frozenset[int], ...] = ()) -> Model:
        """A fact type of any number of roles; readings name the verb from one role to another."""
        self.facts.append(Fact(name, table, roles, readings, unique or (frozenset(range(len(roles))),)))
        return self

    def objectified(self, name: str, table: str, roles: tuple[tuple[str, tuple[str, ...], str, str], ...]) -> Model:
        """A fact between entities that is an entity too, identified by all its players.

        roles: (player, columns, verb from the fact to the player, verb back). A path
        may stop on it, start from it, or leave it by another of its roles.
        """
        self.entity(name, table, *(c for _, columns, _, _ in roles for c in columns))
        for player, columns, verb, back in roles:
            self.reference(name, player, columns, verb, back, mandatory=True)
        return self

    # -- derived schema functions -------------------------------------------------

    def supertypes(self, name: str) -> list[str]:
        out = [name]
        while (e := self.entities.get(out[-1])) and e.supertype:
            if e.supertype in out:
                raise ModelError(f"{name} is a subtype of itself")
            out.append(e.supertype)
        return out

    def related(self, a: str, b: str) -> bool:
        return a in self.supertypes(b) or b in self.supertypes(a) or self.root(a) == self.root(b)

    def root(self, name: str) -> str:
        return self.supertypes(name)[-1]

    def has_type(self, name: str) -> bool:
        return name in self.entities or name in self.values

    def carriers(self, value: str) -> list[tuple[Fact, int]]:
        return [(f, i) for f in self.facts for i, r in enumerate(f.roles) if r.player == value]

    @property
    def uniqueness_known(self) -> bool:
        return any(f.unique for f in self.facts)

    def verbs(self) -> set[str]:
        return {v for f in self.facts for v, _, _ in f.readings}

    def copy(self) -> Model:
        return Model(self.name, dict(self.entities), dict(self.values), list(self.facts), dict(self.macros), list(self.rules), list(self.constraints))

    # -- checks and storage -------------------------------------------------------

    def problems(self) -> list[str]:
        """What is wrong with the model's structure, in words."""
        out = []
        for e in self.entities.values():
            if not e.key and not e.keyless:
                out.append(f"{e.name} has no identifying columns")
            if e.supertype and e.supertype not in self.entities:
                out.append(f"{e.name} is a subtype of {e.supertype}, which the model lacks")
            if e.supertype in self.entities and len(e.key) != len(self.entities[e.supertype].key):
                out.append(f"{e.name} and its supertype {e.supertype} differ in the number of identifying columns")
        if both := set(self.entities) & set(self.values):
            out.append(f"both an entity type and a value type: {', '.join(sorted(both))}")
        names = set()
        for f in self.facts:
            if f.name in names:
                out.append(f"two fact types are named {f.name}")
            names.add(f.name)
            for r in f.roles:
                if not self.has_type(r.player):
                    out.append(f"{f.name} has a role for {r.player}, which the model lacks")
                elif r.player in self.entities and len(r.columns) != len(self.entities[r.player].key) and not self.entities[r.player].keyless:
                    out.append(f"{f.name} maps {r.player} to {len(r.columns)} columns; it is identified by {len(self.entities[r.player].key)}")
            for verb, a, b in f.readings:
                if not (0 <= a < len(f.roles) and 0 <= b < len(f.roles)):
                    out.append(f"the reading {verb!r} of {f.name} names a role that it lacks")
            for u in f.unique:
                if not u or not u <= set(range(len(f.roles))):
                    out.append(f"a uniqueness constraint of {f.name} names a role that it lacks")
        return out

    def to_json(self) -> str:
        role = lambda r: {"player": r.player, "columns": r.columns, "name": r.name, "path": r.path, "mandatory": r.mandatory, "enforced": r.enforced, "references": r.references}
        return json.dumps(
            {
                "name": self.name,
                "entities": [e.__dict__ for e in self.entities.values()],
                "values": [v.__dict__ for v in self.values.values()],
                "facts": [{"name": f.name, "table": f.table, "roles": [role(r) for r in f.roles], "readings": f.readings, "unique": [sorted(u) for u in f.unique]} for f in self.facts],
                "macros": {k: {"parameters": p, "body": b} for k, (p, b) in self.macros.items()},
                "rules": [r.__dict__ for r in self.rules],
                "constraints": [c.__dict__ for c in self.constraints],
            },
            indent=1,
        )

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        m = Model(d["name"])
        for e in d.get("entities", []):
            m.entities[e["name"]] = Entity(**e | {"key": tuple(e["key"])})
        for v in d.get("values", []):
            m.values[v["name"]] = Value(**v | {"allowed": tuple(v.get("allowed", ()))})
        for f in d.get("facts", []):
            roles = tuple(Role(**r | {"columns": tuple(r["columns"]), "references": tuple(r.get("references", ()))}) for r in f["roles"])
            m.facts.append(Fact(f["name"], f["table"], roles, tuple((v, a, b) for v, a, b in f["readings"]), tuple(frozenset(u) for u in f.get("unique", ()))))
        m.macros = {k: (tuple(x["parameters"]), x["body"]) for k, x in d.get("macros", {}).items()}
        m.rules = [Rule(**r) for r in d.get("rules", [])]
        m.constraints = [Constraint(**c) for c in d.get("constraints", [])]
        return m

    @staticmethod
    def load(path: str) -> Model:
        return Model.from_json(Path(path).read_text())


def inverse_of(verb: str) -> str | None:
    """``has`` is walked back as ``is of``, ``has x`` as ``is x of``."""
    if verb == "has":
        return "is of"
    if verb.startswith("has "):
        return f"is {verb[4:]} of"
    return None


def _both_ways(verb: str) -> tuple[tuple[str, int, int], ...]:
    back = inverse_of(verb)
    return ((verb, 0, 1), (back, 1, 0)) if back else ((verb, 0, 1),)
