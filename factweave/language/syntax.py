"""The syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Number:
    value: int | float


@dataclass
class Text:
    value: str


@dataclass
class Name:
    name: str


@dataclass
class Outer:
    """``!x``: the outer query's x."""

    name: str


@dataclass
class Call:
    function: str
    args: list[Any]


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Negative:
    value: Any


@dataclass
class Choice:
    condition: Any
    then: Any
    other: Any


@dataclass
class Named:
    """``e AS name``"""

    value: Any
    name: str


@dataclass
class Atom:
    """A stop on a path: a type, a variable, a denotation, or several of them."""

    type: str | None = None
    var: str | None = None
    denoted: list[Any] | None = None


@dataclass
class Step:
    verb: str
    atom: Atom | None
    optional: bool = False


@dataclass
class Bracket:
    body: Any


@dataclass
class Path:
    """head is None for a path that starts with a verb: it continues from the query's head."""

    head: Atom | None
    steps: list[Step | Bracket] = field(default_factory=list)
    distinct: bool = False
    only: bool = False


@dataclass
class Combined:
    """op: also, or, but not"""

    op: str
    left: Any
    right: Any


@dataclass
class Where:
    body: Any
    condition: Any


@dataclass
class SetOf:
    """op: union, intersect, minus"""

    op: str
    left: Any
    right: Any


@dataclass
class Compare:
    op: str
    left: Any
    right: Any


@dataclass
class SetCompare:
    op: str
    left: Any
    right: Any
    negated: bool = False


@dataclass
class Logic:
    """op: and, or, xor, implies, iff, not"""

    op: str
    args: list[Any]


@dataclass
class Some:
    body: Any


@dataclass
class SortKey:
    value: Any
    descending: bool = False


@dataclass
class Cut:
    first: int
    after: int = 0
    per: str | None = None
    ties: bool = False


@dataclass
class Aggregate:
    function: str
    distinct: bool = False
    arg: Any = None
    body: Any = None
    by: Any = None
    separator: str | None = None
    order: list[SortKey] = field(default_factory=list)
    cut: Cut | None = None
    keys: list[Any] | None = None
    within: bool = False
    ascending: bool = False


@dataclass
class Item:
    value: Any
    label: str


@dataclass
class Element:
    """Of a confluence: a side path gathered onto the base."""

    path: Any
    name: str | None = None
    via: str | None = None
    order: list[SortKey] = field(default_factory=list)
    cut: Cut | None = None


@dataclass
class Query:
    body: Any
    items: list[Item] | None = None
    order: list[SortKey] = field(default_factory=list)
    cut: Cut | None = None
    elements: list[Element] = field(default_factory=list)


@dataclass
class Script:
    definitions: list[tuple[str, str]]
    query: Query
