"""A frame: a DataFrame under construction, and what the query knows about it.

Every scan gives its columns names of its own (``t3__emp_nr``), so no join is
ever ambiguous and a column means the same in every later plan. A node is an
instance on the path: the columns that identify it, and the scanned rows that
belong to it alone, in which its functional facts can be read without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.parser import QueryError
from ..model import Fact, Model

Source = Callable[[str], DataFrame]


@dataclass(eq=False)
class Node:
    type: str
    cols: tuple[str, ...]
    rows: dict[str, str] = field(default_factory=dict)
    optional: bool = False
    #: Columns of the outer query that a lazily scanned root equals.
    outer: tuple[str, ...] = ()
    #: For a range over values: the table, columns and scan that they come from.
    home: tuple[str, tuple[str, ...], str] | None = None


@dataclass(eq=False)
class Calc:
    """A computed column and the nodes that it reads."""

    col: str
    reads: tuple[Node, ...] = ()


@dataclass(eq=False)
class Pending:
    """An aggregate or window that is computed once all rows are known."""

    kind: str
    tree: Any
    value: Column | None = None
    nodes: tuple[Node, ...] = ()
    keys: list[Any] = field(default_factory=list)
    col: str = ""
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass(eq=False)
class Edge:
    src: Node
    dst: Node
    fact: Fact
    i: int
    j: int

    @property
    def fans(self) -> bool:
        return not self.fact.functional(self.i)


class Context:
    """What one compilation shares: the model, the tables, and a source of names."""

    def __init__(self, spark: SparkSession, model: Model, source: Source, permissive: bool = False):
        self.spark = spark
        self.model = model
        self.source = source
        self.permissive = permissive
        self.derived: dict[str, DataFrame] = {}
        self.judgements: list[str] = []
        self._n = 0

    def fresh(self, stem: str) -> str:
        self._n += 1
        return f"{stem}{self._n}"

    def scan(self, table: str) -> tuple[DataFrame, str]:
        prefix = self.fresh("t")
        df = self.derived[table] if table in self.derived else self.source(table)
        return df.select(*[F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in df.columns]), prefix

    def judge(self, message: str) -> None:
        """Refuse what has no single meaning, or record it where asked to go on."""
        if not self.permissive:
            raise QueryError(message)
        self.judgements.append(message)


class Frame:
    def __init__(self, ctx: Context, outer: Frame | None = None):
        self.ctx = ctx
        self.outer = outer
        self.df: DataFrame | None = None
        self.names: dict[str, Node | Calc | Pending] = {}
        self.lost: dict[str, str] = {}
        self.edges: list[Edge] = []
        self.roots: list[Node] = []
        self.head: Node | None = None
        self.tail: Any = None
        self.distinct = False
        self.pairs: list[tuple[str, str]] = []
        self.theta: list[Column] = []
        self.pending: list[Pending] = []
        self.late: list[Any] = []
        self.grouped = False
        self.key_nodes: tuple[Node, ...] = ()
        #: Aggregates over bags of their own that the query lists, and the columns of those that are known.
        self.listed: list[Any] = []
        self.folded: dict[str, str] = {}

    # -- rows ---------------------------------------------------------------------

    def one_row(self) -> None:
        if self.df is None:
            self.df = self.ctx.spark.range(1).select(F.lit(1).alias(self.ctx.fresh("one")))

    def where(self, condition: Column) -> None:
        self.df = self.df.where(condition)

    def add(self, value: Column, stem: str = "c") -> str:
        name = self.ctx.fresh(stem)
        self.df = self.df.withColumn(name, value)
        return name

    def links(self) -> list[tuple[str, str]]:
        """Pairs of own columns and columns of the outer query that must be equal."""
        return self.pairs + [(a, b) for r in self.roots if r.outer for a, b in zip(r.cols, r.outer, strict=True)]

    def lookup(self, name: str) -> Node | Calc | Pending:
        if name in self.lost:
            raise QueryError(self.lost[name])
        if name not in self.names:
            raise QueryError(f"nothing is named {name!r} here")
        return self.names[name]

    def node(self, name: str) -> Node | None:
        found = self.names.get(name)
        return found if isinstance(found, Node) else None

    def all_nodes(self) -> list[Node]:
        out = list(self.roots)
        for e in self.edges:
            out += [n for n in (e.src, e.dst) if n not in out]
        return out


@dataclass
class Test:
    """Rows that may or may not exist beside an outer row."""

    df: DataFrame
    pairs: list[tuple[str, str]]
    theta: list[Column] = field(default_factory=list)
    null_safe: bool = False

    def condition(self) -> Column | None:
        parts = [F.col(a).eqNullSafe(F.col(b)) if self.null_safe else F.col(a) == F.col(b) for a, b in self.pairs] + self.theta
        return conjunction(parts)


def conjunction(parts: Iterable[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def keep(frame: Frame, test: Test, exists: bool) -> None:
    """Keep the rows beside which the test's rows exist, or don't: a semi- or anti-join."""
    far = [(a, b) for a, b in test.pairs if b not in frame.df.columns]
    if far:
        carry(frame, test, far, exists)
        return
    on = test.condition()
    if on is None:
        flag(frame, test)
        frame.where(F.col(frame.flag_col) if exists else ~F.col(frame.flag_col))
        return
    frame.df = frame.df.join(test.df, on, "left_semi" if exists else "left_anti")


def carry(frame: Frame, test: Test, far: list[tuple[str, str]], exists: bool) -> None:
    """A test that also refers to a row further out: its keys become columns of this frame, which is then tied to that row."""
    if not exists or test.theta:
        raise QueryError("a negated test refers to a name two levels out: bind it in between")
    near = [p for p in test.pairs if p not in far]
    if not near:
        raise QueryError("a test refers only to names further out: state it there")
    found = test.df.select(*dict.fromkeys(a for a, _ in test.pairs)).distinct()
    frame.df = frame.df.join(found, conjunction(F.col(a) == F.col(b) for a, b in near))
    frame.pairs += far


def flag(frame: Frame, test: Test) -> Column:
    """Whether the test's rows exist, as a boolean column: for conditions under OR and NOT.

    The test's keys are made distinct, so the outer join can't multiply rows.
    """
    if any(b not in frame.df.columns for _, b in test.pairs):
        raise QueryError("a test under OR or NOT refers to a name two levels out: bind it in between")
    col = frame.ctx.fresh("has")
    frame.flag_col = col
    if not test.pairs and not test.theta:
        one = test.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(col))
        frame.df = frame.df.crossJoin(F.broadcast(one))
        return F.col(col)
    if test.theta:
        raise QueryError("a comparison with an outer value can't stand under OR or NOT: name the value in the path and compare there")
    keys = test.df.select(*[F.col(a).alias(f"{col}_{i}") for i, (a, _) in enumerate(test.pairs)]).distinct().withColumn(col, F.lit(True))
    on = [F.col(f"{col}_{i}").eqNullSafe(F.col(b)) if test.null_safe else F.col(f"{col}_{i}") == F.col(b) for i, (_, b) in enumerate(test.pairs)]
    frame.df = frame.df.join(keys, conjunction(on), "left")
    out = frame.add(F.coalesce(F.col(col), F.lit(False)), "is")
    frame.flag_col = out
    return F.col(out)
