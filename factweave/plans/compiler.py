"""From a syntax tree to a DataFrame.

Paths become joins, brackets that bind nothing become semi-joins (or plain
filters, where the model says that they can't multiply rows), aggregates become
grouped DataFrames that are joined back on their keys. No plan is hand-scheduled:
every choice of join and exchange stays with Catalyst and adaptive execution.
"""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import AGGREGATES as OWN
from ..functions.scalar import FUNCTIONS, number
from ..language import syntax as S
from ..language.parser import Parser, QueryError, parse
from ..model import Entity, Fact, Model, Role, Value
from ..sources.scratch import materialise, scratch
from ..sources.tables import read_bytes
from . import determine
from .frame import Calc, Context, Edge, Frame, Node, Pending, Source, Test, conjunction, flag, keep

COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
EXEMPT = ("min", "max")
#: Bytes of the tables read for each task that makes rows distinct by their owners, and of the owners' own table at least.
TASK_BYTES = 8 << 20
OWNER_BYTES = 64 << 10


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


class Compiler:
    def __init__(self, ctx: Context):
        self.ctx = ctx
        self.reading: Frame | None = None

    @property
    def model(self) -> Model:
        return self.ctx.model

    # == paths =====================================================================

    def resolve(self, verb: str, here: str, target: str | None) -> tuple[Fact, int, int]:
        """The one fact that a verb walks from a type, to a target if one is named."""
        m = self.model
        found = [(f, i, j) for f in m.facts for v, i, j in f.readings if v == verb and m.related(here, f.roles[i].player)]
        reaches = lambda f, j: target is None or f.roles[j].name == target or (m.has_type(target) and m.related(target, f.roles[j].player))
        hits = [x for x in found if reaches(x[0], x[2])]
        if target and (named := [x for x in hits if x[0].roles[x[2]].name == target]):
            hits = named
        if target and len(hits) > 1 and (exact := [x for x in hits if x[0].roles[x[2]].player == target]):
            hits = exact
        if len(hits) > 1 and (exact := [x for x in hits if x[0].roles[x[1]].player == here]):
            hits = exact
        if len(hits) == 1:
            return hits[0]
        if not hits:
            others = sorted({f"{v} {f.roles[j].player}" for f in m.facts for v, i, j in f.readings if m.related(here, f.roles[i].player) and (target is None or reaches(f, j))})
            hint = f"; {here} {', '.join(others[:8])}" if others else ""
            raise QueryError(f"no fact is read '{here} {verb}{' ' + target if target else ''}'{hint}")
        raise QueryError(f"'{here} {verb}{' ' + target if target else ''}' is ambiguous: {', '.join(sorted(f.name for f, _, _ in hits))}; name the target or a longer verb")

    def start(self, frame: Frame, name: str) -> Node:
        """Range over a type's population."""
        m = self.model
        if frame.roots:
            self.ctx.judge(f"{name} is not connected to {frame.roots[0].type}: a query ranges over one connected path")
            apart = Frame(self.ctx, frame.outer)
            node = self.start(apart, name)
            frame.df = frame.df.crossJoin(apart.df)
            frame.roots.append(node)
            return node
        if name in m.values:
            found = m.carriers(name)
            places = {(f.table, f.roles[i].columns, f.roles[i].path) for f, i in found}
            if len(places) != 1:
                raise QueryError(f"{name} is held in {len(places)} places: start from the type that has it")
            fact, i = found[0]
            frame.df, prefix = self.ctx.scan(fact.table)
            node = Node(name, tuple(f"{prefix}__{c}" for c in fact.roles[i].columns))
            node.home = (fact.table, fact.roles[i].columns, prefix)
            if fact.roles[i].path:
                node.cols = (frame.add(self.leaf(F.col(node.cols[0]), fact.roles[i]), "json"),)
            frame.where(F.col(node.cols[0]).isNotNull())
            self.restrict(frame, node)
        else:
            node = self.population(frame, name)
        frame.roots.append(node)
        return node

    def population(self, frame: Frame, name: str) -> Node:
        e = self.model.entities[name]
        frame.df, prefix = self.ctx.scan(e.table)
        return Node(name, tuple(f"{prefix}__{c}" for c in e.key), {e.table: prefix})

    def lazy(self, frame: Frame, outer: Node) -> Node:
        """A root that stands for an outer node; the first step scans it."""
        if not outer.cols:
            raise QueryError(f"{outer.type} has no identifying columns, so a condition on it must be read in its own row")
        node = Node(outer.type, (), outer=outer.cols)
        frame.roots.append(node)
        return node

    def row(self, frame: Frame, node: Node, table: str, columns: tuple[str, ...], optional: bool, own: bool) -> str:
        """The prefix of the row(s) of a table whose columns are the node's: in hand, or joined."""
        if own and table in node.rows:
            return node.rows[table]
        scan, prefix = self.ctx.scan(table)
        here = tuple(f"{prefix}__{c}" for c in columns)
        if not node.cols:
            if frame.df is None:
                frame.df = scan.where(conjunction(F.col(c).isNotNull() for c in here))
                node.cols = here
            else:
                raise QueryError(f"{node.type} has no identifying columns to join by")
        else:
            on = conjunction(F.col(a) == F.col(b) for a, b in zip(node.cols, here, strict=True))
            frame.df = frame.df.join(scan, on, "left" if optional else "inner")
        if own:
            node.rows[table] = prefix
        return prefix

    def leaf(self, document: Column, role: Role) -> Column:
        kind = self.model.values[role.player].datatype
        return F.get_json_object(document.cast("string"), role.path).try_cast(kind if kind != "string" else "string")

    def restrict(self, frame: Frame, node: Node) -> None:
        v = self.model.values.get(node.type)
        if not v:
            return
        c = F.col(node.cols[0])
        if v.allowed:
            frame.where(c.isin(*v.allowed))
        if v.low is not None:
            frame.where(c >= v.low)
        if v.high is not None:
            frame.where(c <= v.high)

    def walk(self, frame: Frame, node: Node, verb: str, target: str | None, optional: bool) -> Node:
        """One step along a fact: at most one join, none if the fact is in a row in hand."""
        fact, i, j = self.resolve(verb, node.type, target)
        src, dst = fact.roles[i], fact.roles[j]
        m = self.model
        if src.references and node.cols:
            entity = m.entities[src.player]
            home = self.row(frame, node, entity.table, entity.key, optional, True)
            at = Node(node.type, tuple(f"{home}__{c}" for c in src.references))
            prefix = self.row(frame, at, fact.table, src.columns, optional, False)
        else:
            home = node.home and node.home[:2] == (fact.table, src.columns)
            prefix = node.home[2] if home else self.row(frame, node, fact.table, src.columns, optional, fact.functional(i))
        cols = tuple(f"{prefix}__{c}" for c in dst.columns)
        entity = m.entities.get(dst.player)
        reached = Node(dst.player, cols, optional=optional or node.optional)
        if dst.path:
            reached.cols = (frame.add(self.leaf(F.col(cols[0]), dst), "json"),)
        if dst.references:
            scan, home = self.ctx.scan(entity.table)
            on = conjunction(F.col(a) == F.col(f"{home}__{b}") for a, b in zip(cols, dst.references, strict=True))
            frame.df = frame.df.join(scan, on, "left" if optional else "inner")
            reached.cols, reached.rows = tuple(f"{home}__{c}" for c in entity.key), {entity.table: home}
        if entity and fact.table == entity.table and (dst.columns == entity.key or entity.keyless):
            reached.rows[entity.table] = prefix
        if not optional and reached.cols and not (dst.mandatory and not node.optional):
            frame.where(conjunction(F.col(c).isNotNull() for c in reached.cols))
        if entity and not dst.enforced and entity.table not in reached.rows:
            scan, home = self.ctx.scan(entity.table)
            known = conjunction(F.col(a) == F.col(f"{home}__{b}") for a, b in zip(reached.cols, entity.key, strict=True))
            if optional:
                frame.df = frame.df.join(scan.select(*[F.col(f"{home}__{b}") for b in entity.key]), known, "left")
                reached.cols = tuple(f"{home}__{b}" for b in entity.key)
            else:
                frame.df = frame.df.join(scan, known, "left_semi")
        if not entity and not optional:
            self.restrict(frame, reached)
        frame.edges.append(Edge(node, reached, fact, i, j))
        if target and target in m.entities and target != dst.player and dst.player in m.supertypes(target)[1:]:
            self.narrow(frame, reached, target)
        return reached

    def narrow(self, frame: Frame, node: Node, subtype: str) -> None:
        e = self.model.entities[subtype]
        self.row(frame, node, e.table, e.key, node.optional, True)
        node.type = subtype

    def denote(self, frame: Frame, node: Node, given: list[Any]) -> None:
        """``Type: value``: the instance that the value identifies."""
        if len(given) == 1 and isinstance(given[0], S.Outer):
            outer = self.outer_node(frame, given[0].name)
            if not frame.df and not node.cols:
                raise QueryError(f"!{given[0].name} needs a step before it")
            frame.pairs += list(zip(node.cols, outer.cols, strict=True))
            return
        if len(given) != len(node.cols):
            raise QueryError(f"{node.type} is identified by {len(node.cols)} values, not {len(given)}")
        for col, value in zip(node.cols, given, strict=True):
            kind = self.kind(frame, F.col(col))
            if isinstance(value, S.Text) and numeric(kind):
                raise QueryError(f"{node.type} is identified by a number, not by {value.value!r}: write {node.type} [has ...: {value.value!r}]")
            frame.where(self.compare(frame, "=", F.col(col), self.expr(frame, value)))

    def outer_node(self, frame: Frame, name: str) -> Node:
        if not frame.outer:
            raise QueryError(f"!{name} has no outer query to refer to")
        found, above = None, frame.outer
        while above is not None and found is None:
            found, above = above.names.get(name), above.outer
        if isinstance(found, Node):
            return found
        if isinstance(found, Calc):
            return Node("", (found.col,))
        raise QueryError(f"the outer query binds no {name!r}")

    def bind(self, frame: Frame, node: Node, atom: S.Atom) -> Node:
        if atom.var:
            known = frame.names.get(atom.var)
            if isinstance(known, Node) and known is not node:
                if not self.model.related(known.type, node.type):
                    raise QueryError(f"{atom.var} is a {known.type} and can't be a {node.type} too")
                frame.where(conjunction(F.col(a) == F.col(b) for a, b in zip(known.cols, node.cols, strict=True)))
            else:
                if self.model.has_type(atom.var):
                    raise QueryError(f"{atom.var} is a type's name, so it can't name a variable")
                frame.names[atom.var] = node
        if atom.denoted:
            self.denote(frame, node, atom.denoted)
        return node

    def anchor(self, frame: Frame, atom: S.Atom | None) -> Node:
        """Where a path starts: the head in hand, a bound node, or a new range."""
        if atom is None:
            if frame.head is None:
                raise QueryError("the path starts with a verb, but there is no head to start from")
            return frame.head
        if atom.var and not atom.type:
            found = frame.node(atom.var)
            if not found:
                raise QueryError(f"{atom.var!r} names no instance here")
            return found
        if atom.denoted and not atom.type:
            raise QueryError("a path can't start at a plain value")
        head = frame.head
        if head and atom.type in self.model.supertypes(head.type) and not atom.denoted:
            return self.bind(frame, head, atom)
        if head and head.type in self.model.supertypes(atom.type)[1:]:
            self.narrow(frame, head, atom.type)
            return self.bind(frame, head, atom)
        role = next((r for f in self.model.facts for r in f.roles if r.name == atom.type), None)
        node = self.start(frame, role.player if role and not self.model.has_type(atom.type) else atom.type)
        if frame.head is None:
            frame.head = node
        return self.bind(frame, node, atom)

    def path(self, frame: Frame, p: S.Path) -> Node:
        node = self.anchor(frame, p.head)
        if frame.head is None:
            frame.head = node
        head = node
        frame.distinct |= p.distinct
        for step in p.steps:
            if isinstance(step, S.Bracket):
                self.restriction(frame, node, step.body)
                continue
            atom = step.atom
            target = atom.type if atom else None
            if atom and not atom.type and atom.var and (known := frame.node(atom.var)):
                target = known.type
            node = self.walk(frame, node, step.verb, target, step.optional)
            if atom:
                if atom.denoted and not atom.type and not isinstance(atom.denoted[0], S.Outer):
                    frame.where(self.compare(frame, "=", self.column(node), self.expr(frame, atom.denoted[0])))
                else:
                    self.bind(frame, node, atom)
        frame.tail = head if p.only else node
        return node

    # == restrictions: semi-joins, or filters in place =================================

    def binds(self, tree: Any) -> bool:
        if isinstance(tree, S.Path):
            return any((a := (s.atom if isinstance(s, S.Step) else None)) and a.var for s in tree.steps) or any(self.binds(s.body) for s in tree.steps if isinstance(s, S.Bracket)) or bool(tree.head and tree.head.type and tree.head.var)
        if isinstance(tree, S.Named):
            return True
        if isinstance(tree, S.Combined):
            return tree.op == "also" and (self.binds(tree.left) or self.binds(tree.right)) or self.binds(tree.left)
        if isinstance(tree, S.Where):
            return self.binds(tree.body)
        return False

    def single(self, here: str, tree: Any) -> bool:
        """Whether a restriction can match at most once, by the model: then it may be read in place."""
        if isinstance(tree, S.Combined):
            return tree.op == "also" and self.single(here, tree.left) and self.single(here, tree.right)
        if not isinstance(tree, S.Path) or tree.head is not None:
            return False
        for s in tree.steps:
            if isinstance(s, S.Bracket):
                if not self.single(here, s.body):
                    return False
                continue
            if s.optional or (s.atom and s.atom.denoted and any(isinstance(d, S.Outer) and not self.further_out(d.name) for d in s.atom.denoted)):
                return False
            fact, i, j = self.resolve(s.verb, here, s.atom.type if s.atom else None)
            if not fact.functional(i):
                return False
            here = s.atom.type if s.atom and s.atom.type in self.model.entities else fact.roles[j].player
        return True

    def further_out(self, name: str) -> bool:
        """Whether a name is bound further out than the frame whose restriction is read."""
        own = self.reading
        return own is not None and name not in own.names and own.outer is not None

    def at(self, frame: Frame, node: Node, run) -> Any:
        """Run with another head, and put the head back."""
        head, tail = frame.head, frame.tail
        frame.head = node
        try:
            return run()
        finally:
            frame.head, frame.tail = head, tail

    def restriction(self, frame: Frame, node: Node, body: Any) -> None:
        self.reading = frame
        if self.binds(body) or not self.pathlike(body):
            self.at(frame, node, lambda: self.describe(frame, body))
        elif isinstance(body, S.Combined) and body.op != "also":
            self.at(frame, node, lambda: self.describe(frame, body))
        elif self.single(node.type, body):
            self.at(frame, node, lambda: self.describe(frame, body))
        else:
            keep(frame, self.test(frame, node, body), True)

    def pathlike(self, tree: Any) -> bool:
        if isinstance(tree, S.Path):
            return True
        if isinstance(tree, S.Combined):
            return self.pathlike(tree.left)
        return isinstance(tree, S.Where) and self.pathlike(tree.body)

    def test(self, frame: Frame, node: Node | None, body: Any) -> Test:
        """The rows of a description, tied to the outer node that it continues from."""
        sub = Frame(self.ctx, frame)
        if node is not None and self.headless(body):
            sub.head = self.lazy(sub, node)
        elif (var := self.leading(body)) and (known := frame.node(var)):
            sub.head = self.lazy(sub, known)
            sub.names[var] = sub.head
        self.describe(sub, body)
        self.settle(sub)
        if node is not None and not self.headless(body) and sub.head and not sub.links() and self.model.related(sub.head.type, node.type) and not self.leading(body):
            sub.pairs += list(zip(sub.head.cols, node.cols, strict=True))
        return Test(sub.df, sub.links(), sub.theta)

    def first(self, tree: Any) -> S.Path | None:
        while not isinstance(tree, S.Path):
            if isinstance(tree, (S.Combined, S.SetOf, S.SetCompare)):
                tree = tree.left
            elif isinstance(tree, S.Where):
                tree = tree.body
            else:
                return None
        return tree

    def headless(self, tree: Any) -> bool:
        p = self.first(tree)
        return p is not None and p.head is None

    def leading(self, tree: Any) -> str | None:
        p = self.first(tree)
        return p.head.var if p and p.head and p.head.var and not p.head.type else None

    # == descriptions ==================================================================

    def describe(self, frame: Frame, tree: Any) -> None:
        if isinstance(tree, S.Path):
            self.path(frame, tree)
        elif isinstance(tree, S.Combined):
            self.combined(frame, tree)
        elif isinstance(tree, S.Where):
            self.describe(frame, tree.body)
            head, tail = frame.head, frame.tail
            for c in self.conjuncts(tree.condition):
                self.condition(frame, c)
            frame.head, frame.tail = head, tail
        elif isinstance(tree, S.SetCompare):
            p = self.first(tree.left)
            if frame.head is None and p and p.head is not None and p.steps:
                # the set stands at the end of a path that starts the query: its head is what is restricted
                self.anchor(frame, p.head)
                tree = replace(tree, left=replace(p, head=None))
            self.condition(frame, tree)
        elif isinstance(tree, S.SetOf):
            raise QueryError("a set operation stands between whole queries, not inside a path")
        elif isinstance(tree, S.Query):
            raise QueryError("a whole query can't stand here: name it with DEFINE and walk it")
        elif isinstance(tree, S.Named):
            self.named(frame, tree)
        elif isinstance(tree, S.Compare):
            self.condition(frame, tree)
        elif isinstance(tree, S.Call):
            frame.one_row()
            self.condition(frame, tree)
        elif isinstance(tree, S.Aggregate) and tree.keys:
            self.keyed(frame, tree, None)
        elif isinstance(tree, S.Name) and frame.node(tree.name):
            frame.tail = frame.node(tree.name)
        else:
            frame.one_row()
            frame.tail = Calc(frame.add(self.expr(frame, tree)))

    def combined(self, frame: Frame, tree: S.Combined) -> None:
        if tree.op == "or":
            self.either(frame, tree)
            return
        self.describe(frame, tree.left)
        head = frame.head
        if tree.op == "but not":
            keep(frame, self.test(frame, head, tree.right), False)
        elif self.pathlike(tree.right) and not self.binds(tree.right) and not self.leading(tree.right) and not (isinstance(tree.right, S.Combined) and tree.right.op == "or"):
            node = frame.head
            body = tree.right
            p = self.first(body)
            if p.head is not None and p.head.type and node and p.head.type in self.model.supertypes(node.type) and not p.head.denoted and isinstance(body, S.Path):
                body = replace(body, head=None)
            if self.headless(body) and node:
                self.restriction(frame, node, body)
            else:
                self.describe(frame, body)
        else:
            self.describe(frame, tree.right)
        frame.head = head
        frame.tail = head if head is not None else frame.tail

    def either(self, frame: Frame, tree: S.Combined) -> None:
        """A disjunction of existence tests over the head; the leftmost operand is one of them."""
        parts: list[Any] = []

        def flatten(t):
            if isinstance(t, S.Combined) and t.op == "or":
                flatten(t.left)
                parts.append(t.right)
            else:
                parts.append(t)

        flatten(tree)
        first = self.first(parts[0])
        if frame.head is None:
            if not first or first.head is None:
                raise QueryError("OR OTHERWISE needs a head to test")
            self.anchor(frame, first.head)
        if any(self.binds(replace(p, head=None) if isinstance(p, S.Path) else p) for p in parts):
            raise QueryError("a name that is bound in one alternative of OR OTHERWISE has no value in the others: bind it before, with AND ALSO in front of a parenthesis")
        head = frame.head
        flags = []
        for i, p in enumerate(parts):
            body = self.headed_off(p) if i == 0 else p
            if isinstance(body, S.Path) and not body.steps:
                continue
            flags.append(flag(frame, self.test(frame, head, body)))
        any_flag = None
        for f in flags:
            any_flag = f if any_flag is None else any_flag | f
        if any_flag is not None:
            frame.where(any_flag)
        frame.head = frame.tail = head

    def headed_off(self, tree: Any) -> Any:
        if isinstance(tree, S.Path):
            return replace(tree, head=None)
        if isinstance(tree, S.Combined):
            return replace(tree, left=self.headed_off(tree.left))
        if isinstance(tree, S.Where):
            return replace(tree, body=self.headed_off(tree.body))
        return tree

    def named(self, frame: Frame, tree: S.Named) -> None:
        value = tree.value
        if isinstance(value, S.Aggregate) and (value.keys or (value.body is None and frame.roots)):
            self.keyed(frame, value, tree.name)
            return
        if isinstance(value, S.Path):
            node = self.path(frame, value)
            frame.names[tree.name] = node
            return
        if self.waits(frame, value):
            frame.names[tree.name] = self.later(frame, "expression", value)
            return
        frame.one_row()
        calc = Calc(frame.add(self.expr(frame, value)), self.reads(frame, value))
        frame.names[tree.name] = calc
        if frame.tail is None:
            frame.tail = calc

    def later(self, frame: Frame, kind: str, tree: Any, **more) -> Pending:
        p = Pending(kind, tree, col=self.ctx.fresh("late"), **more)
        frame.pending.append(p)
        return p

    # == conditions ====================================================================

    def conjuncts(self, c: Any) -> list[Any]:
        if isinstance(c, S.Logic) and c.op == "and":
            return [x for a in c.args for x in self.conjuncts(a)]
        return [c]

    def waits(self, frame: Frame, tree: Any) -> bool:
        """Whether a tree reads a value that is computed once all rows are known."""
        if isinstance(tree, S.Name):
            return isinstance(frame.names.get(tree.name), Pending)
        if isinstance(tree, S.Aggregate):
            return bool(tree.keys) or (tree.body is None and bool(frame.roots))
        return any(self.waits(frame, c) for c in children(tree))

    def reads(self, frame: Frame, tree: Any) -> tuple[Node, ...]:
        if isinstance(tree, S.Name):
            found = frame.names.get(tree.name)
            return (found,) if isinstance(found, Node) else found.reads if isinstance(found, Calc) else found.nodes if isinstance(found, Pending) else ()
        if isinstance(tree, S.Aggregate):
            return ()
        return tuple(n for c in children(tree) for n in self.reads(frame, c))

    def condition(self, frame: Frame, c: Any) -> None:
        """Keep the rows for which a condition holds."""
        if self.waits(frame, c):
            frame.late.append(c)
            return
        negated = False
        inner = c
        while isinstance(inner, S.Logic) and inner.op == "not":
            negated, inner = not negated, inner.args[0]
        if isinstance(inner, (S.Path, S.Some)) or (isinstance(inner, (S.Combined, S.Where)) and self.pathlike(inner)):
            keep(frame, self.exists(frame, inner), not negated)
        elif isinstance(inner, S.SetCompare):
            for test, wanted in self.sets(frame, inner, negated):
                keep(frame, test, wanted)
        elif has_outer(c) and isinstance(c, S.Compare):
            frame.theta.append(self.truth(frame, c))
        else:
            frame.where(self.truth(frame, c))

    def exists(self, frame: Frame, c: Any) -> Test:
        if isinstance(c, S.Some):
            return self.test(frame, None, c.body)
        return self.test(frame, frame.head, c)

    def truth(self, frame: Frame, c: Any) -> Column:
        """A condition as a boolean column; the tests in it become flags."""
        if isinstance(c, S.Logic):
            args = [self.truth(frame, a) for a in c.args]
            if c.op == "not":
                return ~args[0]
            a, b = args
            return {"and": a & b, "or": a | b, "xor": a != b, "implies": ~a | b, "iff": a == b}[c.op]
        if isinstance(c, S.Compare):
            return self.compare(frame, c.op, self.expr(frame, c.left), self.expr(frame, c.right))
        if isinstance(c, (S.Path, S.Some)) or (isinstance(c, (S.Combined, S.Where)) and self.pathlike(c)):
            return flag(frame, self.exists(frame, c))
        if isinstance(c, S.SetCompare):
            out = None
            for test, wanted in self.sets(frame, c, False):
                one = flag(frame, test) if wanted else ~flag(frame, test)
                out = one if out is None else out & one
            return out
        return self.expr(frame, c)

    def kind(self, frame: Frame, c: Column) -> T.DataType:
        over = frame.df
        if frame.outer is not None and frame.outer.df is not None:
            names = set(over.columns)
            if missing := [x for x in re.findall(r"\w+", str(c)) if x in frame.outer.df.columns and x not in names]:
                return frame.outer.df.select(c.alias("x")).schema[0].dataType if len(missing) else T.NullType()
        return over.select(c.alias("x")).schema[0].dataType

    def compare(self, frame: Frame, op: str, a: Column, b: Column) -> Column:
        ka, kb = self.kind(frame, a), self.kind(frame, b)
        if isinstance(ka, T.StringType) and numeric(kb):
            a = number(a)
        elif isinstance(kb, T.StringType) and numeric(ka):
            b = number(b)
        elif isinstance(ka, T.StringType) and isinstance(kb, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            a = a.try_cast(kb)
        elif isinstance(kb, T.StringType) and isinstance(ka, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            b = b.try_cast(ka)
        return COMPARE[op](a, b)

    # == set comparisons ===============================================================

    def bag(self, frame: Frame, tree: Any) -> tuple[DataFrame, list[str], list[tuple[str, str]]]:
        """A description's values, with the pairs that tie them to the outer row."""
        if isinstance(tree, S.Query):
            df, labels, sub = self.query(tree, Frame(self.ctx, frame))
            if len(labels) != 1:
                raise QueryError(f"a set comparison needs one listed value, not {len(labels)}")
            name = self.ctx.fresh("v")
            return df.select(F.col(f"`{labels[0]}`").alias(name)), [name], []
        sub = Frame(self.ctx, frame)
        if self.headless(tree):
            if frame.head is None:
                raise QueryError("the set has no head to continue from")
            sub.head = self.lazy(sub, frame.head)
        elif (var := self.leading(tree)) and (known := frame.node(var)):
            sub.head = self.lazy(sub, known)
            sub.names[var] = sub.head
        self.describe(sub, tree)
        self.settle(sub)
        if sub.theta:
            raise QueryError("a set of a set comparison is tied to the outer row by equality only")
        cols = [sub.tail.col] if isinstance(sub.tail, Calc) else list(sub.tail.cols)
        return sub.df, cols, sub.links()

    def sets(self, frame: Frame, c: S.SetCompare, negated: bool) -> list[tuple[Test, bool]]:
        """A set comparison as tests that must or must not find rows.

        The outer columns that either side refers to are carried through ordinary
        joins, so no subquery reaches over more than one level.
        """
        left, lcols, lpairs = self.bag(frame, c.left)
        right, rcols, rpairs = self.bag(frame, c.right)
        if len(lcols) != len(rcols):
            raise QueryError("the two sets differ in the number of columns")
        carried = list(dict.fromkeys(b for _, b in [*lpairs, *rpairs]))
        names = {b: self.ctx.fresh("k") for b in carried}

        def keys() -> DataFrame:
            return frame.df.select(*[F.col(b).alias(names[b]) for b in carried]).distinct()

        def tied(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
            if {b for _, b in pairs} == set(carried) and len(pairs) == len(carried):
                return df.select("*", *[F.col(a).alias(names[b]) for a, b in pairs])
            return df.join(keys(), conjunction(F.col(a) == F.col(names[b]) for a, b in pairs))

        def members(df: DataFrame, cols: list[str], pairs) -> DataFrame:
            return df.select(*dict.fromkeys([*cols, *[x for x, _ in pairs]])).distinct()

        def equal(acols: list[str], bcols: list[str]) -> list[Column]:
            return [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(acols, bcols, strict=True)]

        def lacking(a: DataFrame, acols: list[str], b: DataFrame, bcols: list[str], bpairs) -> Test:
            """Outer keys whose set b lacks a member of a, which is one set for all of them.

            Members are matched by value and counted for each key, so no key meets a member that it lacks.
            """
            wanted = members(a, acols, [])
            size, met = self.ctx.fresh("size"), self.ctx.fresh("met")
            matched = members(b, bcols, bpairs).join(wanted, conjunction(equal(acols, bcols)), "left_semi")
            own = [F.col(x).alias(f"{met}_{i}") for i, (x, _) in enumerate(bpairs)]
            counts = matched.groupBy(*own).agg(F.count(F.lit(1)).alias(met))
            on = conjunction(F.col(f"{met}_{i}") == F.col(names[y]) for i, (_, y) in enumerate(bpairs))
            full = keys().join(counts, on, "left").crossJoin(F.broadcast(wanted.agg(F.count(F.lit(1)).alias(size))))
            return Test(full.where(F.coalesce(F.col(met), F.lit(0)) < F.col(size)), [(names[k], k) for k in carried])

        def apart(a: DataFrame, acols: list[str], apairs, b: DataFrame, bcols: list[str], bpairs, how: str) -> Test:
            if carried and not apairs and how == "left_anti":
                return lacking(a, acols, b, bcols, bpairs)
            if carried and not apairs:
                a, acols, apairs, b, bcols, bpairs = b, bcols, bpairs, a, acols, apairs
            wide = tied(a, apairs)
            on = equal(acols, bcols) + [F.col(x) == F.col(names[y]) for x, y in bpairs]
            return Test(wide.join(members(b, bcols, bpairs), conjunction(on), how), [(names[k], k) for k in carried])

        over = lambda: apart(left, lcols, lpairs, right, rcols, rpairs, "left_anti")  # noqa: E731  in left only
        under = lambda: apart(right, rcols, rpairs, left, lcols, lpairs, "left_anti")  # noqa: E731  in right only
        negated ^= c.negated
        op = c.op
        if op == "disjoint":
            return [(apart(left, lcols, lpairs, right, rcols, rpairs, "left_semi"), negated)]
        if op == "subset":
            return [(over(), negated)]
        if op == "superset":
            return [(under(), negated)]
        if not negated:
            return [(over(), op == "proper superset"), (under(), op == "proper subset")]
        if op == "equal":
            a, b = over(), under()
            if [x for _, x in a.pairs] != [x for _, x in b.pairs]:
                raise QueryError("the two sets are tied to different rows")
            both = a.df.select(*[F.col(x) for x, _ in a.pairs]).union(b.df.select(*[F.col(x) for x, _ in b.pairs])) if a.pairs else a.df.select(F.lit(1)).union(b.df.select(F.lit(1)))
            return [(Test(both, a.pairs), True)]
        raise QueryError("write a negated proper comparison as its parts")

    # == expressions ===================================================================

    def column(self, node: Node) -> Column:
        if len(node.cols) != 1:
            raise QueryError(f"{node.type} is identified by {len(node.cols)} columns, so it is no single value")
        return F.col(node.cols[0])

    def expr(self, frame: Frame, e: Any) -> Column:
        if isinstance(e, S.Number):
            return F.lit(e.value)
        if isinstance(e, S.Text):
            return F.lit(e.value)
        if isinstance(e, S.Name):
            found = frame.lookup(e.name)
            if isinstance(found, Node):
                return self.column(found)
            if isinstance(found, Pending) and found.col not in frame.df.columns:
                raise QueryError(f"{e.name!r} is an aggregate and not known yet here")
            return F.col(found.col)
        if isinstance(e, S.Outer):
            return self.column(self.outer_node(frame, e.name))
        if isinstance(e, S.Negative):
            return -self.expr(frame, e.value)
        if isinstance(e, S.Binary):
            a, b = self.numbers(frame, self.expr(frame, e.left), self.expr(frame, e.right))
            if e.op == "/":
                return F.try_divide(a.cast("double"), b.cast("double"))
            if e.op == "^":
                return F.pow(a, b)
            return {"+": a + b, "-": a - b, "*": a * b}[e.op]
        if isinstance(e, S.Choice):
            return F.when(self.truth(frame, e.condition), self.expr(frame, e.then)).otherwise(self.expr(frame, e.other))
        if isinstance(e, S.Call):
            return self.call(frame, e)
        if isinstance(e, S.Named):
            return self.expr(frame, e.value)
        if isinstance(e, S.Aggregate):
            for p in frame.pending:
                if p.tree == e and p.col in (frame.df.columns if frame.df is not None else ()):
                    return F.col(p.col)
            return self.scalar(frame, e)
        if isinstance(e, S.Path):
            if frame.head is None and e.head is None:
                raise QueryError("the path has no head to start from")
            head, tail = frame.head, frame.tail
            node = self.path(frame, e)
            frame.head, frame.tail = head, tail
            return self.column(node)
        if isinstance(e, (S.Compare, S.Logic, S.SetCompare, S.Some)):
            return self.truth(frame, e)
        raise QueryError("this can't stand where a value is wanted")

    def numbers(self, frame: Frame, a: Column, b: Column) -> tuple[Column, Column]:
        fix = lambda c: number(c) if isinstance(self.kind(frame, c), T.StringType) else c
        return fix(a), fix(b)

    def call(self, frame: Frame, e: S.Call) -> Column:
        f = FUNCTIONS.get(e.function.lower())
        if f is None:
            raise QueryError(f"there is no function {e.function}; there are {', '.join(sorted(FUNCTIONS))}")
        args = [self.expr(frame, a) for a in e.args]
        if e.function.lower() == "jsonobject":
            if any(not isinstance(k, S.Text) for k in e.args[::2]):
                raise QueryError("jsonObject's keys are texts")
            for column, tree in zip(args[::2], e.args[::2], strict=True):
                column._factweave_text = tree.value
        if e.function.lower() == "round" and len(e.args) == 2 and isinstance(e.args[1], S.Number):
            return F.round(args[0].cast("double"), int(e.args[1].value))
        try:
            return f(*args)
        except TypeError as why:
            raise QueryError(f"{e.function} does not take {len(args)} arguments") from why

    # == aggregates ====================================================================

    def fold(self, frame: Frame, a: S.Aggregate, value: Column | None, distinct: bool) -> Column:
        """An aggregate function over a column; value None counts rows."""
        f = a.function
        if f == "count":
            if value is None:
                return F.count(F.lit(1))
            return F.count_distinct(value) if distinct else F.count(value)
        kind = self.kind(frame, value)
        if f in ("sum", "avg", "median", "stddev", "variance") and isinstance(kind, T.StringType):
            value = number(value)
        if f == "sum":
            return F.sum_distinct(value) if distinct else F.sum(value)
        if f == "list":
            if a.separator is not None:
                value = value.cast("string")
                gathered = F.array_sort(F.collect_set(value) if distinct else F.collect_list(value))
                return F.when(F.size(gathered) > 0, F.array_join(gathered, a.separator))
            if a.order:
                return self.ordered(frame, a, value)
            gathered = F.array_sort(F.collect_set(value) if distinct else F.collect_list(value))
            return F.slice(gathered, a.cut.after + 1, a.cut.first) if a.cut else gathered
        if f == "object":
            pairs = F.array_sort(F.collect_list(F.struct(self.expr(frame, a.by).cast("string").alias("key"), value.alias("value"))))
            keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
            return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])))
        if f in OWN:
            return OWN[f](value)
        return {"avg": F.avg, "min": F.min, "max": F.max, "median": F.median, "stddev": F.stddev_samp, "variance": F.var_samp}[f](value)

    def ordered(self, frame: Frame, a: S.Aggregate, value: Column) -> Column:
        """A list in the order of its keys; ties by the value itself."""
        keys = [self.expr(frame, k.value) for k in a.order]
        fields = [k.alias(f"k{i}") for i, k in enumerate(keys)]
        items = F.collect_list(F.struct(*fields, value.alias("v")))

        def compare(x: Column, y: Column) -> Column:
            out = F.when(x["v"] < y["v"], -1).when(x["v"] > y["v"], 1).otherwise(0)
            for i in reversed(range(len(keys))):
                n = f"k{i}"
                less = -1 if not a.order[i].descending else 1
                out = F.when(x[n].isNull() & y[n].isNotNull(), less).when(x[n].isNotNull() & y[n].isNull(), -less).when(x[n] < y[n], less).when(x[n] > y[n], -less).otherwise(out)
            return out

        done = F.transform(F.array_sort(items, compare), lambda x: x["v"])
        return F.slice(done, a.cut.after + 1, a.cut.first) if a.cut else done

    def operand(self, frame: Frame, a: S.Aggregate) -> tuple[Column | None, tuple[Node, ...]]:
        """What an aggregate folds, and the nodes that it reads."""
        tree = a.arg
        if tree is None or isinstance(tree, S.Name):
            found = frame.tail if tree is None else frame.lookup(tree.name)
            if isinstance(found, Node):
                if a.function == "count" and len(found.cols) != 1:
                    if a.distinct:
                        raise QueryError(f"{found.type} is identified by several columns: a distinct count of it has no single column")
                    return None, (found,)
                return self.column(found), (found,)
            return F.col(found.col), (found.reads if isinstance(found, Calc) else found.nodes)
        return self.expr(frame, tree), self.reads(frame, tree)

    def scalar(self, frame: Frame, a: S.Aggregate) -> Column:
        """An aggregate over a bag of its own: one value, or one for each outer row that it refers to."""
        if a.body is None:
            raise QueryError("the aggregate reads the query's own rows and is not known yet here")
        if (known := frame.folded.get(repr(a))) and frame.df is not None and known in frame.df.columns:
            return F.col(known)
        if isinstance(a.body, S.Query):
            df, labels, sub = self.query(a.body, Frame(self.ctx, frame))
            sub = Frame(self.ctx, frame)
            sub.df = df.select(*[F.col(f"`{c}`").alias(self.ctx.fresh("q")) for c in labels])
            sub.names = {label: Calc(c) for label, c in zip(labels, sub.df.columns, strict=True)}
            sub.tail = Calc(sub.df.columns[0])
        else:
            sub = Frame(self.ctx, frame)
            if self.headless(a.body):
                if frame.head is None:
                    raise QueryError("the aggregate's path has no head to continue from")
                sub.head = self.lazy(sub, frame.head)
            self.describe(sub, a.body)
            self.settle(sub)
        value, nodes = self.operand(sub, a)
        pairs = sub.links()
        if any(b not in frame.df.columns for _, b in pairs if frame.df is not None):
            raise QueryError("an aggregate refers to a name two levels out: bind it in between")
        if sub.theta:
            raise QueryError("an aggregate is tied to the outer row by equality only")
        distinct = a.distinct or (sub.distinct and a.function in ("count", "sum", "list"))
        if sub.distinct and a.function not in ("count", "sum", "list", "min", "max") and value is not None:
            name = sub.add(value, "d")
            sub.df = sub.df.select(*[c for c, _ in pairs], name).distinct()
            value = F.col(name)
        elif a.function not in EXEMPT and not distinct and a.function != "count" and not sub.grouped:
            self.once(sub, value, nodes, [c for c, _ in pairs], a)
            value = F.col(sub.value_col) if sub.value_col else value
        out = self.ctx.fresh("agg")
        folded = self.fold(sub, a, value, distinct).alias(out)
        frame.one_row()
        if not pairs:
            mates = [] if sub.distinct or getattr(sub, "value_col", None) else self.mates(frame, sub, a)
            frame.folded |= {repr(m): name for m, name, _ in mates} | {repr(a): out}
            frame.df = frame.df.crossJoin(F.broadcast(sub.df.agg(folded, *[c for _, _, c in mates])))
            return F.col(out)
        keys = {c: self.ctx.fresh("g") for c, _ in pairs}
        found = sub.df.groupBy(*[F.col(c).alias(keys[c]) for c in keys]).agg(folded)
        frame.df = frame.df.join(found, conjunction(F.col(keys[c]) == F.col(b) for c, b in pairs), "left")
        return self.absent(frame, a, F.col(out))

    def mates(self, frame: Frame, sub: Frame, a: S.Aggregate) -> list[tuple[S.Aggregate, str, Column]]:
        """Other aggregates that the query lists over the same bag, as it is: one scan folds them all."""
        out = []
        for m in frame.listed:
            if repr(m.body) != repr(a.body) or repr(m) == repr(a) or repr(m) in frame.folded or any(repr(m) == repr(x) for x, _, _ in out):
                continue
            value, nodes = self.operand(sub, m)
            if m.function in (*EXEMPT, "count") or m.distinct or sub.grouped or determine.repeated(sub, nodes) is None:
                name = self.ctx.fresh("agg")
                out.append((m, name, self.fold(sub, m, value, m.distinct).alias(name)))
        return out

    def absent(self, frame: Frame, a: S.Aggregate, c: Column) -> Column:
        """A count of nothing is 0, a list of nothing is empty."""
        if a.function == "count":
            return F.coalesce(c, F.lit(0))
        if a.function == "list" and a.separator is None:
            return F.coalesce(c, F.array().cast(self.kind(frame, c)))
        return c

    def once(self, sub: Frame, value: Column, nodes: tuple[Node, ...], keys: list[str], a: S.Aggregate) -> None:
        """Make a bag's rows distinct by what owns the value, where the path repeats it."""
        sub.value_col = None
        det = determine.repeated(sub, nodes)
        if det is None:
            return
        self.identified(det)
        sub.value_col = sub.add(value, "v")
        more = [c for k in a.order for n in self.reads(sub, k.value) for c in n.cols]
        more += [c for n in self.reads(sub, a.by) for c in n.cols] if a.by is not None else []
        sub.df = self.dealt(sub.df.select(*dict.fromkeys([*keys, *[c for n in det for c in n.cols], *more, sub.value_col])), det).distinct()

    def dealt(self, rows: DataFrame, owners: list[Node]) -> DataFrame:
        """Rows by an owner, to more tasks than the session's number, where the bytes read ask for it and owners are many."""
        wanted = -(-read_bytes(rows) // TASK_BYTES)
        if wanted <= int(self.ctx.spark.conf.get("spark.sql.shuffle.partitions")) or rows.isStreaming:
            return rows
        for n in owners:
            e = self.model.entities.get(n.type)
            if e and e.table not in self.ctx.derived and read_bytes(self.ctx.source(e.table)) >= wanted * OWNER_BYTES:
                return rows.repartition(wanted, *n.cols)
        return rows

    def identified(self, det: list[Node]) -> None:
        for n in det:
            if not n.cols:
                raise QueryError(f"{n.type} has no identifying columns, so a value can't be counted once for each")

    def keyed(self, frame: Frame, a: S.Aggregate, name: str | None) -> Pending:
        """An aggregate beside the query's own rows: grouped, windowed, or over all of them."""
        if a.body is not None:
            p = self.first(a.body)
            if p is None or (p.head and p.head.type and not (frame.head and p.head.type in self.model.supertypes(frame.head.type))):
                other = next((n for n in frame.all_nodes() if p and p.head and n.type == p.head.type), None)
                if frame.head is not None and other is None:
                    raise QueryError(f"{p.head.type if p and p.head else 'the aggregate'} is not on the query's path, so its groups have nothing to do with it")
                if other is not None:
                    self.at(frame, other, lambda: self.keyed_path(frame, a))
                else:
                    self.keyed_path(frame, a)
            else:
                head = frame.head
                self.keyed_path(frame, a)
                frame.head = head or frame.head
        kind = "window" if a.within else "group" if a.keys else "whole"
        pending = self.later(frame, kind, a, keys=a.keys or [])
        if a.body is not None and a.arg is None:
            pending.extra["tail"] = frame.agg_tail
        if name:
            frame.names[name] = pending
        return pending

    def keyed_path(self, frame: Frame, a: S.Aggregate) -> None:
        tail = frame.tail
        self.describe(frame, a.body)
        frame.agg_tail = frame.tail
        if tail is not None:
            frame.tail = tail

    # == rows are known: groups, windows, late conditions ===================================

    def settle(self, frame: Frame) -> None:
        frame.one_row()
        for p in [p for p in frame.pending if p.kind == "whole"]:
            self.whole(frame, p)
        groups = [p for p in frame.pending if p.kind == "group"]
        if groups:
            rowwise = [p for p in frame.pending if p.kind == "window" and not self.over_groups(frame, p, groups)]
            if rowwise:
                raise QueryError("a window over rows can't stand beside GROUPED BY: rank a grouped value, or DEFINE the groups first")
            self.group(frame, groups)
        waiting = [p for p in frame.pending if p.kind in ("window", "expression")]
        late = list(frame.late)
        frame.late = []
        done = {p.col for p in frame.pending} - {p.col for p in waiting}
        known = lambda tree: all(q.col in done for q in self.uses(frame, tree))
        for c in [c for c in late if known(c)]:
            self.apply(frame, c)
            late.remove(c)
        while waiting:
            ready = [p for p in waiting if known_inner(self, frame, p, done)]
            if not ready:
                raise QueryError("values refer to each other in a circle")
            for p in ready:
                if p.kind == "window":
                    self.window(frame, p)
                else:
                    frame.df = frame.df.withColumn(p.col, self.expr(frame, p.tree))
                done.add(p.col)
                waiting.remove(p)
        for c in late:
            self.apply(frame, c)
        frame.pending = [p for p in frame.pending if p.kind == "kept"]

    def apply(self, frame: Frame, c: Any) -> None:
        frame.where(self.truth(frame, c))

    def uses(self, frame: Frame, tree: Any) -> list[Pending]:
        if isinstance(tree, S.Name):
            found = frame.names.get(tree.name)
            return [found] if isinstance(found, Pending) else []
        if isinstance(tree, S.Aggregate):
            same = [p for p in frame.pending if p.tree == tree]
            if same:
                return same
            return [] if tree.body is not None and not tree.keys else [p for c in children(tree) for p in self.uses(frame, c)]
        return [p for c in children(tree) for p in self.uses(frame, c)]

    def over_groups(self, frame: Frame, p: Pending, groups: list[Pending]) -> bool:
        return any(q in groups or q.kind in ("expression", "window") for q in self.uses(frame, p.tree.arg))

    def whole(self, frame: Frame, p: Pending) -> None:
        a = p.tree
        value, nodes = self.pending_operand(frame, p)
        sub = Frame(self.ctx, frame.outer)
        sub.df, sub.edges, sub.roots, sub.names = frame.df, frame.edges, frame.roots, frame.names
        if a.function not in EXEMPT and not a.distinct and a.function != "count":
            self.once(sub, value, nodes, [], a)
            value = F.col(sub.value_col) if sub.value_col else value
        frame.df = frame.df.crossJoin(F.broadcast(sub.df.agg(self.fold(sub, a, value, a.distinct).alias(p.col))))
        p.nodes = ()

    def pending_operand(self, frame: Frame, p: Pending) -> tuple[Column | None, tuple[Node, ...]]:
        if "tail" in p.extra:
            tail = frame.tail
            frame.tail = p.extra["tail"]
            try:
                return self.operand(frame, p.tree)
            finally:
                frame.tail = tail
        return self.operand(frame, p.tree)

    def keys_of(self, frame: Frame, keys: list[Any]) -> tuple[list[str], list[Node]]:
        cols: list[str] = []
        nodes: list[Node] = []
        for k in keys:
            found = frame.names.get(k.name) if isinstance(k, S.Name) else None
            if isinstance(k, S.Name) and k.name.lower() == "one" and found is None or isinstance(k, S.Number):
                continue
            if isinstance(found, Node):
                if not found.cols:
                    raise QueryError(f"{found.type} has no identifying columns to group by")
                cols += found.cols
                nodes.append(found)
            elif isinstance(found, (Calc, Pending)):
                cols.append(found.col)
            else:
                memo = frame.__dict__.setdefault("computed", {})
                if repr(k) not in memo:
                    memo[repr(k)] = frame.add(self.expr(frame, k), "key")
                cols.append(memo[repr(k)])
        return list(dict.fromkeys(cols)), nodes

    def group(self, frame: Frame, groups: list[Pending]) -> None:
        """One row for each group; values that the path repeats count once for their owner."""
        keys, nodes = self.keys_of(frame, groups[0].keys)
        for p in groups[1:]:
            if self.keys_of(frame, p.keys)[0] != keys:
                raise QueryError("GROUPED BY with different keys in one query: DEFINE one of the groupings first")
        plain, apart = [], []
        for p in groups:
            a = p.tree
            value, read = self.pending_operand(frame, p)
            if a.function in EXEMPT or a.distinct:
                plain.append(self.fold(frame, a, value, a.distinct).alias(p.col))
                continue
            if a.function == "count":
                self.refuse_multiplied(frame, read, nodes, "a grouped count")
                plain.append(self.fold(frame, a, value, False).alias(p.col))
                continue
            det = determine.repeated(frame, read, nodes)
            if a.function in ("sum", "avg", "median") and determine.constant(frame, read, nodes):
                plain.append(F.min(value).alias(p.col))
            elif det is not None and not determine.constant(frame, read, nodes):
                self.identified(det)
                name = frame.add(value, "v")
                by = [c for n in (self.reads(frame, a.by) if a.by is not None else ()) for c in n.cols]
                apart.append((p, det, [*[c for n in det for c in n.cols], *by, name], self.fold(frame, a, F.col(name), False).alias(p.col)))
            else:
                plain.append(self.fold(frame, a, value, False).alias(p.col))
        fixed = determine.closure(frame, nodes)
        carried: dict[str, None] = {}
        for name, found in frame.names.items():
            if isinstance(found, Pending):
                continue
            cols = found.cols if isinstance(found, Node) else (found.col,)
            own = found in fixed if isinstance(found, Node) else found.col in keys or (bool(found.reads) and all(r in fixed for r in found.reads))
            if set(cols) <= set(keys):
                continue
            if own:
                carried |= dict.fromkeys(cols)
            else:
                frame.lost[name] = f"{name} has many values in a group: group by it too, or aggregate it"
        for c in [c for r in frame.roots if r.outer for c in r.cols] + [a for a, _ in frame.pairs]:
            if c not in keys:
                keys = [*keys, c]
        base = frame.df
        # what the keys fix is grouped by too: it splits no group, and hash aggregation can hold it
        wide = [*keys, *[c for c in carried if c not in keys]]
        if apart and not plain:
            # the rows of a distinct aggregate hold every group, so they stand for the groups
            p, det, det_cols, folded = apart.pop(0)
            frame.df = self.dealt(base.select(*dict.fromkeys([*wide, *det_cols])), det).distinct().groupBy(*wide).agg(folded)
        else:
            frame.df = base.groupBy(*wide).agg(*(plain or [F.count(F.lit(1)).alias(self.ctx.fresh("n"))]))
        for p, det, det_cols, folded in apart:
            renamed = {k: self.ctx.fresh("g") for k in keys}
            rows = self.dealt(base.select(*dict.fromkeys([*keys, *det_cols])), det).distinct()
            found = rows.groupBy(*[F.col(k).alias(renamed[k]) for k in keys]).agg(folded)
            on = conjunction(F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys)
            frame.df = frame.df.join(found, on, "left") if on is not None else frame.df.crossJoin(F.broadcast(found))
        frame.grouped = True
        frame.key_nodes = tuple(nodes)
        frame.head = nodes[0] if nodes and frame.head not in fixed else frame.head

    def refuse_multiplied(self, frame: Frame, read: tuple[Node, ...], nodes: list[Node], what: str) -> None:
        bad = determine.multiplied(frame, read, nodes)
        if bad:
            e = bad[0]
            self.ctx.judge(f"{what} would count a {read[0].type} again for each {e.dst.type} that the path reaches: put that step in a bracket, [{next((v for v, i, j in e.fact.readings if (i, j) == (e.i, e.j)), "...")} {e.dst.type}], so that it only filters")

    def window(self, frame: Frame, p: Pending) -> None:
        a = p.tree
        if any(q.kind == "window" for q in self.uses(frame, a.arg)):
            raise QueryError("a window over a window: DEFINE the inner one first")
        keys, nodes = self.keys_of(frame, a.keys)
        value, read = self.pending_operand(frame, p)
        by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        if a.function in ("rank", "percent_rank"):
            order = by.orderBy(value.asc_nulls_first() if a.ascending else value.desc_nulls_last())
            out = (F.rank() if a.function == "rank" else F.percent_rank()).over(order)
        elif a.function == "previous":
            out = F.lag(value).over(by.orderBy(self.expr(frame, a.by).asc_nulls_first()))
        else:
            if not frame.grouped and a.function not in EXEMPT and not a.distinct:
                self.refuse_multiplied(frame, read, nodes, "a value WITHIN a partition")
            if not keys:
                # one partition: one aggregate beside all rows, instead of all rows in one task
                frame.df = frame.df.crossJoin(F.broadcast(frame.df.agg(self.fold(frame, a, value, a.distinct).alias(p.col))))
                return
            if a.distinct and a.function == "count":
                out = F.size(F.collect_set(value).over(by)).cast("long")
            else:
                out = self.fold(frame, replace(a, order=[], cut=None), value, a.distinct).over(by) if a.function != "list" else F.array_sort(F.collect_list(value).over(by))
        frame.df = frame.df.withColumn(p.col, out)

    # == queries =======================================================================

    def script(self, text: str) -> DataFrame:
        rest = text
        while True:
            parser = Parser(self.model, rest)
            parsed = parser.script()
            if parsed.query is not None:
                return self.query(parsed.query, Frame(self.ctx))[0]
            name, source = parsed.definitions[0]
            self.define(name, source)
            end = rest.index(source, rest.index("::=")) + len(source)
            rest = rest[end:]

    def query(self, q: S.Query, frame: Frame) -> tuple[DataFrame, list[str], Frame]:
        if isinstance(q.body, S.SetOf) and not q.items:
            return self.set_query(q, frame)
        if q.items and isinstance(q.body, S.SetOf):
            raise QueryError("LIST over a set operation: list in each operand")
        if isinstance(q.body, S.Query) and not q.items:
            df, labels, inner = self.query(q.body, frame)
            return self.arranged(df, labels, q), labels, inner
        if q.body is None:
            frame.one_row()
        else:
            self.describe(frame, q.body)
        for item in [*(q.items or []), *[S.Item(k.value, "") for k in q.order]]:
            self.announce(frame, item.value)
            frame.listed += [x for x in bags(item.value) if not x.keys]
        extra = [self.element(frame, e) for e in q.elements]
        self.settle(frame)
        columns = self.projection(frame, q.items) + extra
        labels = [label for label, _ in columns]
        wanted = [c.alias(f"out{i}") for i, (_, c) in enumerate(columns)]
        listed = {label: F.col(f"out{i}") for i, label in enumerate(labels)}
        sort = [self.sort_key(frame, k, listed) for k in q.order]
        if frame.distinct:
            if any(c is None for _, c, _ in sort):
                raise QueryError("with DISTINCT, sort by what is listed: an unlisted value is not one for each row")
            df = frame.df.select(*wanted).distinct()
            sort = [(k, c, None) for k, c, _ in sort]
        else:
            df = frame.df.select(*wanted, *[c.alias(f"key{i}") for i, (_, _, c) in enumerate(sort) if c is not None])
        order = [(F.col(f"key{i}") if c is None or full is not None and f"key{i}" in df.columns else c, k.descending) for i, (k, c, full) in enumerate(sort)]
        per = None
        if q.cut and q.cut.per:
            if q.cut.per not in listed:
                found = frame.lookup(q.cut.per)
                cols = found.cols if isinstance(found, Node) else (found.col,)
                df = frame.df.select(*wanted, *[F.col(c).alias(f"per{i}") for i, c in enumerate(cols)], *[c.alias(f"key{i}") for i, (_, _, c) in enumerate(sort) if c is not None])
                per = [F.col(f"per{i}") for i in range(len(cols))]
            else:
                per = [listed[q.cut.per]]
        df = cut_rows(df, order, q.cut, per)
        return df.select(*[F.col(f"out{i}").alias(label) for i, label in enumerate(labels)]), labels, frame

    def announce(self, frame: Frame, tree: Any) -> None:
        """Make the aggregates in a listed expression wait for the rows."""
        if isinstance(tree, S.Aggregate):
            if (tree.keys or (tree.body is None and frame.roots)) and not any(p.tree == tree for p in frame.pending):
                self.keyed(frame, tree, None)
            return
        for c in children(tree):
            self.announce(frame, c)

    def sort_key(self, frame: Frame, k: S.SortKey, listed: dict[str, Column]) -> tuple[S.SortKey, Column | None, Column | None]:
        """The key among listed columns if it is one, and the key over the frame's rows."""
        if isinstance(k.value, S.Name):
            name = k.value.name
            if name in listed and not isinstance(frame.names.get(name), Node):
                return k, listed[name], None
            if name in frame.names or name in frame.lost:
                found = frame.lookup(name)
                if isinstance(found, Node):
                    if len(found.cols) != 1:
                        return k, listed.get(name), F.struct(*found.cols)
                    return k, listed.get(name), F.col(found.cols[0])
                return k, listed.get(name), F.col(found.col)
            if name.upper() in ("HEAD", "TAIL"):
                node = frame.head if name.upper() == "HEAD" else frame.tail
                if not isinstance(node, Node):
                    raise QueryError(f"{name} names no instance to sort by")
                return k, None, F.struct(*node.cols) if len(node.cols) != 1 else F.col(node.cols[0])
            raise QueryError(f"there is nothing named {name!r} to sort by")
        return k, None, self.expr(frame, k.value)

    def projection(self, frame: Frame, items: list[S.Item] | None) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        if items is None:
            ends = [frame.head] if frame.head is frame.tail or frame.head is None else [frame.head, frame.tail]
            if frame.head is None:
                ends = [frame.tail]
            for e in ends:
                if isinstance(e, Calc):
                    out.append(("value", F.col(e.col)))
                else:
                    out += self.shown(e.type, e)
            return out
        for item in items:
            found = frame.lookup(item.value.name) if isinstance(item.value, S.Name) else None
            if isinstance(found, Node):
                out += self.shown(item.label, found)
            elif isinstance(item.value, S.Path) and item.value.head and not item.value.steps and item.value.head.type and (node := next((n for n in frame.all_nodes() if n.type == item.value.head.type), None)):
                out += self.shown(item.label, node)
            else:
                out.append((item.label, self.expr(frame, item.value)))
        return out

    def shown(self, label: str, node: Node) -> list[tuple[str, Column]]:
        if not node.cols:
            raise QueryError(f"{node.type} has no identifying columns to show: list its values")
        if len(node.cols) == 1:
            return [(label, F.col(node.cols[0]))]
        return [(f"{label}_{c.split('__', 1)[-1]}", F.col(c)) for c in node.cols]

    def set_query(self, q: S.Query, frame: Frame) -> tuple[DataFrame, list[str], Frame]:
        df, labels = self.set_operand(q.body)
        return self.arranged(df, labels, q), labels, frame

    def set_operand(self, tree: Any) -> tuple[DataFrame, list[str]]:
        if isinstance(tree, S.SetOf):
            left, labels = self.set_operand(tree.left)
            right, others = self.set_operand(tree.right)
            if len(labels) != len(others):
                raise QueryError(f"the operands list {len(labels)} and {len(others)} values")
            right = right.toDF(*labels)
            op = {"union": lambda: left.union(right).distinct(), "intersect": lambda: left.intersect(right), "minus": lambda: left.subtract(right)}[tree.op]
            return op(), labels
        query = tree if isinstance(tree, S.Query) else S.Query(tree)
        df, labels, _ = self.query(query, Frame(self.ctx))
        return df, labels

    def arranged(self, df: DataFrame, labels: list[str], q: S.Query) -> DataFrame:
        """Order and cut a whole, by the names that it lists."""
        if q.cut and (q.cut.per or q.cut.ties):
            raise QueryError("PER and WITH TIES stand in a query of its own, not over a set operation")
        order = []
        for k in q.order:
            if not isinstance(k.value, S.Name) or k.value.name not in labels:
                raise QueryError("a set operation is sorted by a name that it lists")
            order.append((F.col(f"`{k.value.name}`"), k.descending))
        return cut_rows(df, order, q.cut, None)

    def element(self, frame: Frame, e: S.Element) -> tuple[str, Column]:
        """A side path of a confluence: a value if there is at most one, else a list, empty where there is none."""
        base = frame.head
        if e.via:
            base = frame.node(e.via)
            if not base:
                raise QueryError(f"{e.via!r} names no instance of the base path")
        tree = e.path
        if isinstance(tree, S.Path) and tree.head is not None and tree.head.type and not tree.steps:
            tree = S.Path(None, [S.Step("has", tree.head)])
        if not isinstance(tree, S.Path):
            raise QueryError("an element of a confluence is a path")
        if tree.head is not None and tree.head.type and self.model.related(tree.head.type, base.type):
            tree = replace(tree, head=None)
        last = next((s.atom for s in reversed(tree.steps) if isinstance(s, S.Step) and s.atom), None)
        label = e.name or (last.var or last.type if last else "value")
        if not (e.order or e.cut) and self.single(base.type, tree):
            optional = replace(tree, steps=[replace(s, optional=True) if isinstance(s, S.Step) else s for s in tree.steps])
            node = self.at(frame, base, lambda: self.path(frame, optional))
            return label, self.column(node)
        a = S.Aggregate("list", arg=None, body=tree, order=e.order, cut=e.cut)
        return label, self.at(frame, base, lambda: self.scalar(frame, a))

    # == definitions, rules, recursion ======================================================

    def define(self, name: str, source: str) -> None:
        """Name a whole result: one listed thing makes a subtype, several a fact type."""
        if self.model.has_type(name):
            raise QueryError(f"the model already has a {name}")
        q = parse(self.model, source).query
        df, labels, frame = self.query(q, Frame(self.ctx))
        self.register(name, df, labels, frame, q)

    def register(self, name: str, df: DataFrame, labels: list[str], frame: Frame, q: S.Query) -> None:
        m = self.ctx.model = self.model.copy()
        items = q.items or [S.Item(S.Name(label), label) for label in labels]
        nodes = [frame.names.get(i.value.name) if isinstance(i.value, S.Name) else None for i in items]
        if q.items is None:
            ends = [frame.head] if frame.head is frame.tail else [frame.head, frame.tail]
            nodes = list(ends)
        columns = [f"c{i}" for i in range(len(labels))]
        self.ctx.derived[name] = df.toDF(*columns).distinct()
        widths = [len(n.cols) if isinstance(n, Node) else 1 for n in nodes]
        starts = [sum(widths[:i]) for i in range(len(widths))]
        spans = [tuple(columns[s : s + w]) for s, w in zip(starts, widths, strict=True)]
        first = nodes[0]
        if len(nodes) == 1:
            if not isinstance(first, Node) or first.type not in m.entities:
                raise QueryError(f"{name} lists one value: list an instance, so that it can be walked")
            m.entity(name, name, *spans[0], supertype=first.type)
            return
        if not isinstance(first, Node) or first.type not in m.entities:
            raise QueryError(f"{name} must list an instance first, from which it is walked")
        per = q.cut and q.cut.per and q.cut.first == 1 and frame.names.get(q.cut.per) is first
        if frame.grouped:
            functional = set(frame.key_nodes) == {first} or bool(per)
        else:
            fixed = determine.closure(frame, [first])
            functional = bool(per) or all((n in fixed) if isinstance(n, Node) else False for n in nodes[1:])
        for item, node, span in zip(items[1:], nodes[1:], spans[1:], strict=True):
            stem = re.sub(r"\W+", "", item.label)
            if isinstance(node, Node):
                player = node.type
            else:
                player = f"{name}{stem[:1].upper()}{stem[1:]}"
                m.value(player, "")
            keys = (frozenset((0,)),) if functional else (frozenset((0, 1)),)
            m.facts.append(Fact(f"{name}{stem}", name, (Role(first.type, spans[0]), Role(player, span, mandatory=False)), ((f"has {name}", 0, 1), (f"is {name} of", 1, 0)), keys))

    def recursive(self, name: str, source: str, rounds: int | None = None) -> DataFrame:
        """A derived fact that may name itself: its least fixpoint.

        source: queries joined by UNITED WITH; those that name the fact are
        repeated over the rows that the last round added (all rows so far, where
        a query names the fact twice) until a round adds none, or at most
        ``rounds`` times if that is given. Every round's rows are a folder of
        their own in the shared one, and all rows so far are one scan of these,
        so that plans stay short however many rounds it takes.
        """
        names = re.compile(rf"\bhas {name}\b|\bis {name} of\b")
        q = self.split_union(source)
        base = [t for t in q if not names.search(t)]
        steps = [t for t in q if names.search(t)]
        if not base:
            raise QueryError(f"{name} has no operand to start from that does not name {name} itself")
        frames = []
        found = None
        for text in base:
            parsed = parse(self.model, text).query
            df, labels, frame = self.query(parsed, Frame(self.ctx))
            frames.append((labels, frame, parsed))
            found = df if found is None else found.union(df.toDF(*found.columns))
        labels, frame, parsed = frames[0]
        folders: list[str] = []

        def keep_round(df: DataFrame) -> DataFrame:
            folders.append(scratch(self.ctx.spark, name))
            df.write.parquet(folders[-1])
            return self.ctx.spark.read.schema(df.schema).parquet(folders[-1])

        delta = keep_round(found.distinct())
        self.register(name, delta, labels, frame, parsed)
        columns = [f"c{i}" for i in range(len(labels))]
        while steps and not delta.isEmpty():
            if rounds is not None and len(folders) > rounds:
                raise QueryError(f"{name} still grows after {rounds} rounds")
            total = self.ctx.spark.read.schema(delta.schema).parquet(*folders)
            found = None
            for text in steps:
                self.ctx.derived[name] = (total if len(names.findall(text)) > 1 else delta).toDF(*columns)
                df, _, _ = self.query(parse(self.model, text).query, Frame(self.ctx))
                found = df.toDF(*labels) if found is None else found.union(df.toDF(*labels))
            delta = keep_round(found.subtract(total))
        total = self.ctx.spark.read.schema(delta.schema).parquet(*folders)
        self.ctx.derived[name] = total.toDF(*columns)
        return total

    def split_union(self, source: str) -> list[str]:
        parts, depth, start = [], 0, 0
        for m in re.finditer(r"[()]|\bUNITED WITH\b", source):
            if m[0] == "(":
                depth += 1
            elif m[0] == ")":
                depth -= 1
            elif depth == 0:
                parts.append(source[start : m.start()])
                start = m.end()
        parts.append(source[start:])
        return [t.strip()[1:-1] if t.strip().startswith("(") else t.strip() for t in parts]


def known_inner(compiler: Compiler, frame: Frame, p: Pending, done: set[str]) -> bool:
    trees = [p.tree.arg, p.tree.by, *(p.tree.keys or [])] if isinstance(p.tree, S.Aggregate) else [p.tree]
    inner = [q for t in trees if t is not None for q in compiler.uses(frame, t) if q is not p]
    if isinstance(p.tree, S.Aggregate) and p.kind == "window" and any(q.kind == "window" for q in inner):
        raise QueryError("a window over a window: DEFINE the inner one first")
    return all(q.col in done for q in inner)


def children(tree: Any) -> list[Any]:
    if isinstance(tree, S.Logic):
        return tree.args
    if isinstance(tree, (S.Binary, S.Compare)):
        return [tree.left, tree.right]
    if isinstance(tree, S.Negative):
        return [tree.value]
    if isinstance(tree, S.Call):
        return tree.args
    if isinstance(tree, S.Choice):
        return [tree.condition, tree.then, tree.other]
    if isinstance(tree, S.Named):
        return [tree.value]
    if isinstance(tree, S.Aggregate):
        return [x for x in (tree.arg, tree.by) if x is not None]
    return []


def bags(tree: Any) -> list[S.Aggregate]:
    """The aggregates in an expression that have a bag of their own."""
    if isinstance(tree, S.Aggregate):
        return [tree] if tree.body is not None and not isinstance(tree.body, S.Query) else []
    return [x for c in children(tree) for x in bags(c)]


def has_outer(tree: Any) -> bool:
    return isinstance(tree, S.Outer) or any(has_outer(c) for c in children(tree))


def cut_rows(df: DataFrame, order: list[tuple[Column, bool]], cut: S.Cut | None, per: list[Column] | None) -> DataFrame:
    """Sort and cut. Nulls come first ascending, last descending."""
    keys = [c.desc_nulls_last() if descending else c.asc_nulls_first() for c, descending in order]
    if cut and cut.ties and (not keys or cut.after):
        raise QueryError("WITH TIES needs a sort key, and no AFTER")
    if cut and per:
        by = Window.partitionBy(*per).orderBy(*(keys or [F.lit(0)]))
        place = (F.rank() if cut.ties else F.row_number()).over(by)
        df = df.withColumn("place", place).where((F.col("place") <= cut.first + cut.after) & (F.col("place") > cut.after))
        return df.orderBy(*keys) if keys else df
    if cut and cut.ties:
        return with_ties(df, order, cut.first).orderBy(*keys)
    if keys:
        df = df.orderBy(*keys)
    if cut:
        df = (df.offset(cut.after) if cut.after else df).limit(cut.first)
    return df


def with_ties(df: DataFrame, order: list[tuple[Column, bool]], first: int) -> DataFrame:
    """The first rows of an order and all that tie with the last of them: rows up to the key of one row."""
    named = df.select("*", *[c.alias(f"tie{i}") for i, (c, _) in enumerate(order)])
    sort = lambda turn: [F.col(f"tie{i}").desc_nulls_last() if down != turn else F.col(f"tie{i}").asc_nulls_first() for i, (_, down) in enumerate(order)]
    edge = named.orderBy(*sort(False)).limit(first).orderBy(*sort(True)).limit(1).select(*[F.col(f"tie{i}").alias(f"edge{i}") for i in range(len(order))])
    inside = F.lit(True)
    for i, (_, down) in reversed(list(enumerate(order))):
        x, e = F.col(f"tie{i}"), F.col(f"edge{i}")
        # nulls come first ascending, last descending
        before = F.coalesce(x > e, x.isNotNull() & e.isNull()) if down else F.coalesce(x < e, x.isNull() & e.isNotNull())
        inside = before | (x.eqNullSafe(e) & inside)
    return named.crossJoin(F.broadcast(edge)).where(inside).select(*[F.col(f"`{c}`") for c in df.columns])


def run(spark: SparkSession, model: Model, source: Source, text: str, permissive: bool = False) -> DataFrame:
    """Compile a query to a DataFrame. Only recursive rules run jobs before an action."""
    ctx = Context(spark, model, source, permissive)
    compiler = Compiler(ctx)
    for rule in model.rules:
        if re.search(rf"\bhas {rule.name}\b|\bis {rule.name} of\b", rule.source):
            compiler.recursive(rule.name, rule.source)
        else:
            compiler.define(rule.name, rule.source)
    return compiler.script(text)


def violations(spark: SparkSession, model: Model, source: Source, limit: int = 20) -> dict[str, list]:
    """Counter-examples of each constraint, at most ``limit`` each."""
    return {c.name: run(spark, model, source, c.violation).limit(limit).collect() for c in model.constraints}


__all__ = ["Compiler", "Entity", "QueryError", "Value", "run", "violations"]
