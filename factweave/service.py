"""A command line, and a tool server over JSON lines on standard input and output."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import explain, export
from .language.parser import QueryError
from .model import Model
from .plans.compiler import run, violations
from .reverse.review import lint
from .sources.tables import files

NOTICE = "no rows: a fact that the query requires may be absent, or a value may be spelt in another way"


class Service:
    """Seven tools over one model and its tables; nothing is ever written to a source."""

    def __init__(self, spark: SparkSession, model: Model, source: Callable[[str], DataFrame], allowed: set[str] | None = None):
        self.spark = spark
        self.model = explain.restricted(model, allowed) if allowed else model
        self.narrow = allowed is not None
        self.tables = {e.table for e in self.model.entities.values()} | {f.table for f in self.model.facts}
        self.source = source

    def tool_schema(self, question: str | None = None, relational: bool = False) -> str:
        return explain.schema(self.model, explain.link(self.model, question) if question else None, relational)

    def tool_explain(self, query: str) -> dict:
        return explain.explain(self.model, query).as_dict()

    def tool_query(self, query: str, limit: int = 100, strict: bool = False) -> dict:
        reading = explain.explain(self.model, query)
        if strict and reading.risks:
            return {"refused": reading.as_dict()}
        df = run(self.spark, self.model, self.read, query)
        rows = [r.asDict(recursive=True) for r in df.limit(limit).collect()]
        return {"columns": df.columns, "rows": rows, "normal": reading.normal, "notice": None if rows else NOTICE}

    def tool_sql(self, sql: str, limit: int = 100) -> dict:
        from .sqlguard import check

        if sql.strip().split(None, 1)[0].lower() not in ("select", "with"):
            raise QueryError("only reading is allowed")
        # views hold the columns that the model names, and statements may read no other files
        columns, known = {}, set()
        for t in sorted(self.tables):
            view = self.source(t)
            if self.narrow:
                view = view.select(*[f"`{c}`" for c in view.columns if c in self.named(t)])
            view.createOrReplaceTempView(t)
            columns[t] = view.columns
            known |= set(view.inputFiles())
        df = self.spark.sql(sql)
        if set(df.inputFiles()) - known:
            raise QueryError("the statement reads what may not be read")
        found = check(df, self.model, columns)
        return {"findings": [g.__dict__ for g in found], "rows": [r.asDict(recursive=True) for r in df.limit(limit).collect()]}

    def named(self, table: str) -> set[str]:
        """The columns of a table that the model names."""
        own = {c for e in self.model.entities.values() if e.table == table for c in e.key}
        return own | {c for f in self.model.facts if f.table == table for r in f.roles for c in r.columns}

    def tool_rules(self) -> list[str]:
        return explain.rules(self.model)

    def tool_lint(self) -> list[tuple[str, str, str]]:
        return lint(self.model)

    def tool_constraints(self, limit: int = 20) -> dict:
        return {k: [r.asDict() for r in v] for k, v in violations(self.spark, self.model, self.read, limit).items()}

    def read(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise QueryError(f"{table} may not be read")
        return self.source(table)

    def answer(self, line: str) -> dict:
        try:
            asked = json.loads(line)
            tool = getattr(self, f"tool_{asked['tool']}", None)
            if tool is None:
                return {"error": f"there is no tool {asked['tool']}"}
            return {"result": tool(**asked.get("arguments", {}))}
        except (QueryError, AnalysisException, ValueError, TypeError, KeyError) as why:
            return {"error": str(why)}

    def serve(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip():
                print(json.dumps(self.answer(line), default=str), file=out, flush=True)


#: One line for each thing that the language says.
PRIMER = """\
LIST a, b FROM Type a verb Type b ...   rows along a path; a name after a type binds it
... [verb Type: value]                  only filters; AND ALSO continues from the head
... BUT NOT verb Type                   absence; OPTIONALLY verb Type keeps what has none
... WHERE a > 1 AND NOT b = 'x'         conditions; a path among them asks whether it exists
THE COUNT OF | SUM OF | AVERAGE | MINIMUM | MAXIMUM | MEDIAN | LIST OF ... GROUPED BY a | WITHIN a AS n
ORDERED WITH a DESCENDING THE FIRST 3 [AFTER 2] [PER b] [WITH TIES]
(...) UNITED WITH | INTERSECTED WITH | MINUS (...)
DEFINE Name ::= LIST ...                names a result, which is then walked as has Name
verb Type AS x EACH Type                side paths, gathered for each"""


def loop(spark: SparkSession, model: Model, source: Callable[[str], DataFrame], lines, out, limit: int = 50) -> None:
    """A query a line; a line that ends in a backslash goes on. :explain and :normalise read the query after them back, :primer and :schema list."""
    held = ""
    for line in lines:
        held += line.rstrip("\n")
        if held.endswith("\\"):
            held = held[:-1] + "\n"
            continue
        text, held = held.strip(), ""
        word, _, rest = text.partition(" ")
        try:
            if word == ":quit":
                return
            if not text:
                continue
            said = {":primer": lambda: PRIMER, ":schema": lambda: explain.schema(model), ":explain": lambda: explain.explain(model, rest).text(), ":normalise": lambda: explain.explain(model, rest).normal}
            print(said[word]() if word in said else shown(spark, run(spark, model, source, text), limit), file=out, flush=True)
        except QueryError as why:
            print(why, file=out, flush=True)


def shown(spark: SparkSession, df: DataFrame, limit: int) -> str:
    """The first rows as a table, and how many there are; the query runs once."""
    rows = df.limit(limit + 1).collect()
    if not rows:
        return NOTICE
    table = spark.createDataFrame(rows[:limit], df.schema)._show_string(limit, False)
    return f"{table}{f'more than {limit}' if len(rows) > limit else len(rows)} rows"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factweave", description="Ask a conceptual model.")
    p.add_argument("model", help="a model's JSON file")
    p.add_argument("query", nargs="*", help="a query; none: one query a line from standard input")
    p.add_argument("--data", help="the folder of the tables")
    p.add_argument("--format", default="parquet")
    p.add_argument("--limit", type=int, default=50)
    for flag in ("explain", "check", "strict", "json", "schema", "relational", "normalise", "rules", "lint", "constraints", "permissive", "serve", "interactive", "primer"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--for", dest="question")
    p.add_argument("--orm", help="write the model as XML")
    p.add_argument("--html", help="write a diagram")
    a = p.parse_args(argv)
    model = Model.load(a.model)
    if a.orm:
        Path(a.orm).write_text(export.orm_xml(model))
    if a.html:
        Path(a.html).write_text(export.html(model))
    if a.schema:
        print(explain.schema(model, explain.link(model, a.question) if a.question else None, a.relational))
    if a.primer:
        print(PRIMER)
    if a.rules:
        print("\n".join(explain.rules(model)))
    if a.lint:
        print("\n".join(": ".join(x) for x in lint(model)))
    if a.schema or a.rules or a.lint or a.primer or (a.orm or a.html) and not a.query:
        return 0
    texts = [" ".join(a.query)] if a.query else [] if a.serve or a.constraints or a.interactive else [x for x in sys.stdin.read().split(";") if x.strip()]
    if a.explain or a.normalise:
        for t in texts:
            r = explain.explain(model, t)
            print(json.dumps(r.as_dict()) if a.json else r.normal if a.normalise else r.text())
        return 0
    spark = SparkSession.builder.appName("factweave").getOrCreate()
    source = files(spark, a.data, a.format)
    if a.interactive:
        loop(spark, model, source, sys.stdin, sys.stdout, a.limit)
    if a.serve:
        Service(spark, model, source).serve()
    if a.constraints:
        for name, rows in violations(spark, model, source).items():
            print(f"{name}: {len(rows)} counter-examples", *rows[:5], sep="\n  ")
    for t in texts:
        r = explain.explain(model, t)
        if a.check or a.strict:
            print(r.text())
            if a.strict and r.risks:
                return 1
        try:
            df = run(spark, model, source, t, a.permissive)
        except QueryError as why:
            print(why, file=sys.stderr)
            return 1
        print(shown(spark, df, a.limit))
    return 0
