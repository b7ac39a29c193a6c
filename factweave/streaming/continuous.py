"""Path queries over streams.

A query whose plan is made of filters, joins with static tables, and one
grouping compiles to a streaming plan as it is: the compiler builds DataFrames
and does not ask whether they are bounded. Sorts, cuts, ranks, set differences
and recursion need all rows, so they are refused before anything starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..language import syntax as S
from ..language.parser import QueryError, parse
from ..model import Model
from ..plans.compiler import children, run


def bounded_only(model: Model, text: str) -> str | None:
    """Why a query needs all its rows, or None if it does not."""
    q = parse(model, text).query
    if q is None:
        return "definitions are made distinct over all rows"
    if q.order or q.cut:
        return "an order or a cut needs all rows"
    reason: list[str] = []

    def look(t) -> None:
        if isinstance(t, S.Aggregate):
            if t.within:
                reason.append("a window over rows needs all of a partition")
            elif not t.keys:
                reason.append("an aggregate over all rows that is joined back needs all of them")
        if isinstance(t, S.SetOf) and t.op != "union":
            reason.append("a difference or an intersection needs all rows")
        if isinstance(t, S.Combined):
            if t.op == "but not":
                reason.append("an absence can't be known before all rows are")
            look(t.left)
            look(t.right)
        elif isinstance(t, S.Where):
            look(t.body)
            look(t.condition)
        else:
            for c in children(t):
                look(c)

    for item in q.items or []:
        look(item.value)
    if q.body is not None:
        look(q.body)
    return reason[0] if reason else None


def stream(spark: SparkSession, model: Model, source: Callable[[str], DataFrame], text: str, event_time: tuple[str, str, str] | None = None) -> DataFrame:
    """A streaming DataFrame of the query.

    source gives streaming DataFrames for tables that grow and static ones for
    the rest. event_time is (table, column, delay): the table's watermark, after
    which late rows are dropped and groups that hold the column are final.
    """
    if why := bounded_only(model, text):
        raise QueryError(f"not over a stream: {why}")

    def tables(name: str) -> DataFrame:
        df = source(name)
        if event_time and name == event_time[0] and df.isStreaming:
            df = df.withWatermark(event_time[1], event_time[2])
        return df

    return run(spark, model, tables, text)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write to files, exactly once; or, in complete or update mode, replace the folder at each batch."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
