"""Searching vectors in blocks: a query set against all rows.

Candidates are dealt into blocks of bounded size, queries into groups of
bounded size, and each pair of a query group and a block is one task's work.
A block gives each query its k best; the k best of these are the k best of all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship

BLOCK = 16384
GROUP = 16384

#: (queries, their ids, candidates, their ids) -> rows (query, candidate index, score)
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of rows with an id and a vector of finite numbers; floats stay floats, all else is double."""
    own = df.schema[vec_col].dataType
    kind = "array<float>" if isinstance(own, T.ArrayType) and isinstance(own.elementType, T.FloatType) else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite)


def enough(rows: DataFrame, k: int) -> DataFrame:
    """At most k of each set of equal rows: no query can have more of them among its k best."""
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(k))))).drop("copies")


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def search(rows: DataFrame, every: int, k: int, run: Search, score_type: str) -> DataFrame:
    """The k best of each query: (query_id, rank, vec_id, score).

    rows: (vec_id, vec, more) without nulls; ids may repeat. Queries are the
    rows whose id is divisible by ``every`` (equal rows once); candidates are
    all rows with another id and as many components. Ties go to the smaller id.
    """
    ship(rows.sparkSession)
    rows = materialise(enough(rows, k).withColumn("dim", F.size("vec")), "vectors")
    n = rows.count()
    blocks, groups = max(12, -(-n // BLOCK)), max(2, -(-(n // every) // GROUP))
    candidates = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # both sides come from the same rows: columns of the same origin would be taken for one
    candidates = candidates.select(*[F.col(c).alias(c) for c in ("dim", "grp", "block")], F.col("vec_id").alias("cand_id"), F.col("vec").alias("cand"))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"])
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select("dim", "grp", "block", "vec_id", "vec", F.xxhash64("vec").alias("version"))
    score = pa.int64() if score_type == "long" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("version", pa.int64()), ("vec_id", pa.int64()), ("score", score)])

    def both(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return schema.empty_table()
        qid, cid = queries.column("vec_id").to_numpy(), block.column("cand_id").to_numpy()
        q, c, s = run(matrix(queries.column("vec"), len(qid)), qid, matrix(block.column("cand"), len(cid)), cid)
        return pa.table([pa.array(qid[q]), pa.array(queries.column("version").to_numpy()[q]), pa.array(cid[c]), pa.array(s, score)], schema=schema)

    keys = ["dim", "grp", "block"]
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(both, f"query_id long, version long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id", "version").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]
