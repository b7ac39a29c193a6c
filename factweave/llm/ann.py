"""Approximate nearest neighbours from randomly rotated one-bit codes.

A unit vector is padded with zeros and turned by a random rotation, and each
component's sign is one bit of its code. With the correction scalar
<code, vector>, the packed bits give an unbiased estimate of the cosine to any
query, whose error stays within a bound that the scalar gives too, but for a
small chance. Queries are turned likewise and rounded to LEVELS bits a
component, so that a product of code and query is a sum of bit counts.

Blocks of codes meet the queries without their vectors: only codes and scalars
travel. A candidate survives if its estimate plus bound reaches the k-th best
estimate minus bound; vectors are fetched for survivors alone and give the exact
cosines that rank them. All others can't be among the k best unless a bound
failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship
from .vectors import BLOCK, GROUP, enough, matrix, usable

#: Standard deviations in the error bound. The chance that a bound fails falls as exp(-x^2 / 2).
BOUND = 1.5
#: Bits of a code at least: a multiple of 64. More bits make the bounds narrower.
BITS = 512
#: Bits to which a query's component is rounded.
LEVELS = 6
SEED = 11


def width(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The rows of a random rotation of width(dim) dimensions that act on unpadded vectors."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width(dim), dim)))
    return (q * np.sign(np.diag(r))).T


def turned(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    # dividing by the largest component first keeps squares within range
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ turn


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, correction scalar, standard deviation of an estimate) of each vector."""
    y = turned(vectors.astype(float), turn)
    bits = y.shape[1]
    scalar = np.abs(y).sum(axis=1) / np.sqrt(bits)
    return np.packbits(y > 0, axis=1).view(np.uint64), scalar, np.sqrt(np.maximum(0, 1 - scalar**2)) / (scalar * np.sqrt(bits - 1))


class Query:
    """A turned unit query in bit planes: component j is about low + step * (its LEVELS-bit number)."""

    def __init__(self, y: np.ndarray):
        self.bits = len(y)
        self.low = y.min()
        self.step = max(float(y.max() - self.low) / (2**LEVELS - 1), 1e-12)
        numbers = np.rint((y - self.low) / self.step).astype(np.uint8)
        planes = (numbers[None, :] >> np.arange(LEVELS, dtype=np.uint8)[:, None]) & 1
        self.planes = np.packbits(planes, axis=1).view(np.uint64)
        self.total = self.low * self.bits + self.step * int(numbers.sum())
        # rounding moves each component by less than half a step, either way; scalars are about 0.8
        self.rounding = 4 * self.step / np.sqrt(12)

    def estimate(self, words: np.ndarray, ones: np.ndarray, scalar: np.ndarray) -> np.ndarray:
        """Estimated cosines to all codes. words: the codes, one row for each 64 bits; ones: their bit counts."""
        product = np.zeros(len(ones), np.int32)
        for p, plane in enumerate(self.planes):
            count = np.zeros(len(ones), np.uint16)
            for word, mask in zip(words, plane, strict=True):
                count += np.bitwise_count(word & mask)
            product += count.astype(np.int32) << p
        return ((2 * (self.low * ones + self.step * product) - self.total) / np.sqrt(self.bits) / scalar).astype(np.float64)


def _encode(seed: int):
    schema = pa.schema([("dim", pa.int32()), ("vec_id", pa.int64()), ("version", pa.int64()), ("code", pa.binary()), ("scalar", pa.float64()), ("error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = pa.Table.from_batches([batch.filter(pa.array(dims == dim))])
                if dim not in turns:
                    turns[dim] = rotation(dim, seed)
                bits, scalar, error = codes(matrix(part.column("vec"), part.num_rows), turns[dim])
                packed = pa.array([row.tobytes() for row in bits], pa.binary())
                columns = [part.column(c).combine_chunks().cast(schema.field(c).type) for c in ("dim", "vec_id", "version")]
                yield pa.record_batch([*columns, packed, pa.array(scalar), pa.array(error)], schema=schema)

    return run


def _survivors(k: int, bound: float, seed: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_version", pa.int64()), ("vec_id", pa.int64()), ("version", pa.int64()), ("low", pa.float64()), ("up", pa.float64())])

    def run(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return schema.empty_table()
        qid, qver = (queries.column(c).to_numpy() for c in ("vec_id", "version"))
        cid, cver, scalar, error = (block.column(c).to_numpy() for c in ("cand_id", "cand_version", "scalar", "error"))
        words = np.ascontiguousarray(np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint64).reshape(len(cid), -1).T)
        ones = np.bitwise_count(words).sum(axis=0, dtype=np.int32)
        y = turned(matrix(queries.column("vec"), len(qid)).astype(float), rotation(key[0].as_py(), seed))
        found = []
        for i in range(len(qid)):
            query = Query(y[i])
            estimate = query.estimate(words, ones, scalar)
            slack = bound * error + query.rounding
            other = cid != qid[i]
            low = np.where(other, estimate - slack, -np.inf)
            floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            left = np.flatnonzero((estimate + slack >= floor) & other)
            found.append((np.full(len(left), i), left, low[left], (estimate + slack)[left]))
        q, c, low, up = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array(x) for x in (qid[q], qver[q], cid[c], cver[c], low, up)], schema=schema)

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    a, b = a.astype(float), b.astype(float)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("query_id", pa.int64()), ("query_version", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = pa.Table.from_batches([batch.filter(pa.array(dims == dim))])
            score = cosines(matrix(part.column("cand"), part.num_rows), matrix(part.column("query"), part.num_rows))
            yield pa.record_batch([*(part.column(c).combine_chunks() for c in schema.names[:3]), pa.array(score)], schema=schema)


def nearest(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", bound: float = BOUND, seed: int = SEED) -> DataFrame:
    """The k nearest found by cosine, for each query.

    Every usable row is indexed; nothing is fitted. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do rows without an
    id; vectors meet only those of their own length. Equal query rows are one
    query; a query never meets a row with its own id. Ties go to the smaller
    id; of equal rows at most k take part, as no more can be among a query's k.
    An empty table gives an empty result. Returns query_id, rank (from 1),
    vec_id, score: the exact cosine in double precision.
    """
    spark = df.sparkSession
    ship(spark)
    rows = usable(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    rows = enough(rows, k).select("vec_id", "vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("version"))
    rows = materialise(rows, "vectors")
    n = rows.count()
    blocks, groups = max(12, -(-n // BLOCK)), max(2, -(-(n // every) // GROUP))
    coded = rows.mapInArrow(_encode(seed), "dim int, vec_id long, version long, code binary, scalar double, error double")
    coded = coded.withColumn("block", F.pmod(F.xxhash64("vec_id", "version"), F.lit(blocks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    coded = coded.select("dim", "grp", "block", F.col("vec_id").alias("cand_id"), F.col("version").alias("cand_version"), "code", "scalar", "error")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "version"])
    asked = queries.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select(*[F.col(c).alias(c) for c in ("dim", "grp", "block", "vec_id", "version", "vec")])
    keys = ["dim", "grp", "block"]
    found = asked.groupBy(*keys).cogroup(coded.groupBy(*keys)).applyInArrow(_survivors(k, bound, seed), "query_id long, query_version long, vec_id long, version long, low double, up double")
    own = Window.partitionBy("query_id", "query_version")
    place = F.row_number().over(own.orderBy(F.col("low").desc()))
    ranked = found.withColumn("place", place).withColumn("floor", F.max(F.when(F.col("place") == k, F.col("low"))).over(own))
    left = ranked.where(F.col("floor").isNull() | (F.col("up") >= F.col("floor"))).select("query_id", "query_version", "vec_id", "version")
    once = rows.dropDuplicates(["vec_id", "version"])
    left = left.join(once.select("vec_id", "version", F.col("vec").alias("cand")), ["vec_id", "version"])
    left = left.join(queries.select(F.col("vec_id").alias("query_id"), F.col("version").alias("query_version"), F.col("vec").alias("query")), ["query_id", "query_version"])
    scored = left.select("query_id", "query_version", "vec_id", F.size("cand").alias("dim"), "cand", "query").mapInArrow(_score, "query_id long, query_version long, vec_id long, score double")
    rank = F.row_number().over(own.orderBy(F.col("score").desc(), "vec_id"))
    return scored.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
