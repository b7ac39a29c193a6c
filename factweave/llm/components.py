"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _directed(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, once each."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to its least one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """The least node that each linked node reaches.

    edges: (u long, v long), any direction, repeats allowed; nulls are dropped,
    as they link nothing. Returns (node, root) for every node that has a link
    to another one. Rounds grow with the logarithm of the longest chain; each
    round's links are written to the shared folder, and no link or component
    goes to the driver. A star's hub is a key of many rows only in joins to a
    table with one row for each key, which adaptive execution splits.
    """
    now = materialise(_directed(edges.where("u is not null and v is not null")), "links")
    seen = None
    while True:
        now = materialise(_directed(_small_star(_directed(_large_star(now)))), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = state
