"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target rows over its rows. A
document is repeated as often as a Poisson distribution with that mean says,
inverted at a number in [0, 1) that a hash of the seed and the document gives.
Copies are then dealt over all partitions and ordered by another hash: a global
shuffle. The same seed gives the same rows, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, materialise, packed, plan_bytes, text_or_empty, unpacked

#: A larger mean is split into parts of at most this mean, whose counts add up.
PART = 256.0
#: Sources up to this number are broadcast: a mean and at most 500 doubles each.
BROADCAST_SOURCES = 10_000


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("double") / F.lit(16.0**13)


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far beyond the mean."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, rows_out: float | None) -> DataFrame:
    """(source, parts, cdf) for each source that has rows; the mean of each part fixes its cdf."""
    counts = materialise(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    weight = F.lit(1.0)
    if weights is not None:
        known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0))
    weighed = counts.select("source", "n", weight.alias("w"))
    total = weighed.agg(F.sum("w"), F.sum("n")).first()
    whole = rows_out if rows_out is not None else float(total[1] or 0)
    mean = F.col("w") / F.lit(float(total[0] or 1.0)) * F.lit(float(whole)) / F.col("n")
    parts = weighed.select("source", "n", mean.alias("mean")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int"))
    return parts.select("source", "mean", "parts", _cdf(F.col("mean") / F.col("parts")).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rows_out: float | None = None, seed: int = 7, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", replica_col: str | None = "replica") -> DataFrame:
    """Repeat documents until each source has its share, and shuffle them.

    weights: target weight by source; sources it lacks get none. None: all
    sources that occur weigh the same. rows_out: rows to aim at, as many as
    docs has if None. A null source is a source of its own (with weights given,
    of weight 0).

    A document with count 0 does not occur in the mix: that is what the method
    samples. All columns are kept; replica_col numbers a document's copies from
    1 (None: no such column). The hash reads the id and the whole text, so
    documents with null or repeated ids draw on their own; fully repeated rows
    draw alike. An empty table gives an empty result.
    """
    stats = rates(docs, weights, source_col, rows_out)
    if stats.count() <= BROADCAST_SOURCES:
        stats = F.broadcast(stats)
    rows = packed(docs, own_source=F.col(source_col).cast("string"), own_id=F.coalesce(F.col(id_col).cast("string"), F.lit("")), own_text=F.md5(text_or_empty(text_col)))
    rows = rows.join(stats, F.col("own_source").eqNullSafe(F.col("source")))
    draw = lambda i: F.size(F.filter("cdf", lambda c: c < uniform(F.lit(str(seed)), i.cast("string"), F.col("own_id"), F.col("own_text"))))
    first = F.expr("size(filter(cdf, c -> c < u))")
    rows = rows.withColumn("u", uniform(F.lit(str(seed)), F.lit("0"), F.col("own_id"), F.col("own_text")))
    more = F.aggregate(F.sequence(F.lit(1), F.col("parts") - 1), F.lit(0), lambda acc, i: acc + draw(i))
    rows = rows.withColumn("times", F.when(F.col("parts") > 1, first + more).otherwise(first)).where("times > 0")
    copies = rows.select("row", "own_id", "own_text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    # where a row was read spreads rows that are repeated as they are
    copies = copies.select("row", "copy", F.xxhash64(F.lit(seed), "own_id", "own_text", "copy", F.spark_partition_id()).alias("order"))
    mixed = dealt(copies, plan_bytes(docs), "order").sortWithinPartitions("order")
    return unpacked(mixed, F.col("copy").alias(replica_col)) if replica_col else unpacked(mixed)


#: Rows of ``mix(documents)`` with its defaults, for means up to PART.
ORACLE_SQL = """
with recursive sized as (select source, count(*) as n from documents group by source),
rate as (select source, 1.0::double / (select count(*) from sized)::double * (select sum(n) from sized)::double / n as mean from sized),
steps(source, mean, k, p, c) as (
  select source, mean, 0, exp(-mean), exp(-mean) from rate
  union all
  select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from steps where k < ceil(mean + 12 * sqrt(mean) + 30)),
drawn as (
  select doc_id, text, lang, source, n_chars,
         ('0x' || substr(md5('7:0:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::ubigint::double / pow(16, 13) as u
  from documents),
counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (select count(*) from steps s where s.source is not distinct from d.source and s.c < d.u) as times
  from drawn d)
select doc_id, text, lang, source, n_chars, cast(unnest(range(1, times + 1)) as integer) as replica from counted where times > 0
"""
