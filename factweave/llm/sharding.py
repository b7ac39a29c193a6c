"""Sharding through fixed virtual slots.

Records hash into a fixed number of slots that never changes; a small, stored
and versioned map takes slots to shards. Only the map is edited when the number
of shards or the load changes, and only records of moved slots move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Virtual slots: fixed for good, as records' slots must not change.
SLOTS = 16384
#: Different records of a cell to aim at: a slot is dealt into as many cells by its texts, so that no window is large.
CELL_ROWS = 100_000
#: Copies of one record that are unrolled together.
RUN = 100_000
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def slot_map(spark: SparkSession, shards: int, version: int = 1) -> DataFrame:
    """The map for a number of shards: (version, vslot, shard).

    Shard m, when it was added, drew each slot with the chance 1 / (m + 1); a
    slot is where the last shard that drew it put it. So one more shard takes
    an even share of slots from all others, and no slot moves between those.
    """
    u = lambda m: F.shiftrightunsigned(F.xxhash64(F.lit("slot"), "vslot", m), 11) / F.lit(2.0**53)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda m: u(m) < 1.0 / (m + F.lit(1.0)))
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("vslot")).select(F.lit(version).alias("version"), "vslot", F.array_max(drawn).alias("shard"))


def grow(now: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, with one shard more: rows that change, and those that stay."""
    version = F.col("version") + 1
    drawn = slot_map(now.sparkSession, shards + 1).where(F.col("shard") == shards).select("vslot", F.col("shard").alias("drawn"))
    return now.join(F.broadcast(drawn), "vslot", "left").select(version.alias("version"), "vslot", F.coalesce("drawn", "shard").alias("shard"))


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot: at most SLOTS rows. records: (vslot, size)."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(now: DataFrame, load: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map, edited until shards' bytes are about equal.

    Shards above the mean by more than the tolerance give their smallest slots,
    as many as make up the excess; these go, in order, to the shards below the
    mean, each up to its lack. Both tables have at most SLOTS rows, so windows
    without a partition key are of bounded size.
    """
    full = now.join(load, "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    totals = full.groupBy("shard").agg(F.sum("bytes").alias("total"))
    mean = F.avg("total").over(Window.partitionBy(F.lit(0)))
    totals = totals.select("shard", "total", mean.alias("mean"))
    rising = Window.partitionBy("shard").orderBy("bytes", "vslot")
    placed = full.join(F.broadcast(totals), "shard").withColumn("below", F.sum("bytes").over(rising))
    gives = (F.col("total") > F.col("mean") * (1 + tolerance)) & (F.col("below") <= F.col("total") - F.col("mean")) & (F.col("bytes") > 0)
    order = Window.partitionBy(F.lit(0)).orderBy("shard", "vslot")
    donors = placed.where(gives).select("vslot", (F.sum("bytes").over(order) - F.col("bytes") / 2).alias("at"))
    lacks = totals.where("total < mean").select("shard", (F.col("mean") - F.col("total")).alias("lack"))
    lacks = lacks.select("shard", (F.sum("lack").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("lack")).alias("at"))
    line = lacks.select("at", "shard", F.lit(None).cast("int").alias("vslot")).union(donors.select("at", F.lit(None).cast("int"), "vslot"))
    along = Window.partitionBy(F.lit(0)).orderBy("at", F.col("vslot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    moved = line.select("vslot", F.last("shard", ignorenulls=True).over(along).alias("moved")).where("vslot is not null")
    return now.join(F.broadcast(moved), "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("moved", "shard").alias("shard"))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every record into a shard, under the law ``key``.

    The id and the number of shards alone decide a record's shard; with one
    more shard, records move only into the new one. The slot map is stored in
    the shared folder in both versions, with each slot's bytes and rows.

    Null ids hash like any other value, so they share a shard; a null text has
    no bytes and the checksum of the empty text. Repeated rows keep a place
    each. An empty table gives an empty result.

    Returns id, size, text_crc32, law, shard, slot (the place within the shard,
    gapless from 0, by virtual slot and id), grown_shard, vslot, slot_bytes and
    map_version. Places come from counts of cells: a slot's rows are dealt into
    cells of some CELL_ROWS by text, so no id's rows meet in one task; only rows
    of a cell are sorted, never a whole shard. Repeated rows are one row with a
    count until they get their places.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    # equal rows travel as one with a count
    rows = rows.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("vslot", slot_of(F.col("doc_id")))
    rows = materialise(rows, "records")
    load = materialise(rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("slot_bytes"), F.sum("copies").alias("slot_rows"), F.count(F.lit(1)).alias("records")), "load")
    wide = load.select("vslot", F.greatest(F.lit(1), F.ceil(F.col("records") / CELL_ROWS)).alias("cells"))
    celled = rows.join(F.broadcast(wide), "vslot").withColumn("cell", F.pmod("digest", F.col("cells")).cast("int")).drop("cells")
    cells = materialise(celled.groupBy("vslot", "cell").agg(F.sum("copies").alias("rows")), "cells")
    first = slot_map(spark, shards)
    stored = first.union(grow(first, shards)).join(load, "vslot", "left")
    stored = materialise(stored.select("version", "vslot", "shard", F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes"), F.coalesce("slot_rows", F.lit(0)).alias("slot_rows")), "slot-map")
    both = stored.groupBy("vslot").agg(F.max(F.when(F.col("version") == 1, F.col("shard"))).alias("shard"), F.max(F.when(F.col("version") == 2, F.col("shard"))).alias("grown_shard"), F.max("slot_bytes").alias("slot_bytes"))
    by_shard = Window.partitionBy("shard").orderBy("vslot", "cell")
    offsets = cells.join(F.broadcast(both), "vslot").select("vslot", "cell", "shard", "grown_shard", "slot_bytes", (F.sum("rows").over(by_shard) - F.col("rows")).alias("offset"))
    before = F.sum("copies").over(Window.partitionBy("vslot", "cell").orderBy("doc_id", "digest", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    numbered = celled.withColumn("place", F.coalesce(before, F.lit(0))).join(offsets, ["vslot", "cell"])
    # copies of a row take the places after its first, in runs that are unrolled apart
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
    last = F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, last)))
    return each.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place") + F.col("copy")).cast("long").alias("slot"), "grown_shard", "vslot", "slot_bytes", F.lit(1).alias("map_version")
    )
