"""Sharding: the law, places, and edits of the map."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from factweave.llm import sharding


def test_places_sizes_and_law(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sharding.assign(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    places = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    half = {r.doc_id: r.shard for r in sharding.assign(docs.where("doc_id % 2 = 0")).collect()}
    assert all(half[r.doc_id] == r.shard for r in rows if r.doc_id in half)


def test_growing_moves_an_even_share_into_the_new_shard_only(spark):
    now = sharding.slot_map(spark, 40)
    grown = {r.vslot: r.shard for r in sharding.grow(now, 40).collect()}
    direct = {r.vslot: r.shard for r in sharding.slot_map(spark, 41).collect()}
    assert grown == direct
    moved = [s for r in now.collect() if (s := grown[r.vslot]) != r.shard]
    assert set(moved) == {40} and abs(len(moved) - sharding.SLOTS / 41) < 80


def test_rebalancing_evens_out_bytes_and_raises_the_version(spark):
    now = sharding.slot_map(spark, 8)
    load = now.select("vslot", F.when(F.col("shard") == 3, 500).otherwise(100).alias("bytes"), F.lit(1).alias("rows"))
    after = sharding.rebalance(now, load)
    totals = [r.t for r in after.join(load, "vslot").groupBy("shard").agg(F.sum("bytes").alias("t")).collect()]
    assert max(totals) < 1.03 * sum(totals) / 8 and len(totals) == 8
    assert {r.version for r in after.select("version").distinct().collect()} == {2}


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, 1, 1), (None, "", 1, 1), (7, "é", 1, 1), (7, "é", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, vslot int, cell int")
    got = sharding.assign(df).collect()
    assert sorted(r.size for r in got) == [16, 16, 18, 18]
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert sharding.assign(df.limit(0)).count() == 0


def test_hot_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    monkeypatch.setattr(sharding, "RUN", 1000)
    rows = spark.range(30_000).selectExpr("if(id < 10000, 5, if(id < 20000, null, id)) as doc_id", "if(id < 10000, 'same', concat('t', id % 3000)) as text")
    got = sharding.assign(rows).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("places")).collect()
    assert sum(r.n for r in got) == 30_000
    assert all(r.low == 0 and r.high == r.n - 1 == r.places - 1 for r in got)
    assert sharding.assign(rows).where("doc_id = 5").select("shard").distinct().count() == 1
