"""Token counts through a digest cache.

A count depends only on the content and on the tokenizer's version, so counts
are kept by the digests of both. A content's normal form is its text with null
as empty: byte-level files have no normaliser of their own, and what another
file's library would change besides may give one count two digests, never one
digest two counts. Documents are joined to the cache; only
distinct contents that it lacks are encoded, and their counts are appended.

Work per content is done once, however many copies there are: copies are
pre-aggregated by digest in each scan task before texts are shuffled, and the
join back carries digests and counts, never texts. A hot digest on the document
side of that join is split by adaptive execution, as the cache side has one row
for each digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, ship, text_or_empty
from .tokenizers_io import TokenizerFile, encoder

CACHE = T.StructType(
    [
        T.StructField("content_digest", T.StringType()),
        T.StructField("tokenizer_digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer version; empty where the path has none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    kept = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    return kept.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))


def _encode_misses(file: TokenizerFile):
    schema = pa.schema([("content_digest", pa.string()), ("tokenizer_digest", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            texts = batch.column("content")
            counts = [enc.count(t.as_py()) for t in texts]
            yield pa.record_batch([batch.column("content_digest"), pa.array([file.version] * len(counts), pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, file: TokenizerFile, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Count the tokens of every whole text.

    docs: any table with an id and a text; other columns are not read. A null
    text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeated: every
    input row gives one output row. An empty table gives an empty result. Texts
    are never cut, whatever their length.

    cache_path: a folder that holds counts from earlier calls and takes the new
    ones; a fresh folder in the shared directory if not given. Several calls may
    append to it at once: of repeated digests one counts.

    Returns id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``
    tokens) and content_digest. Running it writes the cache before it returns.
    """
    spark = docs.sparkSession
    ship(spark)
    cache_path = cache_path or scratch(spark, "token-counts")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("content")).withColumn("content_digest", F.sha2("content", 256))
    distinct = rows.groupBy("content_digest").agg(F.any_value("content").alias("content"))
    misses = distinct.join(read_cache(spark, cache_path, file.version), "content_digest", "left_anti")
    misses.select("content_digest", "content").mapInArrow(_encode_misses(file), CACHE).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, file.version)
    slim = rows.select("id", "content_digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return slim.join(counts, "content_digest", "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest"
    )
