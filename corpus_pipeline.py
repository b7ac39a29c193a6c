"""The corpus pipeline: five of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of documents.
Whoever runs the stages may write each result as Parquet and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import bpe, mixing, pii, simhash, toxicity
from factweave.llm.tokenizers_io import TokenizerFile

#: Target weights of sources; None: all sources that occur weigh the same.
WEIGHTS: dict[str, float] | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; it is fitted on the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays."""
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars is counted anew."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, until sources have their target weights."""
    return mixing.mix(docs, WEIGHTS, replica_col=None)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with the digest of the text that they decode to."""
    return bpe.encode(docs, TokenizerFile.read(), ["doc_id", "lang", "source"], digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: A fitted model and hashes decide, which SQL can't express: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder before the next reads them."""
    from factweave.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
