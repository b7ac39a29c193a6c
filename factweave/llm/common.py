"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise, scratch


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers, wherever they run; once for each application."""
    context = spark.sparkContext
    if getattr(context, "_factweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="factweave-")) / "factweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._factweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of df in one struct ``row``, beside the columns in ``more``.

    Working columns then never clash with columns of the input, whatever their
    names; ``unpacked`` gives the input's columns back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("row.*", *more)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


#: Elements whose running values are taken together.
CHUNK = 256


def running(values: Column, add: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each element of a non-empty array, the sum (by ``add``, from 0) of all up to it.

    Chunks of bounded size are summed up first, so that the cost stays far from
    the square of the array's length.
    """
    zero = F.lit(0).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        now = add(acc["now"], x)
        return F.struct(now.alias("now"), F.array_append(acc["all"], now).alias("all"))

    def within(all_: Column, totals: Column) -> Callable[[Column], Column]:
        start = lambda c: F.struct(F.aggregate(F.slice(totals, F.lit(1), c), zero, add).alias("now"), F.array().cast(f"array<{kind}>").alias("all"))
        return lambda c: F.aggregate(F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)), start(c), step, lambda acc: acc["all"])

    def chunked(all_: Column) -> Column:
        places = F.sequence(F.lit(0), F.ceil(F.size(all_) / CHUNK).cast("int") - 1)
        totals = F.transform(places, lambda c: F.aggregate(F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)), zero, add))
        return let(totals, lambda t: F.flatten(F.transform(places, within(all_, t))))

    return let(values, chunked)


#: Bytes of a partition to aim at.
PARTITION_BYTES = 128 << 20


def plan_bytes(df: DataFrame) -> int:
    """The size that a plan states for its rows; 0 if it states none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def dealt(df: DataFrame, n_bytes: int, *key: str) -> DataFrame:
    """Repartition by a key, into more partitions than the session's number where the bytes ask for it."""
    wanted = -(-n_bytes // PARTITION_BYTES)
    return df.repartition(wanted, *key) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*key)
