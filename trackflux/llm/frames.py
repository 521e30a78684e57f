"""Staging, checked broadcasts and running ranks that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackflux.functions.storage import scratch_path

#: A side with at most this many (narrow) rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows with texts that a Python task gets at a time; the usual 10,000 would be held in the JVM and in Python at once.
BATCH_ROWS = 1000


def thin_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands texts to Python tasks BATCH_ROWS rows at a time."""
    df.sparkSession.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return df


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table once to the shared folder and read it from there, so that its lineage ends.

    While it is written, Python tasks get ``batch_rows`` rows at a time; the session's setting holds again afterwards.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small. Count a staged table only."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by position, so that no name clashes with a helper's, and their own names."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), df.columns


def positioned(df: DataFrame, *used: str) -> tuple[DataFrame, ...]:
    """``df`` with its columns renamed by position, and the new names of the columns ``used``."""
    plain, names = numbered(df)
    return plain, *(plain.columns[names.index(c)] for c in used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A row's key beside its id, so that repeated ids with other texts stay apart."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """Global running totals in the order of ``order``, with no sort in one task.

    Adds ``<key>_before`` for each key of ``sums``: its total over all earlier rows.
    Rows are dealt out by ranges; the totals of the ranges, one row each, are
    added up, and a window inside each range does the rest.
    """
    dealt = staged(
        df.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(*[F.asc_nulls_last(o) for o in order])
        .withColumn("_range", F.spark_partition_id()), name)
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}_all") for k in sums]).select(
        "_range", *[F.coalesce(F.sum(f"_{k}_all").over(upto), F.lit(0)).alias(f"_{k}_base") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*[F.asc_nulls_last(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(base, "_range").select(
        *df.columns,
        *[(F.col(f"_{k}_base") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).alias(f"{k}_before") for k in sums])
