"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

All stages but the last return the columns of documents, whatever they are called. An empty table gives an empty one. Texts are
worked on whole, however long; a null text is an empty one, and a null id is an id like others (the last, or the first, in its order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackflux.llm import exact, mixing, neardup, packing, quality
from trackflux.llm.frames import staged, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null, empty and short texts fail; rows are judged one by one, so repeats share their fate."""
    return quality.keep(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; if that row is repeated, one of the repeats."""
    return exact.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; texts without words all stay."""
    return neardup.dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it; a null source is a source of its own, repeated rows count one by one."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; each row is packed, repeated ones too."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules), ("exact_dedup", copies), ("near_dedup", near_copies), ("mix_sources", mixture), ("pack", sequences),
]

#: Near-duplicate groups and packing plans have no SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
