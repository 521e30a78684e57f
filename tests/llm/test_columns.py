"""Columns of a user that are called like helpers of the operators pass through every operator that returns rows."""

import collections

import pytest
from pyspark.sql import functions as F

from trackflux.llm import exact, mixing, neardup, pii, quality, substrings, suffixes, urls

EXTRA = ["key", "_key", "doc", "_doc", "_id", "_g_id", "row_key", "n_rows", "_spans", "_c0", "_c1", "lo", "size", "_copy", "_sum", "part", "rank", "pii_", "block", "keep_id", "group_size", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(1, words, "a"), (2, words, "a"), (3, words.replace("w5 ", "v5 "), "b"), (4, " ".join(f"u{k}" for k in range(90)), None), (4, " ".join(f"u{k}" for k in range(90)), None), (5, None, "b"), (None, "x y z", "a")]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return base.select(*[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in EXTRA], "doc_id", "text", "source", F.lit("kept").alias("mark"))


def intact(df):
    rows = df.select(*EXTRA, "doc_id").collect()
    for r in rows:
        assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for c in EXTRA)
    return collections.Counter(r["doc_id"] for r in rows)


def test_exact(docs):
    out = exact.dedup(docs)
    assert out.columns == docs.columns and intact(out) == {2: 1, 3: 1, 4: 1, 5: 1, None: 1}


def test_near(docs):
    out = neardup.dedup(docs)
    assert out.columns == docs.columns and intact(out) == {1: 1, 4: 1, 5: 1, None: 1}


def test_mix(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns and set(intact(out)) <= {1, 2, 3, 4, 5, None}


def test_quality(docs):
    assert quality.keep(docs).columns == docs.columns and intact(quality.keep(docs)) == {1: 1, 2: 1, 3: 1, 4: 2}


@pytest.mark.parametrize("remove", [substrings.remove, suffixes.remove])
def test_removal(docs, remove):
    out = remove(docs)
    assert out.columns[:len(EXTRA) + 3] == [c for c in docs.columns if c != "text"] and intact(out) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, None: 1}
    gone = {r["doc_id"]: r["n_removed"] for r in out.where("doc_id in (1, 2, 3)").collect()}
    assert gone[1] == 0 and gone[2] > 0 and gone[3] > 0


def test_pii_and_redaction(docs):
    assert intact(pii.find(docs)) == intact(pii.redact(docs)) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, None: 1}


def test_urls(docs):
    pages = docs.withColumnRenamed("text", "url")
    assert intact(urls.judge(pages)) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, None: 1}


def test_empty(docs):
    for f in (exact.dedup, neardup.dedup, mixing.mix, substrings.remove, suffixes.remove, pii.find, quality.keep):
        assert f(docs.limit(0)).count() == 0
