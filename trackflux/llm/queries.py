"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackflux.catalog.registry import query
from trackflux.llm import collocations, exact, mixing, negatives, neardup, packing, pii, quality, scoring, substrings, suffixes, urls, warc
from trackflux.llm.frames import table


@query("op1_warc_revisits", warc.SQL)
def op1(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_mix_sources", mixing.SQL)
def op2(spark, sf_dir):
    return mixing.copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op5_quality_rules", quality.SQL)
def op5(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op6_url_filter", urls.SQL)
def op6(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


@query("op7_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op7(spark, sf_dir):
    return exact.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


@query("op3_pack_sequences")
def op3(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")


@query("op4_near_dedup")
def op4(spark, sf_dir):
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_substring_dedup", substrings.SQL)
def op8(spark, sf_dir):
    return substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return suffixes.remove(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_bytes")


@query("op9_lm_scores")
def op9(spark, sf_dir):
    return scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_pii")
def op11(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_collocations", collocations.SQL)
def op12(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


@query("op13_hard_negatives", negatives.SQL)
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    odd = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(odd, F.col("vec_id") % 100 == 0)
