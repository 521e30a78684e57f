"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks. All chunks of a slice are hashed together, as one matrix
product of their bytes with the powers of a base modulo the prime 2**61 - 1, and the hash
of a whole text is put together from its chunks: ``H(ab) = H(a) * base**len(b) + H(b)``. So parts
of a huge document may be hashed in any place and order. Texts with equal fingerprint and
length are then compared chunk by chunk with one text of their group before they count as copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import positioned, small, staged, thin_batches

PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
#: Bytes hashed as one chunk, and bytes compared at a time.
CHUNK = 4096
PIECE = 256 << 10
_PART = 21  # bits; a byte times a part, summed over a chunk, is exact in a double


def _powers(n: int) -> np.ndarray:
    """Rows: base**(n-1) ... base**0, each cut into three parts of 21 bits, as doubles."""
    p, out = 1, np.zeros((n, 3))
    for i in range(n - 1, -1, -1):
        out[i] = [(p >> (_PART * j)) & ((1 << _PART) - 1) for j in range(3)]
        p = p * BASE % PRIME
    return out


def chunk_hashes(data: np.ndarray, table: np.ndarray) -> list[int]:
    """Hashes of the chunks of ``data``; the first chunk is the short one."""
    size = len(table)
    pad = -len(data) % size
    rows = np.concatenate([np.zeros(pad, np.uint8), data]).reshape(-1, size)  # leading zeros add nothing
    out = []
    for block in np.array_split(rows, max(1, len(rows) // 256)):
        low, mid, high = (block.astype(np.float64) @ table).astype(np.int64).T.tolist()
        out += [(a + (b << _PART) + (c << 2 * _PART)) % PRIME for a, b, c in zip(low, mid, high)]
    return out


def combine(left: int, right: int, right_length: int) -> int:
    """Hash of two stretches put together."""
    return (left * pow(BASE, right_length, PRIME) + right) % PRIME


def fingerprint(data: np.ndarray, table: np.ndarray) -> int:
    shift, out = pow(BASE, len(table), PRIME), 0
    for h in chunk_hashes(data, table):
        out = (out * shift + h) % PRIME
    return out


def fingerprint_column(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Fingerprints of all texts of a column: the chunks of short texts share matrix products."""
    data, at = col.flat(texts)
    lengths, size = np.diff(at), len(table)
    chunks = -(-lengths // size)
    first = np.concatenate([[0], np.cumsum(chunks)])
    rows = np.zeros((int(first[-1]), size), np.uint8)
    # right-aligned: the bytes of a text end where its last chunk ends
    where = np.repeat(first[1:] * size - at[1:], lengths) + np.arange(len(data))
    rows.reshape(-1)[where] = data
    out, shift = np.zeros(len(lengths), np.int64), pow(BASE, size, PRIME)
    hashes: list[int] = []
    for a in range(0, len(rows), 256):
        low, mid, high = (rows[a:a + 256].astype(np.float64) @ table).astype(np.int64).T.tolist()
        hashes += [(x + (y << _PART) + (z << 2 * _PART)) % PRIME for x, y, z in zip(low, mid, high)]
    edges = first.tolist()
    for i in range(len(lengths)):
        h = 0
        for x in hashes[edges[i]:edges[i + 1]]:
            h = (h * shift + x) % PRIME
        out[i] = h
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, row_key, length, fingerprint) of each row; null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _powers(chunk)
        for batch in col.slices(batches, "body"):
            body = batch.column(2)
            lengths = np.diff(col.flat(body)[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths), pa.array(fingerprint_column(body, table))],
                ["doc_id", "row_key", "length", "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _row_key(doc_id, text), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    return thin_batches(rows).mapInArrow(run, "doc_id bigint, row_key bigint, length bigint, fingerprint bigint")


def _row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit(""))).alias("row_key")


def fingerprints_of_parts(parts: DataFrame, key: list[str], number: str = "part", body: str = "body") -> DataFrame:
    """Fingerprints of documents that are stored in parts: each part is hashed where it lies, and the hashes are shifted and added.

    Only (key, number, length, hash) of a part is shuffled. ``key`` columns, length, fingerprint come back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _powers(CHUNK)
        for batch in col.slices(batches, "_body"):
            body_ = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(col.flat(body_)[1])), pa.array(fingerprint_column(body_, table))],
                [*batch.schema.names[:-1], "_length", "_hash"])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, after = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_hash", "_after"))
            term = [a * pow(BASE, n, PRIME) % PRIME for a, n in zip(h, after)]
            yield batch.set_column(batch.schema.get_field_index("_hash"), "_hash", pa.array(term, pa.int64()))

    rows = parts.select(*key, F.col(number).alias("_number"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("_body"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    hashed = rows.mapInArrow(run, f"{head}, _length bigint, _hash bigint")
    later = Window.partitionBy(*key).orderBy("_number").rowsBetween(1, Window.unboundedFollowing)
    placed = hashed.withColumn("_after", F.coalesce(F.sum("_length").over(later), F.lit(0)))
    terms = placed.mapInArrow(shifted, f"{head}, _length bigint, _hash bigint, _after bigint")
    total = F.pmod(F.sum(F.col("_hash").cast("decimal(38,0)")), F.lit(PRIME).cast("decimal(38,0)"))
    return terms.groupBy(*key).agg(F.sum("_length").alias("length"), total.cast("bigint").alias("fingerprint"))


def _pieces(rows: DataFrame, piece: int) -> DataFrame:
    """(..., number, piece) rows of the column ``body``, one piece at a time."""
    names = [c for c in rows.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.slices(batches, "body"):
            data, at = col.flat(batch.column(batch.schema.get_field_index("body")))
            raw = data.tobytes()
            for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                cuts = list(range(a, max(b, a + 1), piece))
                row = [pa.array([batch.column(batch.schema.get_field_index(c))[i].as_py()] * len(cuts), batch.schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*row, pa.array(range(len(cuts)), pa.int64()), pa.array([raw[x:min(x + piece, b)] for x in cuts], pa.binary())],
                    [*names, "number", "piece"])

    def merged(batches):  # short texts give batches of one row; send them on together
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > col.SLICE_BYTES or len(held) >= 2000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")
    return rows.mapInArrow(merged, f"{head}, number bigint, piece binary")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, row_key, keep_id, group_size, text_sha256) for each row.

    Null texts count as empty, and all empty texts are equal. Of equal texts the largest
    doc_id stays, null ids are smallest. Repeated rows count as often as they occur. An empty table gives no row.
    """
    prints = staged(fingerprints(docs, doc_id, text, chunk), "fingerprints")
    by = ["fingerprint", "length"]
    shared = prints.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row_key")).alias("top")).where("n > 1")
    shared = staged(shared.select(*by, "n", F.col("top.doc_id").alias("top_id"), F.col("top.row_key").alias("top_key")), "shared")
    members = staged(prints.join(small(shared), by).select("doc_id", "row_key", *by, "top_id", "top_key").distinct(), "members")

    bodies = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _row_key(doc_id, text), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    wanted = small(members.select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), *by, (F.col("row_key") == F.col("top_key")).alias("is_top")).distinct())
    held = bodies.join(wanted, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_key") == F.col("m_key"))).drop("m_id", "m_key")
    cut = staged(_pieces(held, piece), "pieces")
    # staged, so that both sides of the join are plain exchanges, whose hot partitions can be split
    top = staged(cut.where("is_top").select(*by, "number", F.col("piece").alias("top_piece")).dropDuplicates([*by, "number"]), "tops")
    rest = cut.where("not is_top")
    differs = rest.join(top, [*by, "number"], "left").where(~F.col("piece").eqNullSafe(F.col("top_piece")))
    other = staged(differs.select(*by).distinct(), "collisions")

    sha = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _row_key(doc_id, text), F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256).alias("text_sha256"))
    if other.isEmpty():
        groups = shared.select(*by, F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"))
        keyed = prints.join(small(groups), by, "left").select("doc_id", "row_key", F.col("keep_id"), "group_size", F.col("group_size").isNotNull().alias("is_shared"))
    else:
        # two texts share a fingerprint: within these few groups the texts themselves decide
        odd = held.join(F.broadcast(other) if other.count() < 1000 else other, by, "left_semi")
        split = odd.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        exact = odd.join(split, "body").select("doc_id", "row_key", "keep_id", "group_size", F.lit(True).alias("is_shared"))
        groups = shared.join(other, by, "left_anti").select(*by, F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"))
        usual = prints.join(other, by, "left_anti").join(groups, by, "left").select(
            "doc_id", "row_key", "keep_id", "group_size", F.col("group_size").isNotNull().alias("is_shared"))
        keyed = usual.unionByName(exact)
    found = staged(keyed.where("is_shared").select("doc_id", "row_key", "keep_id", "group_size").distinct(), "copies")
    found = small(found.select(F.col("doc_id").alias("f_id"), F.col("row_key").alias("f_key"), "keep_id", "group_size"))
    return sha.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("row_key") == F.col("f_key")), "left").select(
        "doc_id", "row_key", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest doc_id.

    If that row itself is repeated, one of the repeats stays. Null texts are empty ones; a null id is smaller than all others. Columns may have any names.
    """
    names = docs.columns
    docs, doc_id, text = positioned(docs, doc_id, text)
    key = F.xxhash64(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumn("_key", key)
    copies = staged(classes(docs, doc_id, text).where("group_size > 1").groupBy("doc_id", "row_key", "keep_id").count(), "decided")
    top = F.col("keep_id").eqNullSafe(F.col("doc_id"))

    def match(rows: DataFrame, how: str) -> DataFrame:
        rows = small(rows.select(F.col("doc_id").alias("_g_id"), F.col("row_key").alias("_g_key")))
        return keyed.join(rows, F.col(doc_id).cast("bigint").eqNullSafe(F.col("_g_id")) & (F.col("_key") == F.col("_g_key")), how)

    repeated = copies.where(top & (F.col("count") > 1))
    if repeated.isEmpty():
        return match(copies.where(~top), "left_anti").drop("_key").toDF(*names)
    once = match(repeated, "left_semi").dropDuplicates([doc_id, "_key"])
    return match(copies.where(~top | (F.col("count") > 1)), "left_anti").unionByName(once).drop("_key").toDF(*names)
