"""Near-duplicate documents by SuperMinHash.

Every shingle of a document gets a random permutation of the signature's slots: in its j-th place
it offers the value j + (a random fraction) to slot perm(j). A slot keeps its smallest offer. Since offers of place j
are below those of place j + 1, a document is done as soon as all its slots are filled: early stopping, here for all
documents of a slice together, place by place. Slots are banded; documents with an equal band are candidates.

Documents with equal sets are one class first. In a band's bucket, every class is held against one of them. Where a bucket
still holds several components, its classes go to blocks that compare the full sets of all of them that are not connected yet; of the links
found, a block gives back a spanning forest. Every link is confirmed on the full shingle sets of the two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import positioned, small, staged, thin_batches
from trackflux.llm.graph import Forest, components

WORDS, PERCENT = 5, 75
SLOTS, ROWS = 128, 4
#: Two blocks of so many classes, or shingles, are compared by a task.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
EMPTY = np.uint32(0xFFFFFFFF)


def shingles(texts: pa.Array, powers: col.Powers, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and where each text's begin and end."""
    data, at = col.flat(texts)
    data = col.lower(data)
    start, end, word_at = col.words(data, at)
    word = col.stretch(col.prefix(col.byte_values(data), powers), start, end, powers)
    gram = col.prefix(word, powers)
    counts = np.diff(word_at)
    full = col.windows(word_at, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    doc = np.concatenate([np.searchsorted(word_at, full, "right") - 1, short])
    hashes = np.concatenate([col.stretch(gram, full, full + n, powers), col.stretch(gram, word_at[short], word_at[short + 1], powers)])
    salt = col.mix(np.arange(len(at), dtype=np.uint64) + np.uint64(99))
    _, first = np.unique(hashes ^ salt[doc], return_index=True)
    first = first[np.argsort(doc[first], kind="stable")]
    return hashes[first], np.searchsorted(doc[first], np.arange(len(at)))


def signatures(hashes: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` (a power of two) values for each text; a text without shingles keeps EMPTY everywhere."""
    n, mask = len(at) - 1, np.uint64(slots - 1)
    out = np.full(n * slots, EMPTY, np.uint32)
    doc = col.owner(at)
    odd1, odd2 = ((hashes >> np.uint64(k)) & mask | np.uint64(1) for k in (1, 10))
    add0, add1, add2 = ((hashes >> np.uint64(k)) & mask for k in (20, 30, 40))
    live = np.arange(len(hashes))
    for j in range(slots):
        # the shingle's permutation, applied to j: steps that can all be undone, with keys from its hash
        x = ((np.uint64(j) ^ add0[live]) * odd1[live] + add1[live]) & mask
        x ^= x >> np.uint64(3)
        x = (x * odd2[live] + add2[live]) & mask
        x ^= x >> np.uint64(4)
        fraction = col.mix(hashes[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)
        np.minimum.at(out, doc[live] * slots + x.astype(np.int64), (np.uint64(j << 24) + fraction).astype(np.uint32))
        open_ = (out.reshape(n, slots) == EMPTY).any(1)
        live = live[open_[doc[live]]]
        if not len(live):
            break
    return out.reshape(n, slots)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    n, slots = sig.shape
    parts = sig.reshape(n, slots // rows, rows).astype(np.uint64)
    key = np.arange(slots // rows, dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(rows):
        key = col.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


SKETCH = "doc_id bigint, row_key bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SKETCH of each row: two 64-bit sums identify its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, names = col.Powers(), [f.split()[0] for f in SKETCH.split(", ")]
        for batch in col.slices(batches, "body"):
            hashes, at = shingles(batch.column(2), powers)
            n = len(at) - 1
            keys = bands(signatures(hashes, at))
            sums = []
            for step in (1, 3):
                total = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(col.mix(hashes * np.uint64(step) + np.uint64(step)), out=total[1:])
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            flat = pa.array(keys.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * keys.shape[1], pa.int32()), flat)], names)

    return thin_batches(_bodies(docs, doc_id, text)).mapInArrow(run, SKETCH)


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit(""))).alias("row_key"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of (u, v) pairs of classes those whose full sets are similar enough; ``texts`` is (node, body)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = col.Powers()
        for batch in col.slices(batches, "both_bytes_u"):
            (a, a_at), (b, b_at) = (shingles(batch.column(k), powers) for k in (2, 3))
            salt = col.mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(5))
            pair = np.concatenate([col.owner(a_at), col.owner(b_at)])
            keys = np.concatenate([a, b]) ^ salt[pair]
            order = np.argsort(keys, kind="stable")
            shared = np.flatnonzero(keys[order][1:] == keys[order][:-1])
            common = np.bincount(pair[order[shared]], minlength=batch.num_rows)
            union = np.diff(a_at) + np.diff(b_at) - common
            yield batch.select([0, 1]).filter(pa.array(100 * common >= percent * union))

    one, two = (texts.select(F.col("node").alias(n), F.col("body").alias(f"both_bytes_{n}")) for n in "uv")
    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "both_bytes_u", "both_bytes_v")
    return joined.mapInArrow(run, "u bigint, v bigint")


def _links(texts: pa.Array, node: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the links between ``left`` and ``right`` rows that are not in one component yet.

    Row by row, the shingles of one text are marked and counted in all texts of the other side.
    """
    hashes, at = shingles(texts, col.Powers())
    _, ids = np.unique(hashes, return_inverse=True)
    sizes = np.diff(at)
    names, component = np.unique(comp, return_inverse=True)
    largest = np.bincount(component).argmax()
    forest = Forest()
    marked = np.zeros(ids.max() + 1 if len(ids) else 1, np.int32)

    def compare(rows: np.ndarray, others: np.ndarray) -> None:
        if not len(rows) or not len(others):
            return
        entries = np.concatenate([ids[at[k]:at[k + 1]] for k in others])
        begin = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        for a in rows:
            mine = ids[at[a]:at[a + 1]]
            marked[mine] = 1
            common = np.add.reduceat(marked[entries], begin)
            marked[mine] = 0
            for b in others[100 * common >= percent * (sizes[a] + sizes[others] - common)]:
                if component[a] != component[b]:
                    forest.join(int(names[component[a]]), int(names[component[b]]))

    # the largest component's own pairs are skipped
    compare(left[component[left] != largest], right)
    compare(right[component[right] != largest], left[component[left] == largest])
    return forest.edges()


def _rest(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) links between components: all classes of a group are compared, in pairs of blocks. ``open_``: group, blocks, node, comp."""
    def run(key, table):
        node, comp, side = (table.column(c).to_numpy() for c in ("node", "comp", "side"))
        low, high = key[1].as_py(), key[2].as_py()
        found = _links(table.column("body").combine_chunks(), node, comp, np.flatnonzero(side == low), np.flatnonzero(side == high))
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    dealt = open_.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "comp", "body")
    return dealt.groupBy("group", "low", "high").applyInArrow(run, "u bigint, v bigint")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, kept) for each row.

    A text with one to four words is one shingle; a null or empty one has none and is linked with nothing. The
    component of a row is the smallest doc_id that can be reached; rows without id are linked, but name no component
    (null if there is no other row in it) and are never kept unless alone. An empty table gives no row.
    """
    rows = staged(sketches(docs, doc_id, text), "sketches")
    sets = ["set_a", "set_b", "n_shingles"]
    some = rows.where("n_shingles > 0")
    class_of = staged(some.groupBy(*sets).agg(F.min("row_key").alias("node")), "classes")
    nodes = staged(some.select("row_key", "bands").join(class_of.select(F.col("node").alias("row_key")), "row_key", "left_semi").dropDuplicates(["row_key"])
                   .withColumnRenamed("row_key", "node"), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    shared = staged(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "buckets")
    members = staged(keyed.join(small(shared), "key"), "members")

    wanted = staged(members.select("node").distinct(), "candidates")
    texts = staged(_bodies(docs, doc_id, text).join(small(wanted.withColumnRenamed("node", "row_key")), "row_key", "left_semi")
                   .dropDuplicates(["row_key"]).select(F.col("row_key").alias("node"), "body"), "candidate-texts")
    first = members.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    links = staged(_confirmed(first, texts), "links-1")
    roots = components(links)
    placed = members.join(small(roots), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = staged(placed.join(small(staged(apart, "apart")), "key", "left_semi").select("node", "pivot", "comp").distinct(), "open")
    if not open_.isEmpty():
        # buckets with a class in common are one group, so that a text goes to one place
        group_of = components(open_.select(F.col("node").alias("u"), F.col("pivot").alias("v")))
        grouped = open_.select("node", "comp").distinct().join(small(group_of), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
        grouped = staged(grouped, "groups")
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        sizes = grouped.join(class_of.select("node", "n_shingles"), "node").groupBy("group").agg(blocks.alias("blocks"))
        more = staged(_rest(grouped.join(small(staged(sizes, "group-sizes")), "group"), texts), "links-2")
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    placed = rows.select("doc_id", "row_key", *sets).join(class_of, sets, "left").join(small(roots), "node", "left")
    placed = staged(placed.select("doc_id", "row_key", "n_shingles", F.coalesce("root", "node", "row_key").alias("comp")), "placed")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_rows")).where("n_rows > 1").drop("n_rows")
    least = small(staged(least, "components"))
    alone = F.col("component_id").isNull()
    return placed.join(least, "comp", "left").select(
        "doc_id", "row_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest doc_id; of repeats of that row, one.

    Texts without words are no copies of each other and all stay. Columns may have any names.
    """
    names = docs.columns
    docs, doc_id, text = positioned(docs, doc_id, text)
    found = staged(groups(docs, doc_id, text).select("doc_id", "row_key", "kept", "n_shingles"), "near")
    key = F.xxhash64(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumns({"_id": F.col(doc_id).cast("bigint"), "_key": key})

    def match(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        """By id and key, so that a row whose key another row has by chance is not taken for it."""
        rows = rows.select(F.col("doc_id").alias("_g_id"), F.col("row_key").alias("_g_key"))
        return of.join(small(rows), F.col("_id").eqNullSafe(F.col("_g_id")) & (F.col("_key") == F.col("_g_key")), how)

    left = match(staged(found.where("not kept").select("doc_id", "row_key").distinct(), "near-dropped"), keyed, "left_anti")
    repeated = staged(found.where("kept and n_shingles > 0").groupBy("doc_id", "row_key").count().where("count > 1"), "near-repeated")
    if not repeated.isEmpty():
        left = match(repeated, left, "left_anti").unionByName(match(repeated, left, "left_semi").dropDuplicates(["_id", "_key"]))
    return left.drop("_id", "_key").toDF(*names)
