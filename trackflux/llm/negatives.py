"""Hard negatives by rotated one-bit codes.

A row's vector is rotated, and of each component only the sign is kept as a code. The code is a direction; the row also stores how far
its vector reaches along it (the alignment), and the norm of what is left. What is left is coded again, ``LEVELS`` times in all, so that the
vector is a sum of aligned codes and a small rest. An anchor is kept as bit planes of its rotated components. Bit counts of planes
and codes give its inner product with the sum of codes; by Cauchy-Schwarz the true product differs by at most

    |rounding of the anchor| * |sum of codes| + |anchor| * |rest|.

Rows whose interval cannot reach the rows that are wanted are left out; what survives is scored in whole numbers. No bound is
an estimate, so results are exact.

Rows and anchors are packed into blocks. Every block of anchors meets every block of rows once, in a join on the row block's
number; each meeting gives the best of its rows for each of its anchors, and the best of these are ranked. The join shuffles and sorts both
sides, whatever their sizes look like: the planner measures the anchors before they are repeated for each block of rows, and a broadcast of what
looks small would bring every repeat to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflux.llm.frames import staged

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256
LEVELS, PLANES, SEED = 4, 6, 13
#: Rows of a block, anchors of a block, and pairs that are worked on at a time.
ROWS, ANCHORS, PAIRS = 8192, 1024, 1 << 19
#: Largest size of a component after scaling: products of 2**11 of them stay inside 64 bits.
LARGEST = 1 << 26


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(rotated: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes [rows, levels, words], alignments [rows, levels], norms of the sum of codes and of the rest."""
    n, width = rotated.shape
    rest = rotated.copy()
    codes, along = np.zeros((n, levels, width // 64), np.uint64), np.zeros((n, levels))
    for k in range(levels):
        up = rest >= 0
        codes[:, k] = _packed(up)
        along[:, k] = np.abs(rest).sum(1) / np.sqrt(width)
        rest -= np.where(up, 1.0, -1.0) * (along[:, k] / np.sqrt(width))[:, None]
    return codes, along, np.linalg.norm(rotated - rest, axis=1), np.linalg.norm(rest, axis=1)


def planes(rotated: np.ndarray, count: int = PLANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes [anchors, count, words] of the components, their low ends and steps, sums of the rounded components, norms of the rounding."""
    low = rotated.min(1)
    step = (rotated.max(1) - low) / ((1 << count) - 1)
    step[step == 0] = 1.0
    units = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.int64)
    rounded = low[:, None] + step[:, None] * units
    bits = np.stack([_packed((units >> k) & 1 == 1) for k in range(count)], axis=1)
    return bits, low, step, rounded.sum(1), np.linalg.norm(rotated - rounded, axis=1)


def intervals(anchors: np.ndarray, rows: np.ndarray, turn: np.ndarray, codes=None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products of ``anchors`` and ``rows``, from bit counts."""
    width = turn.shape[0]
    y = _wide(anchors, width) @ turn.T
    words, along, reach, rest = codes or encode(_wide(rows, width) @ turn.T)
    bits, low, step, total, rounding = planes(y)
    estimate = np.zeros((len(anchors), len(rows)))
    for level in range(words.shape[1]):
        ones = np.bitwise_count(words[:, level]).sum(-1, dtype=np.int64)
        hits = np.zeros(estimate.shape, np.int32)
        for k in range(bits.shape[1]):
            for w in range(words.shape[2]):
                hits += np.bitwise_count(bits[:, k, w, None] & words[None, :, level, w]).astype(np.int32) << k
        signed = 2 * (low[:, None] * ones + step[:, None] * hits) - total[:, None]
        estimate += signed * (along[:, level] / np.sqrt(width))
    norm = np.linalg.norm(y, axis=1)
    far = rounding[:, None] * reach + norm[:, None] * rest
    far += 1e-9 * (1 + norm[:, None] * (reach + rest))  # floating point
    return estimate - far, estimate + far


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point where nothing can pass 53 bits."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    if int(np.abs(anchors).max()) * int(np.abs(rows).max()) * anchors.shape[1] < 1 << 53:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return anchors @ rows.T


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _best(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``scores``, places of its first ``k`` that are ``ok``: higher scores first, ties by smaller id."""
    for i in np.flatnonzero(ok.any(1)).tolist():
        at = np.flatnonzero(ok[i])
        if len(at) > k:
            s = scores[i, at]
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        yield i, at[np.lexsort((ids[at], -scores[i, at]))][:k]


def near(ids, labels, block, own_ids, own_labels, own, turn, k, codes) -> list[tuple[int, int, int]]:
    """(anchor, row, score): for each anchor the first ``k`` other rows of its label in a block."""
    lo, hi = intervals(own, block, turn, codes)
    ok = (own_labels[:, None] == labels) & (own_ids[:, None] != ids)
    ok &= hi >= _kth(np.where(ok, lo, -np.inf), k)[:, None]
    some = np.flatnonzero(ok.any(0))
    scores = products(own, block[some])
    return [(int(own_ids[i]), int(ids[some[j]]), int(scores[i, j])) for i, at in _best(scores, ids[some], ok[:, some], k) for j in at.tolist()]


def hard(ids, labels, block, own_ids, own_labels, own, turn, k, codes, bounds, low, high) -> list[tuple[int, int, int, int, int]]:
    """(anchor, positive, positive's score, row, score): for each positive the first ``k`` rows of other labels in its range in a block."""
    lo, hi = intervals(own, block, turn, codes)
    other = own_labels[:, None] != labels
    out = []
    for positives in bounds:  # the j-th positive of every anchor: ids, scores, and whether there is one
        pid, ps, there = positives
        least, most = low * ps[:, None] / 100 - 1e-6, high * ps[:, None] / 100 + 1e-6
        ok = other & there[:, None] & (hi >= least) & (lo <= most)
        sure = ok & (lo >= least + 2e-6) & (hi <= most - 2e-6)
        ok &= hi >= _kth(np.where(sure, lo, -np.inf), k)[:, None]
        some = np.flatnonzero(ok.any(0))
        scores = products(own, block[some])
        ok = ok[:, some] & (100 * scores >= low * ps[:, None]) & (100 * scores <= high * ps[:, None])
        out += [(int(own_ids[i]), int(pid[i]), int(ps[i]), int(ids[some[j]]), int(scores[i, j])) for i, at in _best(scores, ids[some], ok, k) for j in at.tolist()]
    return out


def _usable(rows: DataFrame, is_anchor: Column, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v, anchor) of the rows that take part, scaled to whole numbers, one row per id."""
    x = F.col(f"`{vector}`").cast("array<double>")
    picked = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    fine = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) * scale < LARGEST))  # NaN is larger than all
    scaled = picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine).select(
        "id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"), "anchor")
    rows = staged(scaled, "vectors")
    twice = staged(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if twice.isEmpty():
        return rows
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    return rows.join(twice, "id", "left_anti").unionByName(one)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column.to_numpy()):
        out[i, :len(x)] = x
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them, as blocks travel; ``_long`` widens them again."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _blocks(rows: DataFrame, size: int, pack: Callable[[pa.Table], tuple], name: str) -> tuple[DataFrame, int]:
    """(block, payload) and the number of blocks, of about ``size`` rows each; ids are different, so their hashes deal them out evenly."""
    count = max(1, -(-rows.count() // size))

    def run(group: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "payload": pa.array([pickle.dumps(pack(group), 5)], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return staged(dealt.groupBy("block").applyInArrow(run, "block int, payload binary"), name), count


def _meet(anchors: DataFrame, blocks: DataFrame, count: int, search: Callable, schema: str, name: str) -> DataFrame:
    """What ``search`` finds where each block of anchors meets each block of rows. Python gets one such pair at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for mine, theirs in zip(batch.column(0), batch.column(1)):
                own, block = pickle.loads(mine.as_buffer()), pickle.loads(theirs.as_buffer())
                step = max(1, PAIRS // max(1, len(block[0])))
                found = [f for a in range(0, len(own[0]), step) for f in search(tuple(x[a:a + step] for x in own), block)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    dealt = anchors.select(F.col("payload").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"))
    pairs = dealt.join(blocks.hint("merge"), "block").select("own", "payload")
    return staged(pairs.mapInArrow(run, schema), name, batch_rows=1)


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, levels: int = LEVELS, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows where ``is_anchor`` holds.

    An anchor's positives are its first ``positives`` other rows of the same label; for each of them, the first ``negatives`` rows of other labels come back whose score
    is between ``low`` and ``high`` percent of the positive's. Higher scores come first, ties by smaller id.

    Rows without id, label (a whole number) or vector, and rows with a null, not finite or huge component (``LARGEST``) take no part. Of rows with one id the one
    with the smallest (label, vector) counts. Vectors of different lengths are filled up with zeros. Other columns of ``rows`` are not read, whatever they are called.
    An anchor without positives, a positive without negatives, and an empty table give no rows.
    """
    usable = _usable(rows, is_anchor, vec_id, vector, label, scale)
    width = -(-max(1, usable.agg(F.max(F.size("v"))).first()[0] or 0) // 64) * 64
    turn = rotation(width)

    def pack_rows(t: pa.Table) -> tuple:
        v = _matrix(t.column("v"), width)
        return t.column("id").to_numpy(), t.column("label").to_numpy(), _narrow(v), *encode(v @ turn.T, levels)

    def pack_anchors(t: pa.Table) -> tuple:
        lists = [_matrix(t.column(c), positives) for c in ("ids", "scores") if c in t.schema.names]
        number = [np.array([len(x) for x in t.column("ids").to_numpy()])] if lists else []
        return t.column("id").to_numpy(), t.column("label").to_numpy(), _narrow(_matrix(t.column("v"), width)), *lists, *number

    def first(own, block):
        return near(*block[:2], _long(block[2]), *own[:2], _long(own[2]), turn, positives, block[3:])

    def second(own, block):
        ids, labels, v, pid, score, number = own
        bounds = [(pid[:, j], score[:, j], number > j) for j in range(positives)]
        return hard(*block[:2], _long(block[2]), ids, labels, _long(v), turn, negatives, block[3:], bounds, low, high)

    blocks, count = _blocks(usable.drop("anchor"), block_rows, pack_rows, "row-blocks")
    anchors = staged(usable.where("anchor").drop("anchor"), "anchors")
    own, _ = _blocks(anchors, block_anchors, pack_anchors, "anchor-blocks")
    found = _meet(own, blocks, count, first, "anchor bigint, row bigint, score bigint", "near")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "row")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    lists = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "score"))).alias("p")).select(
        F.col("anchor").alias("id"), F.col("p.row").alias("ids"), F.col("p.score").alias("scores"))
    own, _ = _blocks(staged(anchors.join(lists, "id"), "anchors-with-positives"), block_anchors, pack_anchors, "anchor-blocks")
    found = _meet(own, blocks, count, second, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", "hard")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in SQL.
SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND score * 100 <= {HIGH} * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
