"""Packing token sequences by non-negative least squares on the histogram of lengths.

Documents become ids; whole windows of them fill a sequence each, and what is left of a document is
its rest. Rests are binned by length. All combinations of up to three bins that fill a window exactly are enumerated,
the numbers of repeats that fit the histogram best are solved for, rounded down and made feasible, and what they leave is packed
greedily, still on the histogram. Only then do single rests meet the plan, by their running number within
their bin: no task or driver ever holds more than counts.

Where the greedy step finds no rest that fits a gap of CUT ids or more, it cuts a longer one at a multiple of CUT.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import small, staged, thin_batches

WINDOW = 1024
GRAIN = 4
CUT = 64
END_ID = 0
#: The rank form of the vocabulary byte_bpe_50k.json: the same ids, four times as fast.
RANKS = "byte_bpe_50k.tiktoken"

Piece = tuple[str, int, int]  # ("whole", bin, 0), ("head", bin, cut) or ("tail", bin, cut)


def encoder(path: str) -> tiktoken.Encoding:
    """The encoder of this process; kept with the library, since functions of this package are sent anew with each task."""
    held = tiktoken.__dict__.setdefault("_kept_encoders", {})
    if path not in held:
        held[path] = _encoder(path)
    return held[path]


def _encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the vocabulary beside its rank form, which itself has none."""
    whole = Path(path).with_suffix(".json")
    if not whole.exists():
        return {}
    added = json.loads(whole.read_text(encoding="utf-8"))["added_tokens"]
    if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{whole.name} has added tokens that are not matched as they stand")
    return {a["content"]: a["id"] for a in added}


def token_ids(text: str | None, enc: tiktoken.Encoding) -> np.ndarray:
    """Ids of a text (added tokens are matched in it), then END_ID, as little-endian 32-bit numbers."""
    ids = enc.encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


# ---- the plan, from counts alone ----

def combinations(bins: int) -> np.ndarray:
    """All multisets of one to three bins that sum up to ``bins``; 0 pads."""
    out = [(bins, 0, 0)]
    out += [(a, bins - a, 0) for a in range((bins + 1) // 2, bins)]
    for a in range(1, bins - 1):
        out += [(a, b, bins - a - b) for b in range(1, min(a, bins - a - 1) + 1) if bins - a - b <= b]
    return np.array(out)


def least_squares(combos: np.ndarray, hist: np.ndarray, steps: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring their pieces nearest to ``hist`` (accelerated projected gradient)."""
    n = len(hist)
    put = lambda x: np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), n)
    scale = max(1.0, hist.max())
    goal = hist / scale
    goal[0] = 0
    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue by power iteration
        w = put(v)
        w[0] = 0
        v = w[combos].sum(1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        r = put(y) - goal
        r[0] = 0
        new = np.maximum(0, y - r[combos].sum(1) / (1.02 * top))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x * scale


def plan(hist: dict[int, int], bins: int, cut: int) -> list[tuple[list[Piece], int]]:
    """Patterns of pieces with their repeats; all rests of the histogram (bin: count) are placed exactly once.

    ``cut`` is in bins; 0 forbids cuts.
    """
    have = np.zeros(bins + 1)
    for b, n in hist.items():
        have[b] = n
    out: list[tuple[list[Piece], int]] = []
    left = have.astype(np.int64)
    if left.sum():
        combos = combinations(bins)
        x = least_squares(combos, have)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            need = Counter(int(b) for b in combos[i] if b)
            times = min(int(x[i]), *(int(left[b]) // m for b, m in need.items()))
            if times > 0:
                out.append(([("whole", b, 0) for b in sorted(need.elements(), reverse=True)], times))
                for b, m in need.items():
                    left[b] -= m * times
    pool: Counter = Counter({("whole", b, 0): int(left[b]) for b in range(1, bins + 1) if left[b]})
    size = lambda p: {"whole": p[1], "head": p[2], "tail": p[1] - p[2]}[p[0]]
    while pool:
        order = sorted(pool, key=lambda p: (-size(p), p))
        pattern, used, gap, made = [order[0]], Counter([order[0]]), bins - size(order[0]), []
        k = 0
        while gap and k < len(order):
            p = order[k]
            if size(p) <= gap and used[p] < pool[p]:
                pattern.append(p)
                used[p] += 1
                gap -= size(p)
            else:
                k += 1
        if cut and gap >= cut:
            c = gap // cut * cut
            whole = next((p for p in order if p[0] == "whole" and p[1] > c and used[p] < pool[p]), None)
            if whole:
                pattern.append(("head", whole[1], c))
                used[whole] += 1
                made.append(("tail", whole[1], c))
        times = min(pool[p] // m for p, m in used.items())
        out.append((pattern, times))
        for p, m in used.items():
            pool[p] -= m * times
            if not pool[p]:
                del pool[p]
        for p in made:
            pool[p] += times
    return out


class Places:
    """Where the r-th rest of a bin goes: ranges of running numbers, looked up by bisection."""

    def __init__(self, patterns: list[tuple[list[Piece], int]], first_sequence: int):
        rows: dict[tuple, list[tuple]] = defaultdict(list)
        taken: Counter = Counter()
        base = first_sequence
        for pieces, times in patterns:
            for slot, (kind, b, c) in enumerate(pieces):
                key = ("tail", b, c) if kind == "tail" else ("rest", b, 0)
                tail = -1
                if kind == "head":
                    tail = taken["made", b, c]
                    taken["made", b, c] += times
                rows[key].append((taken[key], base, slot, c if kind == "head" else 0, tail))
                taken[key] += times
            base += times
        self.end = base
        self.rows = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in rows.items()}

    def of(self, key: tuple, rank: int) -> tuple[int, int, int, int]:
        """(sequence, slot, cut, running number of the tail)."""
        low, base, slot, cut, tail = self.rows[key]
        i = int(np.searchsorted(low, rank, "right")) - 1
        at = rank - int(low[i])
        return int(base[i]) + at, int(slot[i]), int(cut[i]), int(tail[i]) + at


# ---- the jobs ----

LENGTHS = ("doc_id bigint, doc_tokens bigint, task bigint, n_full bigint, full_rank bigint, full_crc array<bigint>, rest bigint, "
           "bin bigint, rest_rank bigint, rest_crc bigint, head_crc array<bigint>, tail_crc array<bigint>")


def lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, grain: int = GRAIN, cut: int = CUT, ranks: str | None = None) -> DataFrame:
    """One narrow row per document: counts, checksums of its windows and its rest, and running numbers within the task."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen, full = Counter(), 0
        names = [f.split()[0] for f in LENGTHS.split(", ")]
        kinds = [pa.list_(pa.int64()) if "array" in f else pa.int64() for f in LENGTHS.split(", ")]
        for batch in col.slices(batches, "text"):
            rows = []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(body.as_py(), enc)
                n_full, rest = divmod(len(ids), window)
                bin_ = -(-rest // grain)
                last = ids[n_full * window:]
                cuts = range(cut, rest, cut)
                rows.append((i, len(ids), task, n_full, full, [zlib.crc32(ids[k * window:(k + 1) * window]) for k in range(n_full)], rest,
                             bin_, seen[bin_], zlib.crc32(last), [zlib.crc32(last[:c]) for c in cuts], [zlib.crc32(last[c:]) for c in cuts]))
                full += n_full
                seen[bin_] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return thin_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, LENGTHS)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, grain: int = GRAIN, cut: int = CUT, ranks: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, slot, offset, sequence_tokens) of each piece.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. An empty table gives no piece.
    """
    if window % grain or cut % grain or window <= 0:
        raise ValueError("window and cut must be multiples of grain")
    rows = staged(lengths(docs, doc_id, text, window, grain, cut, ranks), "lengths")
    counts = rows.where("bin > 0").groupBy("bin", "task").agg(F.count("*").alias("n")).unionByName(
        rows.groupBy("task").agg(F.sum("n_full").alias("n")).select(F.lit(-1).cast("bigint").alias("bin"), "task", "n"))
    earlier = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "bases")
    hist = {r["bin"]: r["n"] for r in bases.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    n_full = hist.pop(-1, 0)
    places = Places(plan(hist, window // grain, cut // grain), n_full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                i, n = r["doc_id"], r["doc_tokens"]
                first = (r["full_before"] or 0) + r["full_rank"]
                out += [(i, k * window, window, crc, n, first + k, 0) for k, crc in enumerate(r["full_crc"])]
                if r["rest"]:
                    at = r["n_full"] * window
                    b = r["bin"]
                    seq, slot, c, tail = places.of(("rest", b, 0), r["rest_before"] + r["rest_rank"])
                    if c:
                        j = c * grain // cut - 1
                        out.append((i, at, c * grain, r["head_crc"][j], n, seq, slot))
                        seq, slot, _, _ = places.of(("tail", b, c), tail)
                        out.append((i, at + c * grain, r["rest"] - c * grain, r["tail_crc"][j], n, seq, slot))
                    else:
                        out.append((i, at, r["rest"], r["rest_crc"], n, seq, slot))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)

    rest = small(bases.where("bin > 0").select(F.col("bin").alias("b_bin"), F.col("task").alias("b_task"), F.col("before").alias("rest_before")))
    whole = small(bases.where("bin = -1").select(F.col("task").alias("f_task"), F.col("before").alias("full_before")))
    numbered = rows.join(rest, (F.col("bin") == F.col("b_bin")) & (F.col("task") == F.col("b_task")), "left").join(
        whole, F.col("task") == F.col("f_task"), "left").drop("b_bin", "b_task", "f_task")
    pieces = numbered.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    return pieces.select("*", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
                         F.sum("length").over(Window.partitionBy("sequence_id")).alias("sequence_tokens"))
