"""Byte-wise substring dedup by longest-previous-factor arrays.

A block's fragments, in the order of document and place, are one text. Its suffixes are sorted by doubling prefixes; in
suffix order the nearest suffix above and below that starts earlier in the text (previous and next smaller position) share with a
suffix the longest prefix that any earlier one does. Where that reaches a window, the window is a later copy and goes; the first copy stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackflux.llm import columns as col
from trackflux.llm import repeats
from trackflux.llm.frames import positioned

WINDOW, GRAM = 100, 40


def _symbols(texts: pa.Array, powers: col.Powers) -> tuple[np.ndarray, np.ndarray]:
    data, at = col.flat(texts)
    return col.byte_values(data), at


BYTES = repeats.Kind(WINDOW, GRAM, _symbols, 1.0, width=1, store=lambda v: (v - np.uint64(1)).astype(np.uint8), read=col.byte_values, same_document=True)


def prefix_ranks(values: np.ndarray, at: np.ndarray, upto: int, first: int = 7) -> tuple[list[int], list[np.ndarray]]:
    """Lengths h from ``first`` and, for each, the rank of every place by the h symbols that follow it inside its fragment."""
    n = len(values)
    end = np.repeat(at[1:], np.diff(at))
    place = np.arange(n)
    rank = np.zeros(n, np.int64)
    for k in range(first):  # seven symbols of at most 257 values fit into 63 bits, and one of any
        nxt = np.minimum(place + k, n - 1)
        rank = rank * 257 + np.where(place + k < end, values[nxt].astype(np.int64) + 1, 0)
    lengths, ranks, h = [], [], first
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.ones(n, bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        lengths.append(h)
        ranks.append(rank)
        if h >= upto:
            return lengths, ranks
        follow = np.where(place + h < end, rank[np.minimum(place + h, n - 1)], 0)
        rank, h = rank * (n + 1) + follow, 2 * h


def common(i: np.ndarray, j: np.ndarray, lengths: list[int], ranks: list[np.ndarray], values: np.ndarray, end: np.ndarray, upto: int) -> np.ndarray:
    """How many symbols the suffixes at i and j share, at least up to ``upto``."""
    i, j, out, n = i.copy(), j.copy(), np.zeros(len(i), np.int64), len(values)
    stop_i, stop_j = end[i], end[j]
    for h, rank in [*zip(reversed(lengths), reversed(ranks))]:
        ok = (i + h <= stop_i) & (j + h <= stop_j)
        ok[ok] = rank[i[ok]] == rank[j[ok]]
        i[ok] += h
        j[ok] += h
        out[ok] += h
    for _ in range(lengths[0]):
        ok = (i < stop_i) & (j < stop_j)
        ok[ok] = values[np.minimum(i[ok], n - 1)] == values[np.minimum(j[ok], n - 1)]
        i[ok] += 1
        j[ok] += 1
        out[ok] += 1
        if not ok.any():
            break
    return np.minimum(out, upto)


def smaller(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, the index of the nearest earlier item and of the nearest later one with a smaller value; -1 if none."""
    def before(x: np.ndarray) -> np.ndarray:
        up = np.arange(len(x)) - 1
        todo = np.flatnonzero(up >= 0)
        while len(todo):
            todo = todo[x[up[todo]] >= x[todo]]
            up[todo] = up[up[todo]]
            todo = todo[up[todo] >= 0]
        return up

    back = before(places[::-1])[::-1]
    return before(places), np.where(back >= 0, len(places) - 1 - back, -1)


def longest_previous(values: np.ndarray, at: np.ndarray, starts: np.ndarray, upto: int = WINDOW) -> np.ndarray:
    """For each of ``starts`` (rising), the longest stretch of up to ``upto`` symbols that also begins at an earlier one of them."""
    lengths, ranks = prefix_ranks(values, at, upto)
    end = np.repeat(at[1:], np.diff(at))
    order = starts[np.argsort(ranks[-1][starts], kind="stable")]
    out = np.zeros(len(values), np.int64)
    for near in smaller(order):
        have = near >= 0
        out[order[have]] = np.maximum(out[order[have]], common(order[have], order[near[have]], lengths, ranks, values, end, upto))
    return out[starts]


def sift(doc: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The places of the windows of a block's fragments that also occur earlier."""
    starts = col.windows(at, WINDOW)
    return starts[longest_previous(values.astype(np.int64) - 1, at, starts) >= WINDOW]


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_bytes``, n_bytes, n_removed, n_spans, kept_sha256 and without ``text``.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document with a smaller id, or before it in the same document.
    Null and short texts lose nothing. A null id is larger than all others. Repeats of a row do not count against each other; other texts with
    the same id follow each other in the order of their hashes. Columns of the names above give way; all others pass, whatever they are
    called. An empty table gives no row.
    """
    mine = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
    if doc_id in mine or text in mine:
        raise ValueError("id and text may not be called like a column that is added")
    names = [c for c in docs.columns if c not in mine]
    plain, doc_id, text = positioned(docs.select(*names), doc_id, text)
    rows = repeats.with_spans(plain, repeats.spans(plain, BYTES, sift, doc_id, text), doc_id, text)
    others = [c for c in plain.columns if c != text]
    names.pop(plain.columns.index(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.slices(batches, text):
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            data, at = col.flat(get(text))
            gone = repeats.removed(get("_spans").to_pylist(), at, WINDOW)
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            first = at[:-1][at[:-1] < at[1:]]
            starts[first] = gone[first]
            left = data[~gone].tobytes()
            cut = np.concatenate([[0], np.cumsum(~gone)])[at].tolist()
            texts = [left[a:b] for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(get(c) for c in others), pa.array(np.diff(at)), pa.array(col.per_text(gone, at)), pa.array(col.per_text(starts, at)),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary())], [*others, *mine])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in others)
    return rows.mapInArrow(run, head + "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary").toDF(*names, *mine)
