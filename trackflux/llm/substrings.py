"""Word-wise substring dedup by relative Lempel-Ziv factors.

A block's reference is made of the fragments of all documents in it: their windows are indexed by hash, and their suffixes are sorted, so that the
longest source of a place is a neighbour in that order. Each fragment is factored greedily against the documents with smaller ids: at the next
window that the index knows, the longest source is taken, the factor follows it as far as it goes, and the next one begins behind it. Windows inside a
factor are repeated; those across its end are looked up again. Factors shorter than a window prove nothing and are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackflux.llm import columns as col
from trackflux.llm import repeats, suffixes
from trackflux.llm.frames import positioned

WINDOW, GRAM = 13, 6
#: Words of a factor at most; a longer one goes on as the next.
FACTOR = 256


def _words(texts: pa.Array, powers: col.Powers) -> tuple[np.ndarray, np.ndarray]:
    data, at = col.flat(texts)
    start, end, word_at = col.words(data, at)
    return col.stretch(col.prefix(col.byte_values(data), powers), start, end, powers), word_at


WORDS = repeats.Kind(WINDOW, GRAM, _words, 1 / 6, width=8, store=lambda v: v, read=lambda b: b.view(np.uint64), same_document=False)


def factors(doc: np.ndarray, at: np.ndarray, values: np.ndarray, window: int = WINDOW, most: int = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of fragments sorted by document: where they begin, their lengths (``window`` to ``most``), and all places that the index knows.

    A place is known if its window starts in a document with a smaller id.
    """
    start, powers, number = col.windows(at, window), col.Powers(), np.cumsum(repeats._changes(doc))[col.owner(at)]
    content = col.stretch(col.prefix(values, powers), start, start + window, powers)
    order = np.argsort(content, kind="stable")  # within equal contents by document
    new = repeats._changes(content[order])
    least = np.empty(len(order), np.int64)
    least[order] = number[start[order[np.flatnonzero(new)]]][np.cumsum(new) - 1] if len(order) else 0
    known = start[least < number[start]]
    if not len(known):
        return known, known, known
    _, ids = np.unique(values, return_inverse=True)
    most = min(most, int(np.diff(at).max()))
    lengths, ranks = suffixes.prefix_ranks(ids, at, most, first=1)
    end = np.repeat(at[1:], np.diff(at))
    order = start[np.argsort(ranks[-1][start], kind="stable")]
    near = np.full((2, len(values)), -1, np.int64)
    for side, other in zip(near, suffixes.smaller(number[order])):
        side[order] = np.where(other >= 0, order[other], -1)
    of, first = np.unique(np.searchsorted(at, known, "right") - 1, return_index=True)
    cursor, stop, found = known[first], at[of + 1], []
    while len(cursor):
        length = np.zeros(len(cursor), np.int64)
        for side in near:
            have = side[cursor] >= 0
            length[have] = np.maximum(length[have], suffixes.common(cursor[have], side[cursor[have]], lengths, ranks, ids, end, most))
        found.append((cursor, length))
        again = np.searchsorted(known, cursor + length)
        cursor = known[np.minimum(again, len(known) - 1)]
        go = (again < len(known)) & (cursor < stop)
        cursor, stop = cursor[go], stop[go]
    begin, length = (np.concatenate(x) for x in zip(*found))
    return begin, length, known


def parse(doc: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The places of repeated windows: those inside factors, and those across their ends that the index knows."""
    begin, length, known = factors(doc, at, values)
    edge = np.zeros(len(values) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length - WINDOW + 1, -1)
    hit = np.cumsum(edge[:-1]) > 0
    across = (begin + length)[:, None] - np.arange(1, WINDOW)
    hit[np.intersect1d(across, known)] = True
    return np.flatnonzero(hit)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text`` (kept words joined by one space), n_words, n_removed, kept_sha256 and without ``text``.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id. Null and short texts lose nothing. A null
    id is larger than all others. Rows with equal ids do not count against each other. Columns of the names above give way; all others pass, whatever they are
    called. An empty table gives no row.
    """
    mine = ("n_words", "n_removed", "kept_sha256", "kept_text")
    if doc_id in mine or text in mine:
        raise ValueError("id and text may not be called like a column that is added")
    names = [c for c in docs.columns if c not in mine]
    plain, doc_id, text = positioned(docs.select(*names), doc_id, text)
    rows = repeats.with_spans(plain, repeats.spans(plain, WORDS, parse, doc_id, text), doc_id, text)
    others = [c for c in plain.columns if c != text]
    names.pop(plain.columns.index(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.slices(batches, text):
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            data, at = col.flat(get(text))
            start, end, word_at = col.words(data, at)
            gone = repeats.removed(get("_spans").to_pylist(), word_at, WINDOW)
            raw, texts = data.tobytes(), []
            for a, b in zip(word_at.tolist(), word_at[1:].tolist()):
                texts.append(b" ".join(raw[s:e] for s, e, g in zip(start[a:b].tolist(), end[a:b].tolist(), gone[a:b].tolist()) if not g))
            yield pa.RecordBatch.from_arrays(
                [*(get(c) for c in others), pa.array(np.diff(word_at).astype(np.int64)), pa.array(col.per_text(gone, word_at)),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                [*others, *mine])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in others)
    return rows.mapInArrow(run, head + "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string").toDF(*names, *mine)


_WORD = r"[^\x20\x09-\x0D]+"
#: The same in SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
lead AS (
  SELECT doc_id, i, hash(word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))}) AS win, lead(word, {WINDOW - 1}) OVER o AS last
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM lead WHERE last IS NOT NULL) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, range(0, {WINDOW}) s(k)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept_text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
