"""Windows of a text that also occur in an earlier text: what word-wise and byte-wise removal share.

Which window is repeated is decided by the operator's own method, which gets stretches of text (fragments) in the order of document and
place. What is here brings together all that could be equal, in pieces of bounded size:

* In a slice of documents, the stretches whose windows occur twice in it go to the method at once. What it finds is settled; the first copy of
  each window is not, and stands for the slice from then on.
* In each window the grams of ``gram`` symbols are ranked by a hash; the least one is the window's anchor. Neighbouring windows with one
  anchor form a cluster (about one per ``(window - gram) / 2`` symbols). Equal windows have equal anchors, so clusters that are not settled are
  dealt by anchor, as hashes. One that is equal, as a whole, to an earlier one of another slice is a source's copy and settled by its hash; those
  that differ, but agree in more than half of what lies around the anchor, are open.
* Of open clusters the symbols are sent to the block of their anchor, and the method decides there.

No anchor may crowd a task. Of each anchor a task sends at most ``ANCHOR_ROWS`` clusters, one more that says so, and takes all others as
open; a block that a count shows to be crowded is cut again by the contents of single windows, after the method has worked on each slice of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import small, staged, thin_batches

#: Clusters and fragments that a block holds on average; with more fragments than CROWDED it is cut again.
BLOCK_CLUSTERS = 150_000
BLOCK_FRAGMENTS = 4_000
CROWDED = 10_000
#: Bytes of text and symbols of fragments that are worked on together.
SLICE_BYTES = 1 << 20
PART_SYMBOLS = 1 << 19
#: Clusters that a task sends to the block of one anchor. They are counted in a table by hash: an anchor that shares its
#: place there may be taken for a crowded one, which costs symbols sent and changes no result.
ANCHOR_ROWS = 16
COUNTERS, TOLD = 1 << 24, 1 << 16
LAST = (1 << 63) - 1  # a null id comes after all others

CLUSTER = np.dtype([("anchor", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("lo", "<i4"), ("size", "<u1"), ("left", "<u2"), ("right", "<u2"), ("crowd", "<u1")])
RUN = np.dtype([("doc", "<i8"), ("key", "<i8"), ("lo", "<i8"), ("size", "<i4"), ("anchor", "<u8"), ("open", "<u1")])

#: Of fragments sorted by (document, key, place): the documents, where each fragment's symbols begin, and all symbols. Gives
#: the places of the repeated windows, rising.
Decide = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Kind:
    """What is compared: windows of ``window`` symbols, found by anchors of ``gram``."""

    window: int
    gram: int
    symbols: Callable[[pa.Array, col.Powers], tuple[np.ndarray, np.ndarray]]  # values of all symbols, where each text's begin
    per_byte: float  # symbols in a byte, for the number of blocks
    width: int  # bytes in which a symbol travels
    store: Callable[[np.ndarray], np.ndarray]  # how symbols travel
    read: Callable[[np.ndarray], np.ndarray]  # and how their bytes are read again
    same_document: bool  # an earlier place in the same document counts


def clusters(values: np.ndarray, at: np.ndarray, kind: Kind, powers: col.Powers) -> dict[str, np.ndarray]:
    """Clusters of all windows: text, first window ``lo`` and last ``hi`` (absolute), anchor, and hashes."""
    size, gram = kind.window, kind.gram
    start = col.windows(at, size)
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in ("text", "lo", "hi")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "whole", "left", "right")}
    sums = col.prefix(values, powers)
    place = np.arange(len(values) - gram + 1)
    grams = col.stretch(sums, place, place + gram, powers)
    low = np.uint64(32)
    rank = (grams >> low << low) | place.astype(np.uint64)
    span, have = size - gram + 1, 1
    while 2 * have <= span:
        rank = np.minimum(rank[:len(rank) - have], rank[have:])
        have *= 2
    least = np.minimum(rank[start], rank[start + span - have])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(at, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
    p, text = anchor[first], text[first]
    half = (size - gram + 1) // 2
    begin, end = at[text], at[text + 1]
    # what is cut off at the text's edge gets a hash that nothing else has: no window reaches that far
    alone = col.mix(p.astype(np.uint64) + np.uint64(12345)) ^ grams[p]
    left = np.where(p - half >= begin, col.stretch(sums, np.maximum(p - half, 0), p + gram, powers), alone)
    right = np.where(p + gram + half <= end, col.stretch(sums, p, np.minimum(p + gram + half, len(values)), powers), alone)
    return {"text": text, "lo": lo, "hi": hi, "anchor": grams[p], "whole": col.stretch(sums, lo, hi + size, powers), "left": left, "right": right}


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit(""))).alias("key"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _first(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The first value of each run, for all its items."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else values


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of stretches of ``n`` places from ``begin``, one stretch after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def runs(places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring places in one fragment joined: the fragment, the first place and the number of places of each run."""
    of = np.searchsorted(at, places, "right") - 1
    first = np.flatnonzero(_changes(places - np.arange(len(places)), of))
    return of[first], places[first], np.diff(np.append(first, len(places)))


def _pack(rows: np.ndarray) -> bytes:
    """Column by column, so that what repeats is compressed."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def _unpack(data: list[bytes], kind: np.dtype) -> np.ndarray:
    out, to = np.empty(sum(map(len, data)) // kind.itemsize, kind), 0
    for x in data:
        n, at = len(x) // kind.itemsize, 0
        for c in kind.names:
            step = kind[c].itemsize * n
            out[c][to:to + n] = np.frombuffer(x[at:at + step], kind[c])
            at += step
        to += n
    return out


def _in_parts(kind: Kind, decide: Decide, doc: np.ndarray, values: np.ndarray, of: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of windows that the method finds repeated among stretches of ``n`` windows from ``begin``, in the texts ``of``.

    It works on PART_SYMBOLS symbols at a time, of which a longer stretch is cut; what repeats between two parts is left to the blocks.
    """
    pieces = -(-n // PART_SYMBOLS)
    skip = _ranges(np.zeros_like(begin), pieces) * PART_SYMBOLS
    of, begin, n = np.repeat(of, pieces), np.repeat(begin, pieces) + skip, np.minimum(np.repeat(n, pieces) - skip, PART_SYMBOLS)
    length = n + kind.window - 1
    edges = np.append(np.flatnonzero(_changes(np.cumsum(length) // PART_SYMBOLS)), len(n)).tolist()
    out = [np.zeros(0, np.int64)]
    for a, b in zip(edges, edges[1:]):
        at = np.concatenate([[0], np.cumsum(length[a:b])])
        hit = decide(doc[of[a:b]], at, values[_ranges(begin[a:b], length[a:b])])
        out.append(begin[a:b][f := np.searchsorted(at, hit, "right") - 1] + hit - at[f])
    return np.concatenate(out)


def _sorted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a slice by (document, key), each once."""
    doc, key = (batch.column(k).to_numpy() for k in (0, 1))
    order = np.lexsort((key, doc))
    return batch.take(pa.array(order[_changes(doc[order], key[order])]))


def _dealt(bodies: DataFrame, kind: Kind, decide: Decide, blocks: int) -> DataFrame:
    """(block, direct, payload): clusters by block of their anchor; runs that are settled, or open without asking, by slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counters, told = col.Powers(), np.zeros(COUNTERS, np.uint8), np.zeros(TOLD, np.uint64)
        for batch in col.slices(batches, "body", SLICE_BYTES):
            batch = _sorted(batch)
            doc, key = (batch.column(k).to_numpy() for k in (0, 1))
            values, at = kind.symbols(batch.column(2), powers)
            c = clusters(values, at, kind, powers)
            if not len(c["lo"]):
                continue
            size = c["hi"] - c["lo"] + 1
            often, _ = col.repeats(c["anchor"])
            place = _ranges(c["lo"][often], size[often])
            twice, _ = col.repeats(col.stretch(col.prefix(values, powers), place, place + kind.window, powers))
            of, begin, n = runs(place[twice], at)
            done = _in_parts(kind, decide, doc, values, of, begin, n)
            of, begin, n = runs(done, at)
            direct = np.zeros(len(n), RUN)
            for name, v in (("doc", doc[of]), ("key", key[of]), ("lo", begin - at[of]), ("size", n)):
                direct[name] = v

            settled = np.zeros(len(values) + 1, np.int64)
            settled[done + 1] = 1
            settled = np.cumsum(settled)
            left = np.flatnonzero(settled[c["hi"] + 1] - settled[c["lo"]] < size)
            rows = np.zeros(len(left), CLUSTER)
            text = c["text"][left]
            for name, v in (("anchor", c["anchor"][left]), ("whole", c["whole"][left]), ("doc", doc[text]), ("key", key[text]), ("lo", c["lo"][left] - at[text]), ("size", size[left]),
                            ("left", c["left"][left] & np.uint64(0xFFFF)), ("right", c["right"][left] & np.uint64(0xFFFF))):
                rows[name] = v
            slot = (rows["anchor"] & np.uint64(COUNTERS - 1)).astype(np.int64)
            rows = rows[order := np.argsort(slot, kind="stable")]
            slot = slot[order]
            first = np.flatnonzero(_changes(slot))
            times = np.diff(np.append(first, len(slot)))
            number = counters[slot] + np.arange(len(slot)) - np.repeat(first, times)
            counters[slot[first]] = np.minimum(counters[slot[first]] + times, 255)
            beyond, rows = rows[number >= ANCHOR_ROWS], rows[number < ANCHOR_ROWS]
            anchor, at_first = np.unique(beyond["anchor"], return_index=True)
            slot = (anchor >> np.uint64(40)) % np.uint64(TOLD)
            new = told[slot] != anchor
            told[slot[new]] = anchor[new]
            witness = beyond[at_first[new]]
            witness["crowd"] = 1
            rows = np.concatenate([rows, witness])
            more = np.zeros(len(beyond), RUN)
            for name in ("doc", "key", "lo", "size", "anchor"):
                more[name] = beyond[name]
            more["open"] = 1
            direct = np.concatenate([direct, more])

            block = ((rows["anchor"] >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64)
            rows = rows[order := np.argsort(block, kind="stable")]
            block = block[order]
            edges = np.append(np.flatnonzero(_changes(block)), len(block)).tolist()
            out = [(int(block[a]), False, _pack(rows[a:b])) for a, b in zip(edges, edges[1:])]
            if len(direct):
                out.append((blocks + int(key.sum()) % blocks, True, _pack(direct)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.binary()))], ["block", "direct", "payload"])

    return bodies.mapInArrow(run, "block bigint, direct boolean, payload binary")


FOUND = "doc bigint, key bigint, lo bigint, size int, anchor bigint, open boolean"


def _judged(dealt: DataFrame, kind: Kind) -> DataFrame:
    """FOUND rows: settled runs and clusters, and open clusters."""
    def run(group):
        direct = group.column("direct").to_numpy()
        payload = group.column("payload").to_pylist()
        out = _unpack([x for x, d in zip(payload, direct) if d], RUN)
        rows = _unpack([x for x, d in zip(payload, direct) if not d], CLUSTER)
        rows = rows[np.argsort(rows["anchor"], kind="stable")]
        first = np.flatnonzero(_changes(rows["anchor"]))
        rows = rows[np.repeat(times := np.diff(np.append(first, len(rows))), times) > 1]  # who is alone has no partner
        rows = rows[np.lexsort((rows["lo"], rows["key"], rows["doc"], rows["anchor"]))]
        same = _changes(*(rows[c] for c in ("anchor", "doc", "key", "lo")))
        number = np.cumsum(_changes(rows["anchor"])) - 1
        rows["crowd"] = np.bincount(number, rows["crowd"])[number] > 0 if len(rows) else 0
        rows = rows[same]  # repeated rows are one
        rows = rows[np.argsort(rows["whole"], kind="stable")]
        rows = rows[np.argsort(rows["anchor"], kind="stable")]  # by anchor, whole and place
        new = _changes(rows["anchor"], rows["whole"])
        again = ~new if kind.same_document else rows["doc"] > _first(new, rows["doc"])
        rest = rows[~again]
        wanted = rest["crowd"] > 0
        for side in ("left", "right"):
            order = np.lexsort((rest["whole"], rest[side], rest["anchor"]))
            r = rest[order]
            new = _changes(r["anchor"], r[side])
            number = np.cumsum(new) - 1
            wanted[order] |= np.bincount(number, r["whole"] != _first(new, r["whole"]))[number] > 0 if len(r) else False
        settled, rest = rows[again], rest[wanted]
        rows = np.concatenate([settled, rest])
        get = lambda c: np.concatenate([out[c], rows[c]])
        return pa.table({"doc": get("doc"), "key": get("key"), "lo": get("lo"), "size": get("size"), "anchor": get("anchor").view(np.int64),
                         "open": np.concatenate([out["open"] > 0, np.arange(len(rows)) >= len(settled)])})

    return dealt.groupBy("block").applyInArrow(run, FOUND)


def _binary(kind: Kind, values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """The symbols of stretches, one binary value each."""
    at = np.concatenate([[0], np.cumsum(length)]) * kind.width
    data = np.ascontiguousarray(kind.store(values[_ranges(begin, length)]))
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


FRAGMENT = "block bigint, doc bigint, key bigint, lo bigint, size int, values binary"


def _fragments(bodies: DataFrame, open_: DataFrame, kind: Kind, decide: Decide, blocks: int) -> DataFrame:
    """FRAGMENT rows: the symbols of the open clusters (doc, key, lo, size, block, cut) by block.

    Where ``cut`` is set, the method works on the slice first, and each window that is left goes to the block of its
    contents; what is settled so has no symbols.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = col.Powers()
        for batch in col.slices(batches, "body", SLICE_BYTES):
            batch = _sorted(batch)
            doc, key = (batch.column(k).to_numpy() for k in (0, 1))
            values, at = kind.symbols(batch.column(2), powers)
            lists = batch.column(3)
            text = np.repeat(np.arange(len(doc)), lists.value_lengths().to_numpy())
            places = lists.flatten()
            begin, size, block, cut = (places.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "size", "block", "cut"))
            begin = begin + at[text]
            order = np.argsort(begin, kind="stable")
            text, begin, size, block, cut = (x[order].astype(np.int64) for x in (text, begin, size, block, cut))
            out = [(block[(plain := cut == 0)], text[plain], begin[plain], size[plain])]
            if cut.any():
                again = np.flatnonzero(cut)
                done = _in_parts(kind, decide, doc, values, text[again], begin[again], size[again])
                of, first, n = runs(done, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), blocks + int(key.sum()) % blocks)), pa.array(doc[of]), pa.array(key[of]), pa.array(first - at[of]),
                                                  pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.binary())], ["block", "doc", "key", "lo", "size", "values"])
                single = np.setdiff1d(_ranges(begin[again], size[again]), done)
                content = col.stretch(col.prefix(values, powers), single, single + kind.window, powers)
                out.append((blocks + (content % np.uint64(blocks)).astype(np.int64), np.searchsorted(at, single, "right") - 1, single, np.ones(len(single), np.int64)))
            for block, text, begin, size in out:
                length = size + kind.window - 1
                edges = np.append(np.flatnonzero(_changes(np.cumsum(length) // (1 << 20))), len(length)).tolist()
                for a, b in zip(edges, edges[1:]):
                    of = text[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(block[a:b]), pa.array(doc[of]), pa.array(key[of]), pa.array(begin[a:b] - at[of]), pa.array(size[a:b].astype(np.int32)),
                                                      _binary(kind, values, begin[a:b], length[a:b])], ["block", "doc", "key", "lo", "size", "values"])

    lists = staged(open_.groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "size", "block", "cut")).alias("places")), "open-places")
    some = small(lists.select("doc", "key"))
    return bodies.join(some, ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"]).join(lists, ["doc", "key"]).select("doc", "key", "body", "places").mapInArrow(run, FRAGMENT)


def _decided(fragments: DataFrame, kind: Kind, decide: Decide) -> DataFrame:
    """(doc, key, lo, size) of the runs of repeated windows, by block; those without symbols are settled already."""
    def run(group):
        bare = pc.is_null(group.column("values"))
        given, rows = group.filter(bare), group.filter(pc.invert(bare))
        doc, key, lo = (rows.column(c).to_numpy() for c in ("doc", "key", "lo"))
        order = np.lexsort((lo, key, doc))
        doc, key, lo = doc[order], key[order], lo[order]
        data, at = col.flat(rows.column("values").combine_chunks().take(pa.array(order)))
        at = at // kind.width
        of, begin, n = runs(decide(doc, at, kind.read(data)), at) if len(order) else (order, order, order)
        get = lambda c, v: pa.chunked_array([*given.column(c).chunks, pa.array(v, given.schema.field(c).type)])
        return pa.table({"doc": get("doc", doc[of]), "key": get("key", key[of]), "lo": get("lo", lo[of] + begin - at[of]), "size": get("size", n.astype(np.int32))})

    return fragments.groupBy("block").applyInArrow(run, "doc bigint, key bigint, lo bigint, size int")


def spans(docs: DataFrame, kind: Kind, decide: Decide, doc_id: str = "doc_id", text: str = "text", block_clusters: int = BLOCK_CLUSTERS, crowded: int = CROWDED) -> DataFrame:
    """(doc, key, lo, size) of all runs of repeated windows."""
    bodies = thin_batches(_bodies(docs, doc_id, text))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, round(total * kind.per_byte * 2 / (kind.window - kind.gram + 2) / block_clusters))
    found = staged(_judged(_dealt(bodies, kind, decide, blocks), kind), "clusters")
    settled = found.where("not open").select("doc", "key", "lo", "size")
    open_ = found.where("open")
    blocks = max(1, round(open_.count() / min(BLOCK_FRAGMENTS, max(1, crowded))))
    open_ = open_.withColumn("block", F.pmod("anchor", F.lit(blocks)))
    full = staged(open_.groupBy("block").count().where(F.col("count") > crowded).select("block", F.lit(True).alias("full")), "crowded")
    open_ = open_.join(small(full), "block", "left").withColumn("cut", F.coalesce("full", F.lit(False)))
    return settled.unionByName(_decided(_fragments(bodies, open_, kind, decide, blocks), kind, decide))


def with_spans(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (columns named by position) with ``_spans``: the (lo, size) of each row, null if there are none."""
    lists = found.groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "size")).alias("_spans")).withColumnsRenamed({"doc": "_run_doc", "key": "_run_key"})
    keyed = docs.withColumn("_doc", F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST))).withColumn(
        "_key", F.xxhash64(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(lists, (F.col("_doc") == F.col("_run_doc")) & (F.col("_key") == F.col("_run_key")), "left").drop("_run_doc", "_run_key", "_doc", "_key")


def removed(span_lists: list, at: np.ndarray, window: int) -> np.ndarray:
    """Which symbols lie in a repeated window."""
    edge = np.zeros(int(at[-1]) + 1, np.int32)
    for begin, places in zip(at[:-1].tolist(), span_lists):
        for x in places or ():
            edge[begin + x["lo"]] += 1
            edge[begin + x["lo"] + x["size"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0
