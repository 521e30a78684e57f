"""Scores of texts by a log-bilinear language model, beside a smoothed unigram.

Words are counted over all training documents. The most frequent words are classes of their own; the
others share classes by their last bytes, and within such a class a word has its smoothed unigram share. The model gives a class w after the classes v1, v2
the score  (c1*r(v1) + c2*r(v2)) . q(w) + b(w). It is learned by noise-contrastive estimation: each task goes once over its training documents
from the same start, and the tasks' parameters are averaged, weighted by tokens; the two halves of the documents make two rounds.

With the tables A1 = (c1*r) q' and A2 = (c2*r) q' + b, the sums over all classes for all pairs of
preceding classes are one matrix product, exp(A1) exp(A2)', so every token's probability is exactly normalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import small, staged, thin_batches

#: Frequent words with a class of their own, classes of the others, and the end of a text.
OWN, SHARED = 703, 320
CLASSES = OWN + SHARED + 1
END = CLASSES - 1
BEFORE = CLASSES  # what precedes a text
#: Words whose counts every task gets; the counts of all others are joined.
KNOWN_WORDS = 1 << 18
SIZE, NOISE, BATCH, RATE = 32, 8, 16384, 0.25
ROUNDS = 2
SMOOTH = 0.1
#: A task's word counts are sent on when it holds so many.
COUNT_ROWS = 2_000_000


def tokens(texts: pa.Array, powers: col.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), their shared classes, and where each text's begin."""
    data, at = col.flat(texts)
    data = col.lower(data)
    start, end, word_at = col.words(data, at)
    hashes = col.stretch(col.prefix(col.byte_values(data), powers), start, end, powers)
    tail = np.zeros(len(start), np.uint64)
    for k in (1, 2, 3):
        at_ = end - k
        tail = tail * np.uint64(257) + np.where(at_ >= start, data[np.maximum(at_, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(data) else tail
    return hashes, (col.mix(tail) % np.uint64(SHARED)).astype(np.int64), word_at


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    remainder = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(10))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (remainder == 0).alias("held_out"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, shared, n) over all training documents; ``word`` is the 64-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = col.Powers()

        def merged(parts):
            w, s, n = (np.concatenate(x) for x in zip(*parts))
            keys, first, inverse = np.unique(w, return_index=True, return_inverse=True)
            return keys, s[first], np.bincount(inverse, n).astype(np.int64)

        def out(parts):
            w, s, n = merged(parts)
            for a in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a:a + 100_000]) for x in (w.view(np.int64), s, n)], ["word", "shared", "n"])

        held, size = [], 0
        for batch in col.slices(batches, "body"):
            hashes, shared, _ = tokens(batch.column(batch.schema.get_field_index("body")), powers)
            keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
            held.append((keys, shared[first], n.astype(np.float64)))
            size += len(keys)
            if size > COUNT_ROWS:
                held = [tuple(x if i < 2 else x.astype(np.float64) for i, x in enumerate(merged(held)))]
                size = len(held[0][0])
                if size > COUNT_ROWS // 2:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return train.select("body").mapInArrow(run, "word bigint, shared bigint, n bigint").groupBy("word", "shared").agg(F.sum("n").alias("n"))


class Words:
    """The words that every task knows: sorted hashes, counts and classes."""

    def __init__(self, word=(), shared=(), n=(), own: int = OWN):
        word, shared, n = (np.asarray(x, np.int64) for x in (word, shared, n))
        ranked = np.lexsort((word, -n))
        label = OWN + shared
        label[ranked[:own]] = np.arange(min(own, len(ranked)))
        order = np.argsort(word.view(np.uint64))
        self.words, self.counts, self.labels = word.view(np.uint64)[order], n[order], label[order]

    def find(self, hashes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or 0, class) of each word."""
        if not len(self.words) or not len(hashes):
            return np.zeros(len(hashes), np.int64), OWN + shared
        keys, inverse = np.unique(hashes, return_inverse=True)
        i = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        ok = self.words[i] == keys
        count, label = np.where(ok, self.counts[i], 0)[inverse], np.where(ok, self.labels[i], -1)[inverse]
        return count, np.where(label < 0, OWN + shared, label)


def frequent(counts: DataFrame, most: int = KNOWN_WORDS) -> Words:
    """The most frequent words: as many steps of their frequency as fit into ``most`` rows."""
    step = F.floor(F.log2("n") * 16)
    have, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        have += r["count"]
        if have > most:
            break
        least = r["step"]
    if least is None:
        return Words()
    rows = counts.where(step >= least).toArrow()
    return Words(*(rows.column(c).to_numpy() for c in ("word", "shared", "n")))


def sequences(labels: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets (each text's classes and its end), the classes one and two places before, and where each text's targets begin."""
    n = len(word_at) - 1
    at = word_at + np.arange(n + 1)
    target = np.full(int(at[-1]), END, np.int64)
    last = np.zeros(len(target), bool)
    last[at[1:] - 1] = True
    target[~last] = labels
    one, two = np.full(len(target), BEFORE, np.int64), np.full(len(target), BEFORE, np.int64)
    one[1:], two[2:] = target[:-1], target[:-2]
    one[at[:-1]] = BEFORE
    two[at[:-1]] = BEFORE
    second = at[:-1] + 1
    two[second[second < at[1:]]] = BEFORE
    return target, one, two, at


class Model:
    """Parameters in one vector, so that they can be sent and averaged."""

    def __init__(self, unigram: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.flat = np.concatenate([
            rng.normal(0, 0.1, (CLASSES + 1) * SIZE), rng.normal(0, 0.1, CLASSES * SIZE), np.ones(2 * SIZE), np.log(unigram)]).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        cuts = np.cumsum([(CLASSES + 1) * SIZE, CLASSES * SIZE, SIZE, SIZE])
        r, q, c1, c2, b = np.split(self.flat, cuts)
        return [r.reshape(-1, SIZE), q.reshape(-1, SIZE), c1, c2, b]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        r, q, c1, c2, b = self.parts()
        return (r * c1) @ q.T, (r * c2) @ q.T + b

    def log_probabilities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A1, A2 and the log of the sum over all classes, by the two preceding classes."""
        a1, a2 = self.tables()
        return a1, a2, np.log(np.exp(a1.astype(np.float64)) @ np.exp(a2.astype(np.float64)).T)


class Learner:
    """Noise-contrastive estimation with adaptive steps, a batch of tokens at a time."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.noise = self.rng.choice(CLASSES, 1 << 20, p=unigram)
        self.shift = np.log(NOISE * unigram).astype(np.float32)
        self.squares = np.full(len(model.flat), 1e-8, np.float32)

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        n = len(target)
        r, q, c1, c2, b = self.model.parts()
        p1, p2 = r * c1, r * c2
        a1, a2 = (p1 @ q.T).reshape(-1), (p2 @ q.T + b - self.shift).reshape(-1)
        first = self.rng.integers(0, len(self.noise) - n, NOISE)
        words = np.concatenate([target, *(self.noise[k:k + n] for k in first)])
        i1, i2 = np.tile(one * CLASSES, NOISE + 1) + words, np.tile(two * CLASSES, NOISE + 1) + words
        err = -1 / (1 + np.exp(-np.clip(a1[i1] + a2[i2], -30, 30)))  # minus the chance that a word is no noise
        err[:n] += 1
        size = (CLASSES + 1) * CLASSES
        g1 = (np.bincount(i1, err, size) / n).astype(np.float32).reshape(-1, CLASSES)
        g2 = (np.bincount(i2, err, size) / n).astype(np.float32).reshape(-1, CLASSES)
        d1, d2 = g1 @ q, g2 @ q
        grad = np.concatenate([(d1 * c1 + d2 * c2).reshape(-1), (g1.T @ p1 + g2.T @ p2).reshape(-1), (d1 * r).sum(0), (d2 * r).sum(0), g2.sum(0)])
        self.squares += grad * grad
        self.model.flat += RATE * grad / np.sqrt(self.squares)


def averaged(train: DataFrame, model: Model, words: Words, unigram: np.ndarray, fan: int = 32) -> np.ndarray:
    """One round: every task learns from ``model`` on, and the results are averaged by levels of ``fan``."""
    start = model.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(unigram)
        mine.flat = start.copy()
        powers, seen, held, size = col.Powers(), 0, [], 0
        learner = Learner(mine, unigram, 7)

        def learn(parts):
            t, a, b = (np.concatenate(x) for x in zip(*parts))
            whole = max(1, round(len(t) / BATCH))
            for x in zip(*(np.array_split(v, whole) for v in (t, a, b))):
                learner.learn(*x)

        for batch in col.slices(batches, "body"):
            hashes, shared, word_at = tokens(batch.column(batch.schema.get_field_index("body")), powers)
            target, one, two, _ = sequences(words.find(hashes, shared)[1], word_at)
            held.append((target, one, two))
            size += len(target)
            seen += len(target)
            if size >= BATCH:
                learn(held)
                held, size = [], 0
        if held:
            learn(held)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(mine.flat.astype(np.float64) * seen).tobytes()], pa.binary())], ["n", "flat"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                n += k
                v = np.frombuffer(x.as_py(), np.float64)
                total = v.copy() if total is None else total + v
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "flat"])

    sums = staged(train.select("body").mapInArrow(run, "n bigint, flat binary"), "learned")
    left = sums.count()
    while left > fan:
        left = -(-left // fan)
        sums = staged(sums.repartition(left).mapInArrow(add, "n bigint, flat binary"), "averaged")
    rows = sums.collect()
    if not rows:
        return start
    return (np.sum([np.frombuffer(r["flat"], np.float64) for r in rows], 0) / sum(r["n"] for r in rows)).astype(np.float32)


PARTIAL = ("doc_id bigint, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base double, model double, "
           "rare array<struct<word:bigint,shared:bigint,times:bigint>>")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    A null or empty text is its end alone. A row without id counts as held out (its id as text is empty). Without
    training documents all words are unknown and the model is uniform over classes. An empty table gives no row.
    """
    rows = thin_batches(_rows(docs, doc_id, text))
    train = rows.where("not held_out")
    counts = staged(word_counts(train), "word-counts")
    n_docs = train.count()
    shares = {r["shared"]: r for r in counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    known = frequent(counts)
    total = sum(r["n"] for r in shares.values()) + n_docs
    distinct = sum(r["v"] for r in shares.values()) + (n_docs > 0)
    own = known.labels < OWN
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for s, r in shares.items():
        mass[OWN + s], types[OWN + s] = r["n"], r["v"]
    if own.any():
        mine = {int(w): i for i, w in enumerate(known.words[own])}
        for r in counts.where(F.col("word").isin([int(np.uint64(w).view(np.int64)) for w in known.words[own]])).collect():
            i = np.flatnonzero(own)[mine[int(np.int64(r["word"]).view(np.uint64))]]
            mass[known.labels[i]] = r["n"]
            mass[OWN + r["shared"]] -= r["n"]
            types[OWN + r["shared"]] -= 1
    mass[END] = n_docs
    unigram = (mass + SMOOTH) / (mass + SMOOTH).sum()
    model = Model(unigram)
    for k in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k)
        model.flat = averaged(part, model, known, unigram)
    below = total + SMOOTH * (distinct + 1)
    room = mass + SMOOTH * (types + 1)  # of a shared class: its tokens, its words, and one for all unknown ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (a1, a2, sums) = col.Powers(), model.log_probabilities()
        names, number = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "model", "rare"], TaskContext.get().partitionId() << 33
        for batch in col.slices(batches, "body"):
            hashes, shared, word_at = tokens(batch.column(2), powers)
            count, label = known.find(hashes, shared)
            target, one, two, at = sequences(label, word_at)
            here = (a1[one, target] + a2[two, target].astype(np.float64) - sums[one, two]) / np.log(10)
            rare = count == 0
            inside = np.where((label >= OWN) & ~rare, np.log10((count + SMOOTH) / room[label]), 0.0)
            base = np.where(rare, 0.0, np.log10((count + SMOOTH) / below))
            add = lambda v, a: np.diff(np.concatenate([[0.0], np.cumsum(v)])[a])
            n = len(word_at) - 1
            doc = col.owner(word_at)[rare]
            order = np.lexsort((hashes[rare], doc))
            d, h, s = doc[order], hashes[rare][order], shared[rare][order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d[first], np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(s[first]), pa.array(np.diff(np.append(first, len(d))))], ["word", "shared", "times"]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(number + np.arange(n)), pa.array(np.diff(at)),
                pa.array(col.per_text(~rare, word_at) + (n_docs > 0)), pa.array(add(base, word_at) + np.log10((n_docs + SMOOTH) / below)),
                pa.array(add(here, at) + add(inside, word_at)), lists], names)
            number += n

    partial = staged(rows.mapInArrow(run, PARTIAL), "partial-scores")
    words = partial.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.shared").alias("s"), "r.times")
    found = words.join(counts.select("word", "n"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    rooms = F.broadcast(docs.sparkSession.createDataFrame([(s, float(room[OWN + s])) for s in range(SHARED)], "s bigint, room double"))
    rare = found.join(rooms, "s").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + SMOOTH) / below)).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + SMOOTH) / F.col("room"))).alias("rare_model"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return partial.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("model") + zero("rare_model")).alias("score"))
