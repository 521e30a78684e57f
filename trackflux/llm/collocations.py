"""Phrase collocations by direct-address tiling of word pairs.

1. Words are counted per language. The most frequent ones are ranked by count; a rank is a word's address.
2. A pair of addresses lies in one cell of one square tile. Tiles of the top left corner, where frequent words meet, are arrays that
   ``bincount`` adds to; cells of all other tiles are sorted as coordinates with counts. Tasks flush either as (cell, count) rows,
   whose sums are shuffled.
3. Frequent pairs are ranked by count in turn. Such a pair and the word behind it make a cell again, so the same tiling counts phrases
   of one more word.

Words and pairs beyond the addresses (both are bounded) are counted by their texts. Of those texts only what can reach the least count
is shuffled: a fixed-size bitmap of frequent words, then of frequent pairs, tells most others apart; it errs on one side only, and sums are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import running, small, staged, thin_batches

LEAST, KEEP_PERCENT, TOP = 10, 50, 2000
#: Words and pairs with an address; what a task holds of them is under 40 MB.
WORDS, PAIRS = 1 << 18, 1 << 20
#: Side of a tile, and how many tiles of the corner, per side, are dense arrays.
TILE, DENSE = 1024, 2
#: Coordinates that a task sorts at once, distinct texts that it counts before it flushes, bits of the bitmaps.
COORDINATES, TEXTS, BITS = 1 << 21, 1 << 18, 8_388_593
#: Rows with phrases that may be broadcast.
FEW = 20_000
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 22

_BREAKS, _GAP, _BREAK = b".,;:!?\n\x0b\x0c\r", -2, -1
_TABLE = bytes(10 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(body: bytes) -> list[bytes]:
    """Words in order; a newline for each break between pieces, and empty strings, which mean nothing."""
    return body.replace(b"\n", b" \n ").split(b" ")


def parts(body: bytes) -> Iterator[bytes]:
    """A text in lower case with breaks as newlines; a long one in several parts, cut at breaks."""
    body, start = body.translate(_TABLE), 0
    while len(body) - start > SLICE_BYTES and (cut := body.find(b"\n", start + SLICE_BYTES)) >= 0:
        yield body[start:cut]
        start = cut + 1
    yield body[start:]


def _bodies(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return thin_batches(docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                                    F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("body")))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Tokens of all texts of a slice, language by language, a break after each text."""
    for batch in col.slices(batches, "body", SLICE_BYTES):
        by: dict[str, list[bytes]] = {}
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            *long, last = parts(body)
            for part in long:
                yield lang, tokens(part)
            by.setdefault(lang, []).append(last)
        for lang, bodies in by.items():
            yield lang, tokens(b"\n".join(bodies))


class _Texts:
    """Counts of phrases by language that are flushed before they grow beyond a bound."""

    def __init__(self):
        self.counts: dict[str, Counter] = {}

    def add(self, lang: str, phrases: list[bytes]) -> Iterator[pa.RecordBatch]:
        self.counts.setdefault(lang, Counter()).update(phrases)
        if sum(map(len, self.counts.values())) > TEXTS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, seen in self.counts.items():
            seen.pop(b"\n", None)  # tokens that are no words
            seen.pop(b"", None)
            n = len(seen)
            if n:
                texts = pa.array(seen.keys(), pa.binary(), size=n).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), n), texts, pa.nulls(n, pa.int64()), pa.array(seen.values(), pa.int64(), size=n)], _NAMES)
        self.counts = {}


_NAMES = ["lang", "phrase", "cell", "n"]
_ROWS = "lang string, phrase string, cell bigint, n bigint"


class _Cells:
    """Counts of cells: dense arrays for the corner, sorted coordinates for the rest."""

    def __init__(self, width: int):
        self.width, self.side = width, TILE * DENSE
        self.tiles: dict[int, np.ndarray] = {}
        self.loose: list[np.ndarray] = []
        self.held = 0

    def add(self, row: np.ndarray, column: np.ndarray) -> Iterator[pa.RecordBatch]:
        corner = (row < self.side) & (column < self.side)
        r, c = row[corner], column[corner]
        tile = r // TILE * DENSE + c // TILE
        for t in np.unique(tile).tolist():
            here = tile == t
            seen = np.bincount(r[here] % TILE * TILE + c[here] % TILE, minlength=TILE * TILE)
            self.tiles[t] = self.tiles[t] + seen if t in self.tiles else seen
        rest = ~corner
        self.loose.append(row[rest] * self.width + column[rest])
        self.held += int(rest.sum())
        if self.held > COORDINATES:
            yield from self.spill()

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The sorted coordinates with their counts."""
        if self.held:
            codes = np.sort(np.concatenate(self.loose))
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            yield _cells(codes[first], np.diff(np.append(first, len(codes))))
        self.loose, self.held = [], 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.spill()
        for t, seen in self.tiles.items():
            at = np.flatnonzero(seen)
            yield _cells((t // DENSE * TILE + at // TILE) * self.width + t % DENSE * TILE + at % TILE, seen[at])
        self.tiles = {}


def _cells(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.string()), pa.nulls(len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], _NAMES)


@dataclass(frozen=True)
class _Bitmap:
    """A set of whole numbers by two bits each: what is in the set is always found."""

    words: np.ndarray

    @staticmethod
    def places(key: Column) -> Column:
        return F.array(F.pmod(key, F.lit(BITS)), F.pmod(F.call_function("div", key, F.lit(_STEP)), F.lit(BITS)))

    @staticmethod
    def of(keys: DataFrame) -> _Bitmap:
        """Of the column ``key``, put together by tasks; BITS / 8 bytes reach the driver, whatever the number of rows."""
        bits = keys.select(F.explode(_Bitmap.places(F.col("key"))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, int(pmod(at, 64))))").alias("bits"))
        got = bits.toArrow()
        words = np.zeros(BITS // 64 + 1, np.uint64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return _Bitmap(words)

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for at in (key % BITS, key // _STEP % BITS):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


#: What the second place of a key leaves out.
_STEP = 7919


def _mark(*parts: Column) -> Column:
    """A phrase's key in a bitmap, the same as ``_marks`` computes in a task: 60 bits of the MD5 of language and phrase."""
    return F.conv(F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 15), 16, 10).cast("bigint")


def _marks(lang: str, phrases: list[bytes]) -> np.ndarray:
    from hashlib import md5
    head = lang.encode() + b"\n"
    return np.array([int(md5(head + p).hexdigest()[:15], 16) for p in phrases], np.int64)


def _phrase_bitmap(rows: DataFrame) -> _Bitmap | None:
    """Of (lang, phrase) rows; None if there are none."""
    return None if rows.isEmpty() else _Bitmap.of(rows.select(_mark(F.col("lang"), F.col("phrase")).alias("key")))


def count_words(bodies: DataFrame) -> DataFrame:
    """(lang, phrase, n) of single words."""
    def run(batches):
        texts = _Texts()
        for lang, words in _chunks(batches):
            yield from texts.add(lang, words)
        yield from texts.flush()

    return bodies.mapInArrow(run, _ROWS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class _Addresses:
    """What tasks know: addresses of words by language, cells of ranked pairs, and the bitmaps (None: everything has an address)."""

    langs: list[str]
    lang: np.ndarray  # of each word, as a place in ``langs``
    words: bytes  # by rank, each followed by a newline
    pairs: np.ndarray | None = None  # cells of word pairs, by rank
    more_words: _Bitmap | None = None  # frequent words without an address
    more_cells: _Bitmap | None = None  # cells of frequent pairs without one
    more_pairs: _Bitmap | None = None  # frequent pairs that have no cell

    def by_lang(self) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(zip(self.lang.tolist(), self.words.split(b"\n"))):
            out.setdefault(self.langs[lang], {b"\n": _BREAK, b"": _GAP})[word] = i
        return out


#: Codes of words without an address: those that may be frequent, and those that are not.
_MAYBE, _NEVER = -3, -4


def _coded(words: list[bytes], book: dict[bytes, int], lang: str, known: _Addresses, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens without the empty ones, and where in ``words`` they stand."""
    get = book.get
    codes = np.fromiter((get(w, _NEVER) for w in words), np.int64, len(words))
    at = np.flatnonzero(codes != _GAP)
    codes = codes[at]
    if known.more_words is not None:
        odd = np.flatnonzero(codes == _NEVER)
        fresh = [w for w in {words[i] for i in at[odd].tolist()} if w not in cache]
        cache.update(zip(fresh, known.more_words.has(_marks(lang, fresh)).tolist()))
        codes[odd[np.fromiter((cache[words[i]] for i in at[odd].tolist()), bool, len(odd))]] = _MAYBE
    return codes, at


def count_phrases(bodies: DataFrame, known: _Addresses, size: int) -> DataFrame:
    """(lang, phrase, cell, n) of phrases of two words, or of three whose pairs are both frequent.

    ``cell`` stands for lang and phrase where all parts have an address.
    """
    shared = bodies.sparkSession.sparkContext.broadcast(known)  # bounded by WORDS, PAIRS and BITS

    def run(batches):
        known = shared.value
        books, caches = known.by_lang(), {}
        width = len(known.lang)
        cells, texts = _Cells(width), _Texts()
        if known.pairs is not None:
            order = np.argsort(known.pairs)
            ranked = known.pairs[order]
            sieve = np.zeros(BITS, bool)
            sieve[ranked % BITS] = True
        for lang, words in _chunks(batches):
            book = books.setdefault(lang, {b"\n": _BREAK, b"": _GAP})
            codes, at = _coded(words, book, lang, known, caches.setdefault(lang, {}))
            ok = (codes >= 0) | (codes == _MAYBE)
            both = ok[:-1] & ok[1:]
            direct = both & (codes[:-1] >= 0) & (codes[1:] >= 0)
            if size == 2:
                i = np.flatnonzero(direct)
                yield from cells.add(codes[i], codes[i + 1])
                j = np.flatnonzero(both & ~direct)
            else:
                cell = codes[:-1] * width + codes[1:]
                k = np.flatnonzero(direct)
                k = k[sieve[cell[k] % BITS]]
                rank = np.full(len(cell), -1)
                if len(k):
                    where = np.minimum(np.searchsorted(ranked, cell[k]), len(ranked) - 1)
                    rank[k] = np.where(ranked[where] == cell[k], order[where], -1)
                hit = rank >= 0
                i = np.flatnonzero(hit[:-1] & hit[1:])
                yield from cells.add(rank[i], codes[i + 2])
                # frequent pairs without an address: beyond the ranked ones, or with a word that has none
                maybe = np.zeros(len(cell), bool)
                if known.more_cells is not None:
                    k = np.flatnonzero(direct & ~hit)
                    maybe[k] = known.more_cells.has(cell[k])
                if known.more_pairs is not None:
                    k = np.flatnonzero(both & ~direct)
                    maybe[k] = known.more_pairs.has(_marks(lang, _joined(words, at, k, 2)))
                good = hit | maybe
                j = np.flatnonzero(good[:-1] & good[1:] & ~(hit[:-1] & hit[1:]))
            yield from texts.add(lang, _joined(words, at, j, size))
        yield from cells.flush()
        yield from texts.flush()

    return bodies.mapInArrow(run, _ROWS).groupBy("lang", "phrase", "cell").agg(F.sum("n").alias("n"))


def _joined(words: list[bytes], at: np.ndarray, starts: np.ndarray, size: int) -> list[bytes]:
    place = [at[starts + k].tolist() for k in range(size)]
    return [b" ".join(words[i] for i in p) for p in zip(*place)]


def _ranked(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """``rows`` with ``rank`` from 0 by falling n; null beyond ``limit``. No sort in one task."""
    out = running(rows.withColumn("_less", -F.col("n")), ["_less", *order], {"rank": F.lit(1)}, "ranked").withColumnRenamed("rank_before", "rank").drop("_less")
    return staged(out.withColumn("rank", F.when(F.col("rank") < limit, F.col("rank")).cast("bigint")), "addresses")


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, max_words: int = WORDS, max_pairs: int = PAIRS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Totals (lang, n), then (lang, phrase, n) of the frequent words, pairs (with w1, w2) and triples (with w1, w2, w3)."""
    bodies = _bodies(docs, lang, text)
    counted = staged(count_words(bodies), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = _ranked(counted.where(F.col("n") >= least), ["lang", "phrase"], max_words)
    top = words.where("rank is not null").select("rank", "lang", "phrase").toArrow().sort_by("rank")  # at most max_words rows
    code = top.column("lang").combine_chunks().dictionary_encode()
    names = "".join(f"{w}\n" for w in top.column("phrase").to_pylist()).encode()
    known = _Addresses(code.dictionary.to_pylist(), code.indices.to_numpy(), names, more_words=_phrase_bitmap(words.where("rank is null")))
    width = max(len(known.lang), 1)

    by_rank = small(words.where("rank is not null"), FEW)
    first, second, third = (by_rank.select(F.col("rank").alias(f"_r{k}"), F.col("lang").alias(f"_l{k}"), F.col("phrase").alias(f"_w{k}")) for k in (1, 2, 3))
    counted = staged(count_phrases(bodies, known, 2).where(F.col("n") >= least), "pair-counts")
    at = lambda c, k: F.expr(f"({c}) {k} {width}L")
    direct = counted.where("cell is not null").select("n", "cell", at("cell", "div").alias("_r1"), at("cell", "%").alias("_r2")).join(first, "_r1").join(second, "_r2").select(
        F.col("_l1").alias("lang"), F.concat_ws(" ", "_w1", "_w2").alias("phrase"), "cell", "n")
    ranked = _ranked(direct, ["lang", "phrase"], max_pairs)
    loose, beyond = counted.where("cell is null").select("lang", "phrase", "n"), ranked.where("rank is null").select(F.col("cell").alias("key"))
    pairs = ranked.select("lang", "phrase", "n").unionByName(loose)
    cells = ranked.where("rank is not null").select("rank", "cell").toArrow().sort_by("rank").column("cell").to_numpy()  # at most max_pairs rows
    known = replace(known, pairs=cells, more_cells=None if beyond.isEmpty() else _Bitmap.of(beyond), more_pairs=_phrase_bitmap(loose))
    counted = staged(count_phrases(bodies, known, 3).where(F.col("n") >= least), "triple-counts")
    direct = counted.where("cell is not null").select("n", at("cell", "div").alias("rank"), at("cell", "%").alias("_r3")).join(
        ranked.where("rank is not null").select("rank", "cell"), "rank").select("n", "_r3", at("cell", "div").alias("_r1"), at("cell", "%").alias("_r2"))
    direct = direct.join(first, "_r1").join(second, "_r2").join(third, "_r3").select(F.col("_l1").alias("lang"), F.concat_ws(" ", "_w1", "_w2", "_w3").alias("phrase"), "n")
    triples = direct.unionByName(counted.where("cell is null").select("lang", "phrase", "n"))
    w = F.split("phrase", " ")
    split = lambda df, k: df.select("lang", "phrase", "n", *[w[i].alias(f"w{i + 1}") for i in range(k)])
    return staged(totals, "lang-totals"), words.select("lang", "phrase", "n"), split(pairs, 2), staged(split(triples, 3), "triples")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits, exact for counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, keep_percent: int = KEEP_PERCENT, top: int = TOP,
         max_words: int = WORDS, max_pairs: int = PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` collocations of two and three words of each language.

    Null languages are ``und``, null and empty texts have no words. Every row counts, repeated ones too. Ties go to the larger count, then to the
    phrase by its bytes. Texts are read whole, three times; other columns than the two named are not read. A language without a candidate, or an empty table, gives no
    rows. Counts have up to 15 digits.
    """
    totals, words, pairs, triples = phrases(docs, lang, text, least, max_words, max_pairs)
    few_words, few_pairs = small(words, FEW), small(pairs, FEW)
    one = lambda k, n: few_words.select("lang", F.col("phrase").alias(k), F.col("n").alias(n))
    two = lambda a, b, n: few_pairs.select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("n").alias(n))
    a = F.col("n")
    inside = triples.select("lang", "n", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("_in")).select(
        "lang", F.col("_in.w1").alias("w1"), F.col("_in.w2").alias("w2"), "n").groupBy("lang", "w1", "w2").agg(F.max("n").alias("_longer"))
    short = pairs.join(inside, ["lang", "w1", "w2"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < keep_percent * a))
    short = short.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"]).select("lang", "phrase", a.alias("a"), "l", "r", _score(a, F.col("l"), F.col("r")).alias("score"))
    cut = triples.join(one("w1", "l1"), ["lang", "w1"]).join(two("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(two("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
    cut = cut.withColumns({"s1": _score(a, F.col("l1"), F.col("r1")), "s2": _score(a, F.col("l2"), F.col("r2"))})
    first = F.col("s1") <= F.col("s2")
    long = cut.select("lang", "phrase", a.alias("a"), *[F.when(first, F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score"))])
    found = staged(short.unionByName(long), "collocations")
    # the best of each part of a language first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_part")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_CUT = r"[.,;:!?\x0A-\x0D]"
#: The same in SQL.
SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT lang, unnest(regexp_split_to_array(text, '{_CUT}')) AS piece FROM d)),
w AS (SELECT lang, p, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
s AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY lang, p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS n FROM s GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS n FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(n)::BIGINT AS total FROM f1 GROUP BY lang),
longer AS (SELECT lang, w1, w2, max(n) AS m FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.n AS a, x.n AS l, y.n AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
    LEFT JOIN longer g ON g.lang = f2.lang AND g.w1 = f2.w1 AND g.w2 = f2.w2
  WHERE g.m IS NULL OR 100 * g.m < {KEEP_PERCENT} * f2.n),
k AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.n AS a, x.n AS l1, yz.n AS r1, xy.n AS l2, z.n AS r2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3
    JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3),
e AS (
  SELECT lang, phrase, a, l, r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (SELECT *, ((1000000::HUGEINT * a * a) // (l1::HUGEINT * r1))::BIGINT AS s1, ((1000000::HUGEINT * a * a) // (l2::HUGEINT * r2))::BIGINT AS s2 FROM k)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT q.lang, rank, phrase, a, l, r, total AS n, score FROM q JOIN t USING (lang) WHERE rank <= {TOP}
"""
