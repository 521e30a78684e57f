"""Quality rules: how much of a text repeats itself.

Rolling hashes of several n-gram lengths are taken over whole Arrow slices in numpy. A
character counts as repeated once, however many repeated n-grams or lines cover it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import thin_batches

#: Largest share of a text's word characters that may lie in later copies of n-grams, by length in words,
#: and in lines equal to an earlier line. Published limits for web text go down to a tenth; a short clean text
#: with one repeated line is above that, so one fifth holds for all lengths.
NGRAM_LIMITS = dict.fromkeys((5, 6, 7, 8, 9, 10), 0.20)
LINE_LIMIT = 0.20
#: Fewer words, or a larger share of them in repeated three-word windows, fail the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
            *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)]


def measure(texts: pa.Array, powers: col.Powers, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """The measures of each text of a column."""
    data, at = col.flat(texts)
    start, end, word_at = col.words(data, at)
    sums = col.prefix(col.byte_values(data), powers)
    heads = (data & 0xC0) != 0x80
    ink = heads & ~col.member(col.SPACES)[data]
    chars = np.concatenate([[0], np.cumsum(ink)])
    word_chars = chars[end] - chars[start]
    doc = col.owner(word_at)
    salt = col.mix(np.arange(len(at), dtype=np.uint64) + np.uint64(77))

    out = {"n_words": np.diff(word_at), "word_chars": chars[at[1:]] - chars[at[:-1]],
           "n_symbols": col.per_text(col.member(SYMBOLS)[data], at)}

    stop = np.unique(np.concatenate([np.flatnonzero(data == 10), at[1:]]))  # a newline, or the end of a text
    newline = np.zeros(len(data) + 1, bool)
    newline[:-1] = data == 10
    begins = np.unique(np.concatenate([np.flatnonzero(newline) + 1, at[:-1]]))
    begins = begins[begins < len(data)]
    line_end = np.where(newline[begins], begins, stop[np.searchsorted(stop, begins, "right")]) if len(begins) else begins
    line_chars = chars[line_end] - chars[begins]
    full = line_chars > 0
    begins, line_end, line_chars = begins[full], line_end[full], line_chars[full]
    line_doc = np.searchsorted(at, begins, "right") - 1
    _, again = col.repeats(col.stretch(sums, begins, line_end, powers) ^ salt[line_doc])
    n = len(at) - 1
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc[again], line_chars[again], n).astype(np.int64)

    gram = col.prefix(col.stretch(sums, start, end, powers), powers)
    three = col.windows(word_at, 3)
    often, _ = col.repeats(col.stretch(gram, three, three + 3, powers) ^ salt[doc[three]])
    out["n_repeat_words"] = col.per_text(col.covered(three[often], 3, len(start)), word_at)
    candidates = three[often]
    for k in lengths:
        # a repeated n-gram starts with a repeated shorter one, so fewer and fewer starts are left
        room = word_at[doc[candidates] + 1] - candidates >= k
        candidates = candidates[room]
        often, again = col.repeats(col.stretch(gram, candidates, candidates + k, powers) ^ salt[doc[candidates]])
        inside = col.covered(candidates[again], k, len(start))
        out[f"dup_{k}gram_chars"] = col.per_text(np.where(inside, word_chars, 0), word_at)
        candidates = candidates[often]
    return out


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Columns of ``docs`` that
    have the name of a measure give way to it. Rows are judged one by one, so repeated rows,
    ties and hot sources change nothing; memory is bounded by a slice or the longest text.
    """
    mine = {*MEASURES, "base_failed", "kept"}
    if text in mine:
        raise ValueError(f"the text column may not be called {text}")
    plain = docs.select(*[c for c in docs.columns if c not in mine])
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = col.Powers()
        for batch in col.slices(batches, text):
            found = measure(batch.column(batch.schema.get_field_index(text)), powers)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], [*names, *MEASURES])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + "".join(f", {m} bigint" for m in MEASURES)
    measured = thin_batches(plain).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fine = F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in NGRAM_LIMITS.items():
        fine &= F.col(f"dup_{n}gram_chars") <= limit * F.col("word_chars")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever they are called."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    judged = judge(docs.toDF(*names), names[docs.columns.index(text)])
    return judged.where("kept").select(*names).toDF(*docs.columns)


_WORD = r"[^\x20\x09-\x0D]+"
#: The same in SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, i, word, length(word) AS chars FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d)),
lead AS (SELECT doc_id, i, word AS w0, {", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, max(NGRAM_LIMITS)))} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (
  {" UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, hash({', '.join(f'w{k}' for k in range(n))}) AS gram FROM lead WHERE w{n - 1} IS NOT NULL" for n in (3, *NGRAM_LIMITS))}),
k AS (
  SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, gram) AS times, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) AS nr FROM g),
c AS (SELECT DISTINCT doc_id, n, i + j AS i FROM k, range(0, n) q(j) WHERE CASE WHEN n = 3 THEN times > 1 ELSE nr > 1 END),
cov AS (
  SELECT doc_id, count(*) FILTER (WHERE n = 3) AS n_repeat_words,
    {", ".join(f"sum(chars) FILTER (WHERE n = {n}) AS g{n}" for n in NGRAM_LIMITS)}
  FROM c JOIN w USING (doc_id, i) GROUP BY doc_id),
l AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nr
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
dup AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: length(x)))) AS dup_line_chars
  FROM l WHERE nr > 1 GROUP BY doc_id),
t AS (SELECT doc_id, sum(chars) AS word_chars FROM w GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
    {", ".join(f"coalesce(g{n}, 0)::BIGINT AS dup_{n}gram_chars" for n in NGRAM_LIMITS)}
  FROM d LEFT JOIN t USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {LINE_LIMIT}::DOUBLE * word_chars
  AND {" AND ".join(f"dup_{n}gram_chars <= {v}::DOUBLE * word_chars" for n, v in NGRAM_LIMITS.items())} AS kept
FROM b
"""
