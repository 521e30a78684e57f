"""URL filters: path rules first, then a weighted vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in a URL's host and path.
A hit counts if no letter or digit touches it on either side. One strict term, or
several different soft terms, block the URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight 2 (strict): one hit blocks. Weight 1 (soft): SOFT_LIMIT different ones block.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "sexcam", "sexcams", "escorts", "viagra", "cialis", "cheap-pills",
          "casino", "casinos", "payday-loans", "warez", "keygen")
SOFT = ("adult", "nude", "sexy", "hot", "dating", "pills", "pharmacy", "cheap", "bet", "bets", "betting", "poker", "slots",
        "loan", "loans", "crack", "torrent", "torrents", "free", "win", "bonus", "click", "ads", "track", "tracking", "spam", "farm")
SOFT_LIMIT = 2

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def parts(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path; both empty for nulls and where ``://`` is missing."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return {"_url": u, "_rest": rest,
            "host": F.translate(F.regexp_extract(F.col("_rest"), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "path": F.regexp_extract(F.col("_rest"), "^[^/?#]*([^?#]*)", 1)}


def by_rule(rules=RULES) -> tuple[Column, Column]:
    """Rule and its verdict; of all that fit, the longest."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in reversed(ranked):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            out.add_word(term, (weight, term))
    out.make_automaton()
    return out


def hits(text: str, machine: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Strict and soft terms in ``text`` whose neighbours are neither letters nor digits."""
    found: tuple[set[str], set[str]] = (set(), set())
    for end, (weight, term) in machine.iter(text):
        start = end - len(term)
        if (start < 0 or not text[start].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            found[weight == 2].add(term)
    return found[1], found[0]


def judge(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the numbers of different strict and soft terms.

    A null, empty or odd URL has an empty host and path, no rule and no terms: it is allowed.
    Columns of ``pages`` with one of these names give way. Rows are judged one by one.
    """
    mine = {"host", "path", "rule", "verdict", "n_strict", "n_soft", "_url", "_rest", "_ruled"}
    if url in mine:
        raise ValueError(f"the URL column may not be called {url}")
    keep = [c for c in pages.columns if c not in mine]
    out = pages.select(*keep)
    for name, column in parts(F.col(f"`{url}`")).items():
        out = out.withColumn(name, column)
    rule, verdict = by_rule(rules)
    out = out.withColumns({"rule": rule, "_ruled": verdict}).select(*keep, "host", "path", "rule", "_ruled")
    names = out.columns
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(strict, soft)
        for batch in batches:
            at = batch.schema.get_field_index
            n_strict, n_soft = [], []
            for host, path in zip(batch.column(at("host")).to_pylist(), batch.column(at("path")).to_pylist()):
                a, b = hits(host + path.translate(lowered), machine)
                n_strict.append(len(a))
                n_soft.append(len(b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64())], [*names, "n_strict", "n_soft"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", n_strict bigint, n_soft bigint"
    blocked = (F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit)
    return out.mapInArrow(run, schema).withColumn(
        "verdict", F.coalesce("_ruled", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))).drop("_ruled")


def _term(term: str) -> str:
    return rf"regexp_matches(target, '(^|[^\pL\pN]){term}([^\pL\pN]|$)')"


def _count(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST({_term(t)} AS BIGINT)" for t in terms) + ")"


def _rules(value) -> str:
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(w, h, p)}'" for w, h, p in ranked) + " END"


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The same in SQL.
SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
t AS (SELECT *, host || translate(path, {_LOWER}) AS target FROM u),
n AS (
  SELECT page_id, host, path, {_rules(lambda w, h, p: h + p)} AS rule, {_rules(lambda w, h, p: w)} AS ruled,
    {_count(STRICT)} AS n_strict, {_count(SOFT)} AS n_soft FROM t)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM n
"""
