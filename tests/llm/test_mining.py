"""Personal data, collocations and hard negatives against plain versions."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import diff
from trackflux.llm import collocations, negatives, pii

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes_luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def base_spans(text):
    """The base kinds as stated: the given patterns by ``finditer``, then the checks."""
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m.group().split("."))
                    or kind == "card" and not (12 <= len(d) <= 19 and passes_luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


def further_spans(text):
    """The other kinds by a plain walk: (score, kind number, start, end) of what reaches a half, best first, none touching another."""
    near = lambda s, e, words: any(re.search(rf"(?<!\w){w}(?!\w)", part, re.I) for w in words for part in (text[max(0, s - 48):s], text[e:e + 48]))
    context = {d.kind: d.context for d in pii.DETECTORS}
    found = []

    def add(number, kind, s, e, score):
        score += 0.35 if near(s, e, context[kind]) else 0
        if score > 0.499:
            found.append((-round(min(score, 1), 2), number, s, e))

    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        words = m.group().split(" ")
        for n in range(len(words), 0, -1):
            s = "".join(words[:n])
            if len(" ".join(words[:n])) >= 15 and 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                add(4, "iban", m.start(), m.start() + len(" ".join(words[:n])), 0.8)
                break
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text):
        if m[1] not in ("000", "666") and int(m[1]) < 900 and int(m[2]) and int(m[3]):
            add(5, "ssn", m.start(), m.end(), 0.3)
    for m in re.finditer(r"(?<![A-Za-z0-9])([0-9]{8})-?([A-Za-z])(?![A-Za-z0-9])", text):
        if "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[1]) % 23] == m[2].upper():
            add(6, "dni", m.start(), m.end(), 0.2)
    for m in re.finditer(r"(?<![0-9])[12]( ?[0-9]{2}){3}( ?[0-9]{3}){2} ?[0-9]{2}(?![0-9])", text):
        d = m.group().replace(" ", "")
        if int(d[:13]) % 97 + int(d[13:]) == 97:
            add(7, "nir", m.start(), m.end(), 0.4)
    for m in re.finditer(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}={0,2}(?![A-Za-z0-9_+/=-])", text):
        turns = re.sub("[^A-Za-z0-9]", "", m.group())
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(turns, turns[1:]))
        add(8, "secret", m.start(), m.end(), 0.3 if changes * 8 >= len(m.group()) else 0.1)
    for m in re.finditer(r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9])", text):
        if 7 <= len(re.sub("[^0-9]", "", m.group())) <= 12:
            add(9, "call", m.start(), m.end(), 0.2)
    taken = [tuple(map(int, x.split(":")[1:])) for x in base_spans(text)]
    kept = []
    for score, number, s, e in sorted(found):
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            kept.append((s, number, f"{pii.DETECTORS[number].kind}:{s}:{e}"))
    return kept


def all_spans(text):
    names = [k for k, _ in BASE]
    base = [(int(x.split(":")[1]), names.index(x.split(":")[0]), x) for x in base_spans(text)]
    return ",".join(x for _, _, x in sorted(base + further_spans(text or "")))


ODD = [
    "mail a.b+c@x-y.co.uk, then a@b a@b.c@d.e .@x.y @x.y q@.z é@é.de ü.x@mail.example.org.",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.002.3.04 and 999999999999999999999.1.1.1 1.2.3", "a" * 3000 + "1" * 3000 + ".1.1.1 " + "@" * 500,
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 5500005555555559 12 34 5 6 - 7", "+1 (017) 555-7713 rethsh +49 30 123456. ++1-2 +123456789012345678",
    "IBAN DE89 3704 0044 0532 0130 00 IS MY account, GB82WEST12345698765432 and DE88370400440532013000", "ssn 123-45-6789 or 123-45-6789 far away" + " x" * 60 + " 219-09-9999",
    "DNI 12345678Z or 12345678A; sécurité sociale 1 84 12 76 451 089 46 ok", 'Storti token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thhan', "04dbebab91ab85687d33eeaaf9ac699e1188f962 alone",
    "telefon (030) 123 45 67, fax 030/1234567; nothing 030 123 4567" + " y" * 40 + " 030 123 4567", "key 漢字 é1234-5678-90 call 0123 456 789 call 0123 456 789", "12 34", "", None,
    "token abcdefghijklmnopqrstuvwxyzabcdef and key a1b2c3d4e5f6a7b8c9d0==", "call 4111 1111 1111 1111 call", "1.1.1.1@1.1.1.1 +1.1.1.1.1.1.1.1.1.1",
]


def noisy(rng, n):
    bits = ["0", "1", "4", "12", "255", ".", "-", " ", "+", "(", ")", "@", "a", "B2", ".com", "é", "/", "=", "card ", "token ", "4111111111111111", "9" * 9, "\n"]
    return "".join(rng.choices(bits, k=n))


def test_op11(spark, sf_dir):
    df = entry.queries()["op11_pii"](spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_pii(df, rows)


def check_pii(df, rows):
    want = collections.Counter()
    for i, t in rows:
        base = base_spans(t)
        want[(i, *[sum(x.startswith(k) for x in base) for k, _ in BASE], hashlib.sha256(",".join(base).encode()).hexdigest(), all_spans(t))] += 1
    got = df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_pii_in_odd_texts(spark):
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, ODD[0]), (3, ODD[3])] + [(100 + k, noisy(rng, rng.randint(1, 60))) for k in range(600)]
    check_pii(pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)
    kinds = {x.split(":")[0] for _, t in rows for x in all_spans(t).split(",")}
    assert kinds >= {d.kind for d in pii.DETECTORS}, "every kind occurs"


def test_pii_scores_and_columns(spark):
    df = spark.createDataFrame([(ODD[8], 1, "a", "b"), (None, 2, None, None)], "text string, key int, _c0 string, pii string")
    out = pii.find(df)
    assert out.columns == ["text", "key", "_c0", "pii"]
    one, none = out.orderBy("key").collect()
    assert [(x["kind"], x["score"]) for x in one["pii"]] == [("secret", 0.65)] and none["pii"] == [] and one["_c0"] == "a"
    clean = pii.redact(df).orderBy("key").collect()
    assert clean[0]["text"] == 'Storti token = "<SECRET>" thhan' and clean[0]["pii"] == "b" and clean[1]["text"] is None


def test_patterns_take_linear_time():
    import time
    t = time.time()
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000, "a." * 200_000 + "@", "+1 " * 150_000, "AB12" * 100_000, "1 2-" * 100_000, "a1" * 200_000, "@a" * 200_000):
        pii.scan(text)
    assert time.time() - t < 40


def phrase_tables(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("lang", "text").toArrow())
    return con


def worded(rng, n, words):
    return "".join(rng.choices(words, k=1)[0] + rng.choice([" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\x0b", "; "]) for _ in range(n))


@pytest.fixture(scope="module")
def phrased(spark):
    rng = random.Random(12)
    words = ["new", "New", "york", "CITY", "of", "the", "é", "漢字", "a-b", "x1", "(the"] + [f"w{k}" for k in range(40)]
    rows = [(rng.choice(["en", "en", "de", "und", None, ""]), worded(rng, rng.randint(0, 60), words[:rng.choice([4, 12, 51])])) for _ in range(900)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", "a b"), ("en", "the " * 5000), ("en", "new york city " * 30)] + [("de", "same text of six words")] * 30
    return spark.createDataFrame(rows, "lang string, text string").repartition(7).cache()


@pytest.mark.parametrize("limits", [{}, {"max_words": 12, "max_pairs": 12}, {"max_words": 0, "max_pairs": 0}])
def test_collocations(spark, phrased, limits):
    assert diff(collocations.mine(phrased, **limits), phrase_tables(spark, phrased), collocations.SQL) is None


def test_collocations_of_odd_columns_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.select(F.col("lang").alias("phrase"), F.col("text").alias("n"), F.lit(1).alias("cell"), F.lit(2).alias("lang"))
    assert diff(collocations.mine(odd, "phrase", "n"), phrase_tables(spark, docs), collocations.SQL) is None
    assert collocations.mine(docs.limit(0)).count() == 0
    few = collocations.mine(docs, least=4, top=3)
    assert few.groupBy("lang").count().agg(F.max("count")).first()[0] == 3


def test_large_counts_are_exact(spark):
    big = 999_999_999_999_937
    df = spark.createDataFrame([(big - 5, big, big - 1), (10, 10, 10), (10, 1 << 40, 1 << 41)], "a bigint, l bigint, r bigint")
    got = [tuple(r) for r in df.select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [(a, x, y, 1_000_000 * a * a // (x * y)) for a, x, y, _ in got]


def test_tiles_and_coordinates_count_alike(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 4)
    monkeypatch.setattr(collocations, "COORDINATES", 50)
    rng = np.random.default_rng(3)
    cells, got, want = collocations._Cells(30), collections.Counter(), collections.Counter()
    batches = []
    for _ in range(20):
        r, c = rng.integers(0, 30, 40), rng.integers(0, 30, 40)
        want.update((r * 30 + c).tolist())
        batches += list(cells.add(r, c))
    for b in [*batches, *cells.flush()]:
        for code, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            got[code] += n
    assert got == want and len(batches) > 5


def test_long_texts_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 10)
    body = b"Aa bb.Cc dd ee ff gg hh ii;jj\tkk" + b"x" * 50
    assert [t for p in collocations.parts(body) for t in [*collocations.tokens(p), b"\n"]][:-1] == collocations.tokens(body.translate(collocations._TABLE))


def plain_negatives(rows):
    use = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (y, [math.floor(256 * x) for x in v])
        use[i] = min(use.get(i, key), key)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (y, v) in use.items():
        if a % 100:
            continue
        scored = [(-dot(v, w), i, z) for i, (z, w) in use.items() if i != a]
        for s, p, z in sorted(x for x in scored if x[2] == y)[:5]:
            hard = sorted(x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(hard)]
    return collections.Counter(out)


def vectors(n=700, width=24):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, width))
    rows = []
    for i in range(n):
        v = (centres[rng.integers(6)] + rng.standard_normal(width) * rng.choice([0.0, 0.1, 1.0])).tolist()
        rows.append((i, v, int(rng.integers(4))))
    rows += [(1000, [0.0] * width, 1), (1100, None, 1), (1200, rows[0][1], None), (None, rows[0][1], 1), (1300, [None] * width, 2), (1400, [float("nan")] + rows[1][1][1:], 2),
             (1500, [float("inf")] + rows[1][1][1:], 2), (1600, rows[2][1][:10], 3), (1700, [], 3), (1800, rows[3][1] * 3, 2), (-100, rows[4][1], 0), (2000, rows[5][1], 77),
             (0, rows[9][1], 0), (7, rows[9][1], 1), (100, rows[0][1], 0), (300, [1e-320] * width, 1)]
    return rows + rows[:3]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 50, "block_anchors": 2, "levels": 1}])
def test_hard_negatives(spark, sizes):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, id int, anchor string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **sizes).collect()
    assert collections.Counter(map(tuple, got)) == plain_negatives(rows) and len(got) > 50
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_intervals_hold_and_tell_apart():
    rng = np.random.default_rng(1)
    turn = negatives.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    a, b = (np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64) for x in (rng.standard_normal((40, 64)), rng.standard_normal((3000, 64))))
    widths = []
    for levels in (1, 2, 4):
        lo, hi = negatives.intervals(a, b, turn, negatives.encode(b @ turn.T, levels))
        true = negatives.products(a, b)
        assert (lo <= true).all() and (true <= hi).all()
        widths.append((hi - lo).mean())
    assert widths[0] > 1.5 * widths[1] > 2 * widths[2]
    best = np.sort(true, axis=1)[:, -5]
    assert (hi >= best[:, None]).mean() < 0.25, "most rows need no exact score"


def test_products_beyond_floating_point():
    a = np.array([[(1 << 26) - 1, (1 << 26) - 1, 1]], np.int64)
    assert negatives.products(a, a)[0, 0] == 2 * ((1 << 26) - 1) ** 2 + 1


def test_no_meeting_of_blocks_is_broadcast(spark, monkeypatch):
    """Anchors are repeated for every block of rows; the planner, which sees them before, would collect the repeats in the driver."""
    joins, real = {}, negatives.staged

    def staged(df, name, **more):
        joins[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, **more)

    monkeypatch.setattr(negatives, "staged", staged)
    df = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<double>, label int")
    negatives.mine(df, F.col("vec_id") % 100 == 0, block_rows=30, block_anchors=2)
    assert all("SortMergeJoin" in joins[n] and "Broadcast" not in joins[n] for n in ("near", "hard"))


def test_blocks_travel_in_the_smallest_whole_numbers():
    for x, t in (([0, -127], np.int8), ([-128], np.int16), ([32767, -5], np.int16), ([1 << 26], np.int32), ([-(1 << 40)], np.int64), ([], np.int8)):
        a = np.array(x, np.int64)
        b = negatives._narrow(a)
        assert b.dtype == t and (negatives._long(b) == a).all()
