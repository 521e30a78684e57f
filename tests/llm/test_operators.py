"""Every query of the subpackage on small tables with odd rows, against a plain version or its SQL."""

import collections
import glob
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import diff
from tests.llm import plain
from trackflux.llm import columns as col
from trackflux.llm import exact, graph, mixing, neardup, packing, repeats, scoring, substrings, suffixes, urls, warc

NAMES = ["op1_warc_revisits", "op2_mix_sources", "op3_pack_sequences", "op4_near_dedup", "op5_quality_rules", "op6_url_filter", "op7_exact_dedup",
         "op8_substring_dedup", "op9_lm_scores", "op10_suffix_dedup", "op11_pii", "op12_collocations", "op13_hard_negatives"]


def tables(top):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{top}/{name}.parquet/*.parquet')")
    return con


def rows(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def texts(docs):
    return [(d[0], d[1]) for d in docs]


@pytest.mark.parametrize("name", [*NAMES, "pipeline"])
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert entry.queries()[name](spark, nothing).count() == 0


def test_op1(spark, sf_dir):
    df = entry.queries()["op1_warc_revisits"](spark, sf_dir)
    con = tables(sf_dir)
    want = plain.warc([tuple(r) for r in con.execute("SELECT page_id, html FROM pages").fetchall()])
    assert rows(df, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == collections.Counter(want)
    con.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('" + sf_dir + "/pages.parquet/*.parquet') WHERE page_id IS NOT NULL")
    assert diff(df.where("page_id is not null"), con, entry.oracle_sql()["op1_warc_revisits"]) is None


def test_archives_round_trip_and_second_pass(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null")
    warc.write(warc.from_pages(pages), f"{tmp_path}/a", archive_bytes=20_000)
    assert len(glob.glob(f"{tmp_path}/a/part-*")) > 5
    back = warc.read(spark, f"{tmp_path}/a")
    assert rows(back, "record_id", "uri", F.col("payload").cast("string")) == rows(
        pages, "page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.coalesce("html", F.lit("")))
    warc.dedup(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    warc.dedup(spark, f"{tmp_path}/b", f"{tmp_path}/c")  # revisits that are there already stay as they are
    heads = [rows(warc.read(spark, f"{tmp_path}/{x}", payload=False), "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to") for x in "bc"]
    assert heads[0] == heads[1]
    sizes = {r.record_id: len(r.payload) for r in warc.read(spark, f"{tmp_path}/c").collect()}
    assert sizes[9000] == 0 and sizes[9029] > 0


def test_a_later_archive_takes_over_the_original(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "body"), (2, "u", "body")], "page_id bigint, url string, html string")
    warc.write(warc.from_pages(pages), f"{tmp_path}/a")
    warc.dedup(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    extra = spark.createDataFrame([(3, "u", "body")], "page_id bigint, url string, html string")
    bare = warc.from_pages(extra).withColumn("record_type", F.lit("revisit")).withColumn("refers_to", F.lit(2).cast("bigint"))
    warc.write(warc.read(spark, f"{tmp_path}/b").unionByName(bare), f"{tmp_path}/c")
    warc.dedup(spark, f"{tmp_path}/c", f"{tmp_path}/d")
    got = {r.record_id: (r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read(spark, f"{tmp_path}/d").collect()}
    assert got == {1: ("revisit", 3, b""), 2: ("revisit", 3, b""), 3: ("response", None, b"body")}


def test_op2(spark, sf_dir):
    df = entry.queries()["op2_mix_sources"](spark, sf_dir)
    assert diff(df, tables(sf_dir), entry.oracle_sql()["op2_mix_sources"]) is None
    again = entry.queries()["op2_mix_sources"](spark, sf_dir)
    assert rows(df, *df.columns) == rows(again, *df.columns)
    got = df.collect()
    assert all(r.taken <= 3 * r.size for r in got)
    largest, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in got:
        key = (r.source_size, r.target)
        largest[key] = max(largest[key], r.size)
        taken[key] += r.taken
        goal[key] = r.target
    assert all(abs(taken[k] - goal[k]) <= 3 * largest[k] + 1 for k in goal)
    assert sum(goal.values()) <= sum(k[0] for k in goal) + 1e-6


def test_mix_targets_share_and_stop(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 400, "e": 0, None: 3}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(["a", "b", "c", "d", "e", None])}
    want, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            want |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_in_cells_keeps_totals(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "s1").otherwise("s2").alias("source"))
    whole = mixing.copies(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    cut = mixing.copies(docs, cell_rows=50).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r.n for r in whole} == {r.source: r.n for r in cut}


def test_mix_takes_the_same_documents_at_every_cut(spark, tmp_path):
    n = mixing.CELL_ROWS + 2000  # documents of one source and size
    docs = spark.range(n + 3000).select(
        F.when(F.col("id") % 500 != 7, (F.col("id") * 7919) % 20011 - 900).alias("doc_id"),
        F.when(F.col("id") < n, F.lit("a b c")).otherwise(F.concat_ws(" ", F.array_repeat(F.lit("d"), (F.col("id") % 9).cast("int")))).alias("text"),
        F.when(F.col("id") < n, "s1").when(F.col("id") % 3 > 0, "s2").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    columns = ["doc_id", "size", "source_size", "target", F.col("copies") * F.col("size")]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    usual, cut = (rows(mixing.copies(docs, **x), *columns) for x in ({}, {"cell_rows": 50}))
    assert usual == cut
    assert diff(entry.queries()["op2_mix_sources"](spark, str(tmp_path)), tables(tmp_path), entry.oracle_sql()["op2_mix_sources"]) is None


def test_op3(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = entry.queries()["op3_pack_sequences"](spark, sf_dir).collect()
    ids = collections.defaultdict(list)
    for d in docs:
        ids[d[0]].append(np.array([*tok.encode(d[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    want, have = collections.Counter(), collections.Counter()
    for i, lists in ids.items():
        for x in lists:
            want[i, len(x)] += len(x)
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert want == have
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert sum(want.values()) >= 0.97 * 1024 * len(by)


def test_added_tokens_are_matched_in_the_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    said = [f"end of one {end} next", end, end * 3, f" \n {end}  \n\n{end}x", f"<{end}>", f"é{end}漢", end[:-1], "<|EndOfText|>", f"a b {end} " * 500]
    got = packing.pack(spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")).collect()
    total = collections.Counter()
    for r in got:
        ids = np.array([*tok.encode(said[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        total[r.doc_id] += r.length
    assert total == {r.doc_id: r.doc_tokens for r in got} and len(total) == len(said)


@pytest.mark.parametrize("hist", [{150: 1000, 20: 3}, {256: 4, 1: 5}, {3: 1}, {k: 7 + k % 5 for k in range(1, 257)}, {129: 77}, {}])
@pytest.mark.parametrize("cut", [0, 16])
def test_plans_place_every_rest_once(hist, cut):
    plan = packing.plan(hist, 256, cut)
    size = {"whole": lambda b, c: b, "head": lambda b, c: c, "tail": lambda b, c: b - c}
    whole, heads, tails = collections.Counter(), collections.Counter(), collections.Counter()
    for pieces, times in plan:
        assert sum(size[k](b, c) for k, b, c in pieces) <= 256
        for k, b, c in pieces:
            if k != "tail":
                whole[b] += times
            if k != "whole":
                (heads if k == "head" else tails)[b, c] += times
    assert dict(whole) == hist and heads == tails
    places = packing.Places(plan, 10)
    seen = [places.of(("rest", b, 0), r)[:2] for b, n in hist.items() for r in range(n)]
    assert len(set(seen)) == len(seen)
    if cut and sum(hist.values()) > 60:
        assert sum(b * n for b, n in hist.items()) / 256 > 0.9 * sum(t for _, t in plan)


def test_op4(spark, sf_dir, docs):
    df = entry.queries()["op4_near_dedup"](spark, sf_dir)
    assert rows(df, "doc_id", "n_shingles", "component_id", "kept") == collections.Counter(plain.near_groups(texts(docs)))


def test_signatures_estimate_and_stop_early():
    rng, powers = random.Random(3), col.Powers()
    errors = []
    for k in range(60):
        a = [f"{k}-{j}" for j in range(300)]
        b = [x if rng.random() > 0.05 else "new" + x for x in a]
        hashes, at = neardup.shingles(pa.array([" ".join(a), " ".join(b), "", "x"]), powers)
        one, two = (plain.shingles(" ".join(x)) for x in (a, b))
        assert np.diff(at).tolist() == [len(one), len(two), 0, 1]
        sig = neardup.signatures(hashes, at)
        assert (sig[2] == neardup.EMPTY).all() and (sig[[0, 1, 3]] != neardup.EMPTY).all()
        assert len(set((sig[3] >> 24).tolist())) == neardup.SLOTS  # one shingle: each slot at another place of its permutation
        errors.append((sig[0] == sig[1]).mean() - len(one & two) / len(one | two))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_blocks_give_the_same_components(spark, docs, monkeypatch):
    some = [d for d in docs if d[0] is not None and 1200 <= d[0] <= 1300]
    df = spark.createDataFrame([(d[0], d[1]) for d in some], "doc_id bigint, text string")
    want = collections.Counter(plain.near_groups(texts(some)))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    # bands that nearly everything shares: all links come from the blocks
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, texts: pairs.where("false"))
    assert rows(neardup.groups(df), "doc_id", "n_shingles", "component_id", "kept") == want


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(300)]
    rng.shuffle(edges)
    forest = graph.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: r for x in forest.up if (r := forest.root(x)) != x}
    table = spark.createDataFrame(edges, "u bigint, v bigint").repartition(6)
    for few in (0, 100_000):
        assert {r.node: r.root for r in graph.components(table, few=few).collect()} == want


def test_op5(spark, sf_dir, docs):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in range(5, 11)), "base_failed", "kept"]
    want = collections.Counter()
    for i, t in texts(docs):
        *first, grams = plain.quality(t)
        want[(i, *first, *grams.values(), *plain.passes(t))] += 1
    assert rows(entry.queries()["op5_quality_rules"](spark, sf_dir), *names) == want


def test_op6(spark, sf_dir):
    def verdict(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.encode().translate(plain.A_Z).decode()
        fits = [(h + p, what) for what, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, *max(fits, key=lambda x: len(x[0]))
        text = host + path.encode().translate(plain.A_Z).decode()
        found = lambda terms: {t for t in terms if re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", text)}
        return host, path, None, "block" if found(urls.STRICT) or len(found(urls.SOFT)) >= 2 else "allow"

    pages = tables(sf_dir).execute("SELECT page_id, url FROM pages").fetchall()
    want = collections.Counter((i, *verdict(u)) for i, u in pages)
    got = rows(entry.queries()["op6_url_filter"](spark, sf_dir), "page_id", "host", "path", "rule", "verdict")
    assert got == want
    assert {(r[0], r[4]) for r in got} >= {(9106, "block"), (9107, "allow"), (9108, "block"), (9103, "block"), (9104, "allow"), (9000, "block")}


def test_op7(spark, sf_dir, docs):
    df = entry.queries()["op7_exact_dedup"](spark, sf_dir)
    assert rows(df, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == collections.Counter(plain.exact(texts(docs)))


def test_fingerprints_compose(spark):
    rng = np.random.default_rng(1)
    table = exact._powers(exact.CHUNK)
    whole = rng.integers(0, 256, 50_000).astype(np.uint8)
    h = exact.fingerprint(whole, table)
    for cut in (0, 1, 4096, 30_001, 50_000):
        a, b = whole[:cut], whole[cut:]
        assert exact.combine(exact.fingerprint(a, table), exact.fingerprint(b, table), len(b)) == h
    parts = [(1, k, bytearray(whole[a:a + 7000].tobytes())) for k, a in enumerate(range(0, 50_000, 7000))] + [(2, 0, bytearray(b"")), (3, 0, None)]
    got = {r.id: (r.length, r.fingerprint) for r in exact.fingerprints_of_parts(spark.createDataFrame(parts, "id int, part int, body binary").repartition(4), ["id"]).collect()}
    assert got == {1: (50_000, h), 2: (0, 0), 3: (0, 0)}


def test_equal_fingerprints_of_other_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "fingerprint_column", lambda body, table: np.zeros(len(body), np.int64))
    docs = [(k, t) for k, t in enumerate(["aa", "bb", "aa", "cc", "d", "bb", "aa"])]
    df = exact.classes(spark.createDataFrame(docs, "doc_id bigint, text string"), piece=1)
    want = {(i, k, n) for i, k, n, _, _ in plain.exact(docs)}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in df.collect()} == want


def test_op8(spark, sf_dir, docs):
    df = entry.queries()["op8_substring_dedup"](spark, sf_dir)
    assert rows(df, "doc_id", "n_words", "n_removed", "kept_sha256") == collections.Counter(plain.word_removal(texts(docs)))


def test_op10(spark, sf_dir, docs):
    df = entry.queries()["op10_suffix_dedup"](spark, sf_dir)
    got = rows(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    # repeats of a row are one row: the plain version sees them once, and its answer holds for each
    times = collections.Counter(texts(docs))
    ids = [d for d in times if d[0] is not None]
    want = collections.Counter({w: times[d] for d, w in zip(ids, plain.byte_removal(ids))})
    assert {k: v for k, v in got.items() if k[0] is not None} == want
    # null ids come last, one after the other in the order of their hashes
    keys = spark.createDataFrame([d for d in times if d[0] is None], "doc_id bigint, text string").selectExpr("text", "xxhash64(doc_id, coalesce(text, '')) AS key").collect()
    last = [(plain.LAST - 99 + k, r.text) for k, r in enumerate(sorted(keys, key=lambda r: r.key))]
    want = collections.Counter({(None, *w[1:]): times[None, d[1]] for d, w in zip(last, plain.byte_removal(ids + last)[len(ids):])})
    assert {k: v for k, v in got.items() if k[0] is None} == want


@pytest.mark.parametrize("fragments", [0, 3, 10_000])
@pytest.mark.parametrize("unit", ["word", "byte"])
def test_small_blocks_and_slices_change_nothing(spark, monkeypatch, unit, fragments):
    rng = random.Random(11)
    alphabet = [f"v{k}" for k in range(40)]
    shared = [" ".join(rng.choices(alphabet, k=rng.randrange(12, 70))) for _ in range(6)]
    docs = [(k, " ".join(x for _ in range(4) for x in (" ".join(rng.choices(alphabet, k=rng.randrange(1, 40))), rng.choice(shared)[rng.randrange(9):]))) for k in range(60)]
    monkeypatch.setattr(repeats, "SLICE_BYTES", 3000)
    remove, want = (substrings.remove, plain.word_removal(docs)) if unit == "word" else (suffixes.remove, plain.byte_removal(docs))
    spans = repeats.spans
    monkeypatch.setattr(repeats, "spans", lambda d, k, f, i, t: spans(d, k, f, i, t, 40, fragments))
    df = remove(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in df.collect()} == {w[0]: (w[2], w[-1]) for w in want}


def test_longest_previous_factors():
    rng = random.Random(5)
    for _ in range(30):
        parts = [bytes(rng.choices(b"ab", k=rng.randrange(1, 60))) for _ in range(rng.randrange(1, 5))]
        values = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        starts = np.array([k for k in range(len(values)) if rng.random() < 0.8], np.int64)
        if not len(starts):
            continue
        end = np.repeat(at[1:], np.diff(at))

        def lcp(i, j):
            n = 0
            while i + n < end[i] and j + n < end[j] and values[i + n] == values[j + n] and n < 20:  # noqa: B023
                n += 1
            return n

        want = [max((lcp(i, j) for j in starts if j < i), default=0) for i in starts]
        assert suffixes.longest_previous(values, at, starts, 20).tolist() == want


def test_factors_follow_their_source():
    words = lambda s: np.array([hash(x) & 0xFFFFFFFFFFFF for x in s.split()], np.uint64)
    parts = [words("a b c d e f g h"), words("c d e f q"), words("x b c d e y f g h c d e f q")]
    values, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    begin, n, known = substrings.factors(np.array([1, 1, 2]), at, values, 3)
    assert list(zip(begin.tolist(), n.tolist())) == [(14, 4), (19, 3), (22, 5)]
    assert known.tolist() == [14, 15, 19, 22, 23, 24]
    begin, n, _ = substrings.factors(np.array([1, 1, 2]), at, values, 3, most=4)  # a longer factor goes on as the next, if a window is left
    assert list(zip(begin.tolist(), n.tolist())) == [(14, 4), (19, 3), (22, 4)]
    assert substrings.factors(np.array([3, 3, 3]), at, values, 3)[2].tolist() == []  # one document lends itself nothing


def test_parse_looks_again_across_the_ends_of_factors():
    rng = random.Random(2)
    for _ in range(60):
        parts = [rng.choices("abc", k=rng.randrange(13, 80)) for _ in range(rng.randrange(1, 9))]
        parts += [parts[0][:20] + parts[-1][-30:], parts[0][5:]]
        doc = np.sort(np.array([rng.randrange(6) for _ in parts]))
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        flat = [x for p in parts for x in p]
        first, want = {}, []
        places = [(d, k) for d, a, b in zip(doc.tolist(), at.tolist(), at[1:].tolist()) for k in range(a, b - 12)]
        for d, k in places:
            first.setdefault(tuple(flat[k:k + 13]), d)
        want = [k for d, k in places if first[tuple(flat[k:k + 13])] < d]
        assert substrings.parse(doc, at, np.array([ord(x) for x in flat], np.uint64)).tolist() == want


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_one_passage_in_many_documents_crowds_no_task(spark, monkeypatch, unit):
    """A passage in every document, between words of their own: what one anchor gets is bounded, and the rows are those of the plain version."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(k, f"{' '.join(f'a{rng.random():.7f}' for _ in range(14))} {passage} {' '.join(f'z{rng.random():.7f}' for _ in range(14))}") for k in range(3000)]
    monkeypatch.setattr(repeats, "SLICE_BYTES", 20_000)
    kind, remove, decide, want = ((substrings.WORDS, substrings.remove, substrings.parse, plain.word_removal(docs)) if unit == "word"
                                  else (suffixes.BYTES, suffixes.remove, suffixes.sift, plain.byte_removal(docs)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).cache()
    dealt = repeats._dealt(repeats._bodies(df, "doc_id", "text"), kind, decide, 64)
    anchors = collections.Counter(a for r in dealt.where("not direct").collect() for a in repeats._unpack([r.payload], repeats.CLUSTER)["anchor"].tolist())
    assert max(anchors.values()) <= 4 * (repeats.ANCHOR_ROWS + 1)
    spans = repeats.spans
    monkeypatch.setattr(repeats, "spans", lambda d, k, f, i, t: spans(d, k, f, i, t, 4000, 200))
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in remove(df).collect()} == {w[0]: (w[2], w[-1]) for w in want}


def test_op9(spark, sf_dir, docs):
    got = entry.queries()["op9_lm_scores"](spark, sf_dir).collect()
    want = plain.unigram(texts(docs))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 4))
    for r, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(r)[:5] == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    unigram = np.full(scoring.CLASSES, 1.0)
    unigram[:10] = 300
    unigram /= unigram.sum()
    model = scoring.Model(unigram)
    learner = scoring.Learner(model, unigram, 1)
    one = rng.choice(scoring.CLASSES, 60_000, p=unigram)
    target = np.where(rng.random(60_000) < 0.8, (one + 1) % 10, rng.choice(scoring.CLASSES, 60_000, p=unigram))
    two = np.full(60_000, scoring.BEFORE)

    def loss():
        a1, a2, total = model.log_probabilities()
        every = np.exp(a1[3].astype(np.float64) + a2[5] - total[3, 5])
        assert every.sum() == pytest.approx(1)
        return -np.mean(a1[one, target] + a2[two, target] - total[one, two])

    before = loss()
    for k in range(0, 60_000, 6000):
        learner.learn(target[k:k + 6000], one[k:k + 6000], two[k:k + 6000])
    assert loss() < before - 0.3


def test_averaging_in_levels(spark, monkeypatch):
    unigram = np.full(scoring.CLASSES, 1 / scoring.CLASSES)
    docs = spark.createDataFrame([(k, f"a b c {k}") for k in range(12)], "doc_id bigint, text string").repartition(6)
    train = scoring._rows(docs, "doc_id", "text")
    words = scoring.Words()
    flat = scoring.averaged(train, scoring.Model(unigram), words, unigram)
    levels = scoring.averaged(train, scoring.Model(unigram), words, unigram, fan=2)
    assert np.allclose(flat, levels, atol=1e-5)
