"""Plain versions of the operators, written for clarity and small inputs."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import zlib

A_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 70


def words(text):
    return (text or "").encode().split()


def lowered(text):
    return (text or "").encode().translate(A_Z).split()


def payload_digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def warc(pages):
    """(page_id, bytes, digest, type, refers_to) of each page."""
    best = {}
    for i, html in pages:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, html in pages:
        again = i is not None and i < best[html or ""]
        out.append((i, len((html or "").encode()), payload_digest(html), "revisit" if again else "response", best[html or ""] if again else None))
    return out


def shingles(text, n=5):
    w = lowered(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_groups(docs):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    members = collections.defaultdict(list)
    for k in range(len(docs)):
        members[root(k)].append(k)
    out = []
    for k, (i, _) in enumerate(docs):
        group = [docs[m][0] for m in members[root(k)]]
        ids = [g for g in group if g is not None]
        least = min(ids) if ids else None
        out.append((i, len(sets[k]), least, len(group) == 1 or (i is not None and i == least)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, {n: dup_ngram_chars}."""
    w = words(text)
    chars = [len(x.decode()) for x in w]
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    seen, again, line_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            again += 1
            line_chars += sum(len(y.decode()) for y in x.split())
        seen.add(x)

    def cover(n, first):
        grams = [tuple(w[k:k + n]) for k in range(len(w) - n + 1)]
        count, met, inside = collections.Counter(grams), set(), set()
        for k, g in enumerate(grams):
            if count[g] > 1 and (first or g in met):
                inside.update(range(k, k + n))
            met.add(g)
        return inside

    return (len(w), sum(chars), sum(c in "#*$%&|<>" for c in text or ""), again, len(cover(3, True)), line_chars,
            {n: sum(chars[k] for k in cover(n, False)) for n in range(5, 11)})


def passes(text):
    n, chars, _, _, repeat, line_chars, grams = quality(text)
    base_failed = n < 50 or 100 * repeat > 50 * n
    return base_failed, not base_failed and line_chars <= 0.2 * chars and all(v <= 0.2 * chars for v in grams.values())


def exact(docs):
    """(doc_id, keep_id, group_size, kept, sha256) of each row."""
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for i, t in docs:
        g = groups[t or ""]
        ids = [x for x in g if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def word_removal(docs, size=13):
    """(doc_id, n_words, n_removed, sha256) of each row."""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            x = tuple(w[k:k + size])
            first[x] = min(first.get(x, LAST), LAST if i is None else i)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (LAST if i is None else i):
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def byte_removal(docs, size=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row; ids must differ unless rows are equal."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            x = b[k:k + size]
            first[x] = min(first.get(x, (LAST + 1, 0)), (LAST if i is None else i, k))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k:k + size]] < (LAST if i is None else i, k):
                gone[k:k + size] = b"\1" * size
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def unigram(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    tokens = [[*lowered(t), None] for _, t in docs]
    count = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
    total, room = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    return [(i, h, len(t), sum(count[x] > 0 for x in t), total, sum(math.log10((count[x] + 0.1) / room) for x in t))
            for (i, _), h, t in zip(docs, held, tokens)]
