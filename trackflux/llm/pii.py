"""Personal data: regular expressions propose spans, checks confirm them, words nearby move their score.

A detector proposes by a pattern, starts from a score of its own, gains what its check confirms (or loses the span if the check is
binding) and gains again if one of its context words stands within ``NEAR`` code points. Spans that reach ``LEAST`` stay. The four base kinds
have binding checks and a score that suffices by itself; the other kinds need a checksum, a context word or both.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflux.llm import columns as col
from trackflux.llm.frames import numbered, thin_batches

#: Code points on either side of a span in which context words count, and the score that a span needs.
NEAR, LEAST = 48, 0.5

Span = tuple[int, int]


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The checksum of card numbers: every second digit from the right is doubled."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (ord(c) - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(digits: str) -> int:
    """The number modulo 97, digit by digit, so that its length does not matter."""
    rest = 0
    for c in digits:
        rest = (rest * 10 + ord(c) - 48) % 97
    return rest


def is_iban(s: str) -> bool:
    """Country and check digits go to the end, letters become 10 to 35; the number leaves 1 modulo 97."""
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and mod97("".join(str(int(c, 36)) for c in s[4:] + s[:4])) == 1


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 9 <= len(digits_of(s)) <= 15


def is_ssn(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_dni(s: str) -> bool:
    """Eight digits and a control letter, their remainder modulo 23."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8].upper()


def is_nir(s: str) -> bool:
    """Thirteen digits and a key, 97 less their remainder modulo 97."""
    d = digits_of(s)
    return 97 - mod97(d[:13]) == int(d[13:])


def is_mixed(s: str) -> bool:
    """Letters and digits in turn, as in random keys: at least one change between them for every eight characters."""
    kinds = [c.isdigit() for c in s if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) * 8 >= len(s)


def emails(text: str) -> Iterator[Span]:
    """From each ``@``: the name before it, not reaching into the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def matches(pattern: str) -> Callable[[str], Iterator[Span]]:
    found = re.compile(pattern).finditer
    return lambda text: (m.span() for m in found(text))


def ibans(text: str) -> Iterator[Span]:
    """Blocks of four; what follows in capitals may not belong to it, so the longest valid run of whole blocks is taken."""
    for m in _IBAN.finditer(text):
        start, end = m.span()
        while end - start >= 15 and not is_iban(text[start:end]):
            cut = text.rfind(" ", start, end)
            end = cut if cut >= 0 else start
        if end - start >= 15:
            yield start, end


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


@dataclass(frozen=True)
class Detector:
    kind: str
    propose: Callable[[str], Iterator[Span]]
    score: float  # of a proposal
    check: Callable[[str], bool] | None = None
    confirmed: float = 0.0  # what the check adds
    binding: bool = False  # without the check's consent there is no span
    context: tuple[str, ...] = ()
    nearby: float = 0.35  # what a context word adds


#: The patterns of the four base kinds are fixed; possessive repeats only save the engine the way back, which never leads to a match.
#: A digit run is tried at its start only, as a match that began inside it would have to fail or succeed like one from its start.
DETECTORS = (
    Detector("email", emails, 0.9),
    Detector("ip", matches(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), 0.6, is_ip, 0.1, True, ("ip", "host", "server", "address", "adresse", "dirección")),
    Detector("card", matches(r"[0-9](?:[\x20-]?[0-9])++"), 0.5, is_card, 0.3, True, ("card", "visa", "mastercard", "amex", "credit", "carte", "karte", "tarjeta")),
    Detector("phone", matches(r"\+[0-9][\x20().0-9-]+[0-9]"), 0.5, is_phone, 0.2, True, ("tel", "phone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono")),
    Detector("iban", ibans, 0.4, is_iban, 0.4, True, ("iban", "bic", "swift", "bank", "account", "konto", "compte", "cuenta")),
    Detector("ssn", matches(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.1, is_ssn, 0.2, True, ("ssn", "social", "security", "taxpayer")),
    Detector("dni", matches(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Za-z](?![A-Za-z0-9])"), 0.0, lambda s: is_dni(s.replace("-", "")), 0.2, True, ("dni", "nif", "identidad", "documento")),
    Detector("nir", matches(r"(?<![0-9])[12](?: ?[0-9]{2}){3}(?: ?[0-9]{3}){2} ?[0-9]{2}(?![0-9])"), 0.1, is_nir, 0.3, True, ("nir", "insee", "sécurité", "sociale")),
    Detector("secret", matches(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])"), 0.1, is_mixed, 0.2, True,
             ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer", "passwort", "schlüssel", "clave", "contraseña")),
    Detector("call", matches(r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9])"), 0.0, lambda s: 7 <= len(digits_of(s)) <= 12, 0.2, True,
             ("tel", "phone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono")),
)
BASE = 4


def _near(words: tuple[str, ...]) -> re.Pattern | None:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", re.IGNORECASE) if words else None


def scan(text: str, detectors: tuple[Detector, ...] = DETECTORS, base: int = BASE, least: float = LEAST, near: int = NEAR) -> list[tuple[int, int, int, float]]:
    """(start, end, number of the detector, score), by start, then by the order of the detectors.

    Spans of the first ``base`` detectors may overlap those of other kinds and always stay. A further span gives way to every base span that it
    touches, and to a further one of higher score (then the earlier detector, then the earlier start).
    """
    found: list[list[tuple[int, int, int, float]]] = [[], []]
    for k, d in enumerate(detectors):
        words = _near(d.context)
        for start, end in d.propose(text):
            score = d.score
            if d.check:
                if d.check(text[start:end]):
                    score += d.confirmed
                elif d.binding:
                    continue
            if words and (words.search(text, max(0, start - near), start) or words.search(text, end, end + near)):
                score += d.nearby
            if k < base or score >= least - 1e-9:
                found[k >= base].append((start, end, k, round(min(score, 1.0), 2)))
    kept = sorted(found[0])
    taken = _merged([(s, e) for s, e, _, _ in kept])
    for s, e, k, score in sorted(found[1], key=lambda x: (-x[3], x[2], x[0])):
        i = bisect_left(taken, (e, e))  # the last stretch that begins before the span's end
        if i == 0 or taken[i - 1][1] <= s:
            taken.insert(i, (s, e))
            kept.append((s, e, k, score))
    return sorted(kept, key=lambda x: (x[0], x[2]))


def _merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find(docs: DataFrame, text: str = "text", detectors: tuple[Detector, ...] = DETECTORS, least: float = LEAST) -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, score), ``start`` and ``end`` in code points, ``end`` exclusive.

    Rows are judged one by one: repeated rows, equal ids and null ids are rows like others. Null and empty texts have an empty array. Texts are
    scanned whole; every pattern takes time in proportion to the text, so memory and time of a task follow its longest text. A column
    called ``pii`` gives way; all others pass, whatever they are called. An empty table gives an empty one.
    """
    plain, names = numbered(docs.drop("pii") if text != "pii" else docs)
    body = plain.columns[names.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.slices(batches, body):
            rows = [[{"kind": detectors[k].kind, "start": s, "end": e, "score": x} for s, e, k, x in scan(t, detectors, least=least)] if t else []
                    for t in batch.column(batch.schema.get_field_index(body)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(_SPAN))], [*batch.schema.names, "pii"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return thin_batches(plain).mapInArrow(run, schema + ", pii array<struct<kind: string, start: bigint, end: bigint, score: double>>").toDF(*names, "pii")


def redact(docs: DataFrame, text: str = "text", detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """``docs`` with each stretch of personal data replaced by the kind that begins it, in angle brackets; overlapping spans are one. A null text stays null.

    All columns keep their names and places; rows as in ``find``.
    """
    names = docs.columns
    plain, _ = numbered(docs)
    body = plain.columns[names.index(text)]

    def clean(t: str) -> str:
        out, done = [], 0
        for s, e, k, _ in scan(t, detectors):
            if s >= done:
                out += [t[done:s], f"<{detectors[k].kind.upper()}>"]
            done = max(done, e)
        return "".join(out) + t[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.slices(batches, body):
            at = batch.schema.get_field_index(body)
            yield batch.set_column(at, body, pa.array([t and clean(t) for t in batch.column(at).to_pylist()], pa.string()))

    return thin_batches(plain).mapInArrow(run, plain.schema).toDF(*names)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, numbers of the base kinds, the digest of their spans, all spans, and the number of further spans and their least score."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    kinds = [d.kind for d in DETECTORS[:BASE]]
    base = F.filter("pii", lambda x: x["kind"].isin(kinds))
    more = F.filter("pii", lambda x: ~x["kind"].isin(kinds))

    def number(kind: str):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    found = find(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return found.select(
        "doc_id", *[number(k) for k in kinds],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"),
        F.size(more).cast("bigint").alias("n_more"), F.array_min(F.transform("pii", lambda x: x["score"])).alias("least_score"))
