"""Whole Arrow columns of texts as numpy arrays: words, lines and their hashes without a loop over rows.

Hashes are polynomials modulo 2**64 over prefix sums, then mixed, so that the hash of
any stretch costs two look-ups. Two different stretches collide with a chance of about 1e-19.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words.
SPACES = b" \t\n\x0b\x0c\r"
#: Texts that are worked on together hold so many bytes, or are one longer text.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def member(chars: bytes) -> np.ndarray:
    """Look-up table: is a byte one of ``chars``."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column in a row, and where each text starts and ends; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the final steps of a public mixing function)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of the base and of its inverse, grown when a longer slice comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            a, b = np.full(n, _BASE), np.full(n, _BACK)
            a[0] = b[0] = 1
            self.up, self.down = np.cumprod(a), np.cumprod(b)
        return self.up[:n], self.down[:n]


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums from which ``stretch`` takes hashes."""
    up, _ = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Mixed hashes of the stretches from ``start`` to before ``end``; they also depend on the length."""
    _, down = powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    return data.astype(np.uint64) + np.uint64(1)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words start and end among them."""
    ink = ~member(SPACES)[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    before[first] = after[last] = False
    start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(start, at)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def owner(at: np.ndarray) -> np.ndarray:
    """For each item, the text that it belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of an item's values over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def windows(at: np.ndarray, n: int) -> np.ndarray:
    """Starts of all runs of ``n`` items inside one text."""
    ok = np.zeros(int(at[-1]) + 1, np.int32)
    lengths = np.diff(at)
    fit = lengths >= n
    np.add.at(ok, at[:-1][fit], 1)
    np.add.at(ok, at[1:][fit] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` items lie in one of the runs of ``n`` that begin at ``starts``."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys: which occur twice or more, and which of those are not the first."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    again = np.zeros(len(k), bool)
    again[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    often = np.zeros(len(k), bool)
    often[order] = twice
    return often, again
