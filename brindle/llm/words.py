"""Words of UTF-8 texts as NumPy arrays: positions, 64-bit digests and shingles without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text makes a block of its own.
BLOCK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_NEXT = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Bytes of the words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(max(n, BLOCK + 1024), base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tuple(tables)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `limit` bytes: (first row, end row, bytes, offsets)."""
    raw, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65_536)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each text the index of its first word (one more at the end)."""
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    before[offs] = False
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    after[offs] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each word, A-Z read as a-z: a polynomial with random byte values, mixed."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _power_tables(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A digest of each k consecutive words (fewer than k: none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _NEXT
        h += words[j : j + n]
    return mix(h)


def whole(words: np.ndarray) -> np.uint64:
    """The digest that runs() gives to all of these words."""
    return runs(words, len(words))[0]


def stretches(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of each stretch words[first[i]:end[i]], of any length."""
    up, down = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
