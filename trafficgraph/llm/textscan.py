"""Vectorised scans over Arrow string columns: words, word hashes, row slices.

A whole Arrow buffer is scanned at once with numpy, so no Python code runs
per word. Word hashes are 64-bit polynomial (Karp-Rabin) hashes of the word's
bytes, mixed; equal words have equal hashes in every process.
"""

from __future__ import annotations

import ctypes
import gc
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20        # bytes hashed at a time; bounds temporary memory
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
_INV = pow(BASE, -1, 1 << 64)
_pw = np.ones(1, np.uint64)
_ipw = np.ones(1, np.uint64)

# Byte classes (True: not part of a word).
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.ones(256, bool)       # words of letters, digits and every non-ASCII byte
PUNCT[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
PUNCT[128:] = False
# Scripts written without spaces: each of their characters is a word of its own.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3031, 0x3035),
            (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
            (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x323AF)]
_kinds: list[np.ndarray] = []
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n-1 and its inverses modulo 2**64."""
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("_pw", BASE), ("_ipw", _INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            globals()[name] = np.multiply.accumulate(out)
    return _pw[:n], _ipw[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64 steps), new array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def returning(run):
    """``run`` (a function of batches) so that memory freed after each batch it
    makes, and at its end, goes back to the system: Python workers outlive
    their tasks, and an executor's other workers and heap need the room."""
    def bounded(batches):
        try:
            for out in run(batches):
                yield out
                del out
                _return_memory()
        finally:
            gc.collect()
            _return_memory()
    return bounded


def _return_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):      # not the GNU C library
        pass


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    _, offs, data = col.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64)[col.offset:col.offset + n + 1]
    d = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def _kind_of() -> np.ndarray:
    """0 for every code point that separates words, 1 in words (letters, marks, digits),
    2 a word of its own."""
    if not _kinds:
        t = np.zeros(0x110000, np.uint8)
        t[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LMN"]] = 1
        for lo, hi in UNSPACED:
            t[lo:hi + 1] *= 2
        _kinds.append(t)
    return _kinds[0]


def unicode_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with blanks for every non-ASCII character outside words, and the
    places where words end or begin besides (around characters of ``UNSPACED``)."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return data, np.zeros(0, np.int64)
    b = data[lead].astype(np.int64)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    code = np.where(size == 2, b & 0x1F, np.where(size == 3, b & 0x0F, b & 0x07))
    for j in range(1, 4):
        more = size > j
        code[more] = code[more] << 6 | (data[lead[more] + j] & 0x3F)
    kind = _kind_of()[code]
    out = data.copy()
    for j in range(4):
        out[lead[(kind == 0) & (size > j)] + j] = 0x20
    alone = kind == 2
    return out, np.unique(np.concatenate((lead[alone], lead[alone] + size[alone])))


def slices(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges holding at most ``limit`` bytes each (one row at least)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACES,
          hashes: bool = True, cuts: np.ndarray | None = None):
    """Words of all rows: ``(first, start, end, hash)``.

    ``first`` has one entry per row and one more: row r owns the words
    ``first[r]:first[r + 1]``. A-Z counts as a-z in the hashes. Rows always
    end words, as do the places ``cuts``. Work runs in blocks cut between words, so temporary memory does
    not follow the length of a row.
    """
    n = len(data)
    starts, ends, hs = [], [], []
    row_cut = offs if cuts is None else np.union1d(offs, cuts)
    row_cut = row_cut[(row_cut > 0) & (row_cut < n)]
    lo = 0
    while lo < n:
        hi = min(lo + BLOCK_BYTES, n)
        if hi < n:          # cut after the last separator or row end of the block
            part = sep[data[lo:hi]]
            last = len(part) - 1 - int(np.argmax(part[::-1])) if part.any() else -1
            k = int(np.searchsorted(row_cut, hi, "right")) - 1
            cut = max(lo + last + 1 if last >= 0 else lo, int(row_cut[k]) if k >= 0 else lo)
            while cut <= lo:      # one word longer than a block
                nxt = sep[data[hi:hi + BLOCK_BYTES]]
                k = int(np.searchsorted(row_cut, lo, "right"))
                at = hi + int(np.argmax(nxt)) if nxt.any() else min(hi + BLOCK_BYTES, n)
                row = int(row_cut[k]) if k < len(row_cut) else n
                hi = min(at, row)
                if nxt.any() or hi == row or hi >= n:
                    cut = hi
            hi = cut
        d = data[lo:hi]
        inside = ~sep[d]
        edge = np.zeros(hi - lo + 1, bool)
        edge[row_cut[np.searchsorted(row_cut, lo):np.searchsorted(row_cut, hi, "right")] - lo] = True
        edge[0] = edge[-1] = True
        s = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
        e = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
        if hashes and len(s):
            pw, ipw = _powers(hi - lo + 1)
            acc = _LOWER[d]
            acc *= pw[:hi - lo]
            np.cumsum(acc, out=acc)
            h = acc[e - 1]
            before = acc[s - 1]
            before[s == 0] = 0
            h -= before
            h *= ipw[s]
            hs.append(mix(h))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    return np.searchsorted(start, offs), start, end, h


def hash_words(texts: list[str], sep: np.ndarray = SPACES) -> list[np.ndarray]:
    """Word hashes of each text (small parameter tables)."""
    data, offs = utf8(pa.array(texts, pa.large_string()))
    first, _, _, h = words(data, offs, sep)
    return [h[first[i]:first[i + 1]] for i in range(len(texts))]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of ``k`` word hashes (rows ignored)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j:j + n]
    return mix(out)


def whole_runs(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the ``n - k + 1`` runs of ``k`` words lie inside one row."""
    ok = np.ones(max(n - k + 1, 0), bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
