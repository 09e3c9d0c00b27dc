"""Words, word hashes and shingles of many texts at once, on the UTF-8 buffers of Arrow.

A *word* is a run of ASCII letters, digits and non-ASCII bytes; ASCII and Latin-1 letters are
lower-cased.  Word hashes are polynomial hashes modulo 2**64 taken from one running sum over
the buffer, so no Python object is made for a word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import CHUNK_BYTES

SHINGLE_WORDS = 5
#: Shingle ids have 48 bits: 16 bits stay free for the number of a document within its step.
ID_BITS = 48
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return offs, data


def steps(offs: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 15):
    """Row ranges of at most ``limit`` bytes (or one row) and ``rows`` rows."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = max(a + 1, min(b, a + rows, n))
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _byte_tables():
    low = np.zeros(256, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalnum():
            low[c] = ord(chr(c).lower()) if c < 128 else c
    value = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
    return low, value


_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """The words of a step of texts: ``hash`` per word, ``first`` (word index per text, one more
    at the end), ``start``/``end`` byte positions within the step."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low_of, value_of = _byte_tables()
        base = int(offs[0])
        raw = data[base:int(offs[-1])]
        offs = offs - base
        n = len(raw)
        self.raw, self.offs = raw, offs
        if not n:
            self.hash = np.zeros(0, np.uint64)
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offs), np.int64)
            return
        low = low_of[raw]
        up = np.flatnonzero(raw[:-1] == 0xC3) + 1  # capital Latin-1 letters: C3 80 .. C3 9E
        up = up[(raw[up] >= 0x80) & (raw[up] <= 0x9E) & (raw[up] != 0x97)]
        low[up] += 0x20
        is_word = low != 0
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        heads = offs[:-1][offs[:-1] < n]
        begins[heads] = is_word[heads]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:]
        tails = offs[1:][offs[1:] > 0] - 1
        ends[tails] = is_word[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        pw, inv = _powers_to(n)
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum(value_of[low] * pw, out=run[1:])
        h = (run[self.end] - run[self.start]) * inv[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offs)


def shingle_ids(w: Words, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text of a step.

    Returns (first, ids, counts): text i has ``ids[first[i]:first[i + 1]]``, ascending, each with
    its number of occurrences.  A text of 1 to k - 1 words has one shingle of all its words; a
    text without words has none."""
    h, n_words = w.hash, np.diff(w.first)
    n_docs = len(n_words)
    keys = []
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s = s * _U(0xD6E8FEB86659FD93) + h[j:len(h) - k + 1 + j]
        doc = np.repeat(np.arange(n_docs, dtype=np.uint64), n_words)[:len(s)]
        whole = np.arange(len(s)) + k <= np.repeat(w.first[1:], n_words)[:len(s)]
        keys.append((doc[whole] << _U(ID_BITS)) | (mix(s[whole]) >> _U(64 - ID_BITS)))
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        s = _U(n_words[d])
        with np.errstate(over="ignore"):
            for x in h[w.first[d]:w.first[d + 1]]:
                s = s * _U(0xD6E8FEB86659FD93) + x
        keys.append((np.array([d], np.uint64) << _U(ID_BITS)) | (mix(np.array([s], np.uint64)) >> _U(64 - ID_BITS)))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if not len(key):
        return np.zeros(n_docs + 1, np.int64), key, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.append(at, len(key)))
    key = key[at]
    first = np.searchsorted(key >> _U(ID_BITS), np.arange(n_docs + 1, dtype=np.uint64))
    return first, key & _U((1 << ID_BITS) - 1), counts
