"""Terms of many texts at once, read in blocks of bytes, so that no text is too long for a task.

A *term* is a maximal run of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased.  A block
holds the terms that start in it; a term's hash is a polynomial modulo 2**64 over its bytes, taken from
one running sum over the block, and terms longer than ``longest`` bytes are counted but not hashed.
"""

from __future__ import annotations

import numpy as np

from .vectext import _U, _powers_to, mix

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _low_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else 0 for c in range(128)]
    return low


LOW = _low_table()
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


class Block:
    """The terms that start in one block: ``at`` their first byte in the column's buffer, ``size`` their
    bytes (``longest + 1`` for any longer one), ``text`` the number of the text they stand in."""

    def __init__(self, data, offs, a, b, longest):
        edge = int(offs[-1])
        z = min(b + longest + 1, edge)
        self.base, self.width, self.low = a, b - a, LOW[data[a:z]]
        inside = self.low != 0
        heads = offs[np.searchsorted(offs, a):np.searchsorted(offs, z)] - a
        new = np.ones(len(inside), bool)
        new[1:] = ~inside[:-1]
        new[0] = a == offs[0] or LOW[data[a - 1]] == 0
        new[heads] = True
        start = np.flatnonzero(new[:b - a] & inside[:b - a])
        stop = np.flatnonzero(~inside | new)  # a term ends at the next byte that isn't in one, or at the next text
        stop = np.append(stop, len(inside))
        self.start = start
        self.end = np.minimum(stop[np.searchsorted(stop, start, side="right")], start + longest + 1)
        self.at, self.size = start + a, self.end - start
        self.text = np.searchsorted(offs, self.at, side="right") - 1
        up, self._down = _powers_to(len(inside))
        self._run = np.zeros(len(inside) + 1, np.uint64)
        np.cumsum(_VALUE[self.low] * up, out=self._run[1:])

    def hashes(self) -> np.ndarray:
        return mix((self._run[self.end] - self._run[self.start]) * self._down[self.start] + self.size.astype(np.uint64))

    def prefix_hashes(self, k: int) -> np.ndarray:
        """Hash of each term's first ``k`` bytes (0 for terms of less than ``k``)."""
        end = np.minimum(self.start + k, len(self.low))
        h = mix((self._run[end] - self._run[self.start]) * self._down[self.start] + _U((1 << 32) + k))
        return np.where(self.size >= k, h, _U(0))


def blocks(data: np.ndarray, offs: np.ndarray, longest: int, size: int = BLOCK_BYTES):
    """The blocks of a string column's buffer that hold any byte."""
    for a in range(int(offs[0]), int(offs[-1]), size):
        yield Block(data, offs, a, min(a + size, int(offs[-1])), longest)


def hash_terms(terms: list[bytes]) -> np.ndarray:
    """The hash of each given term, as ``Block.hashes`` has it."""
    if not terms:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(terms), np.uint8)
    sizes = np.array([len(t) for t in terms], np.int64)
    offs = np.concatenate(([0], np.cumsum(sizes + 1)))
    offs[-1] -= 1
    got = [b.hashes() for b in blocks(data, np.array([0, offs[-1]]), int(sizes.max()))]
    return np.concatenate(got)


class Lookup:
    """Numbers of the hashes that are in a given set; a bit map keeps most others from the search."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[(hashes >> _U(64 - self.BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h``, numbers in the set) of the hashes found."""
        at = np.flatnonzero(self.map[(h >> _U(64 - self.BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == h[at]
        return at[hit], self.order[place[hit]]
