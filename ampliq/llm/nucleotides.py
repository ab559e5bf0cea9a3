"""Nucleotide strings as the problems define them: letters A-Z in upper case, U read as T, all else dropped.

Kernels work on flat byte arrays of a whole Arrow batch; bytes outside ASCII are never letters.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

from ampliq.functions.bytescan import flat, mix64, row_sums

#: byte -> 1..26 for a letter in either case (U as T), 0 for a byte to skip.
FOLD = np.zeros(256, np.uint8)
for _i in range(26):
    FOLD[65 + _i] = FOLD[97 + _i] = _i + 1
FOLD[ord("U")] = FOLD[ord("u")] = FOLD[ord("T")]

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in _BASES:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


_LETTERS = tuple(np.append(np.uint64(0), mix64(np.arange(2, 28, dtype=np.uint64) * np.uint64(k))) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


#: The same fold for bytes.translate: what each byte becomes, and the bytes that are skipped.
_UPPER = bytes(int(c) + 64 if c else 0 for c in FOLD)
_SKIPPED = bytes(b for b in range(256) if not FOLD[b])
CHUNK = 1 << 16
BLOCK = 1 << 20


class Folded:
    """One batch as it was delivered: the raw bytes, each byte's fold (0 for one to skip), and the letters counted by row."""

    def __init__(self, column):
        self.raw, self.raw_offsets, self.valid = flat(column)
        self.fold = FOLD[self.raw]
        self.before = np.zeros(len(self.raw) + 1, np.int64)  # letters before each byte
        np.cumsum(self.fold > 0, out=self.before[1:])
        self.offsets = self.before[self.raw_offsets]
        self.lengths = np.diff(self.offsets)

    @functools.cached_property
    def at(self) -> np.ndarray:
        """Skip pointers: where each letter lies among the raw bytes."""
        return np.flatnonzero(self.fold)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two polynomial hashes by row, modulo 2**64, finalised with the number of letters.

        Every raw byte adds its fold's value times the base to the power of the letters before it in its row; a byte
        to skip adds nothing, so no string without such bytes is ever made.
        """
        place = self.before[:-1] - np.repeat(self.offsets[:-1], np.diff(self.raw_offsets))
        size = 1 << int(max(1, self.lengths.max(initial=1))).bit_length()
        out = []
        for power, value in zip(_powers(max(size, 512)), _LETTERS):
            total = row_sums(value[self.fold] * power[place], self.raw_offsets)
            out.append(mix64(total ^ self.lengths.astype(np.uint64)))
        return out[0].view(np.int64), out[1].view(np.int64)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a[k] and b[k] have the same letters: a pointer in each goes from letter to letter over the raw
        bytes, past those to skip, BLOCK steps of all pairs at a time."""
        equal = self.lengths[a] == self.lengths[b]
        n = np.where(equal & (a != b), self.lengths[a], 0)
        ends = np.concatenate(([0], np.cumsum(n)))
        for low in range(0, int(ends[-1]), BLOCK):
            step = np.arange(low, min(low + BLOCK, int(ends[-1])))
            pair = np.searchsorted(ends, step, "right") - 1
            step -= ends[pair]
            left, right = self.at[self.offsets[a[pair]] + step], self.at[self.offsets[b[pair]] + step]
            equal[pair[self.fold[left] != self.fold[right]]] = False
        return equal

    def text(self, row: int) -> bytes:
        """The row's raw bytes."""
        return self.raw[self.raw_offsets[row] : self.raw_offsets[row + 1]].tobytes()

    def digest(self, row: int) -> bytes:
        """MD5 of the row's letters, fed from CHUNK raw bytes at a time."""
        md5 = hashlib.md5()
        for at in range(int(self.raw_offsets[row]), int(self.raw_offsets[row + 1]), CHUNK):
            md5.update(self.raw[at : min(at + CHUNK, int(self.raw_offsets[row + 1]))].tobytes().translate(_UPPER, _SKIPPED))
        return md5.digest()

    def codes_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letter codes, offsets) of some rows, without the bytes to skip."""
        n = self.lengths[rows]
        ends = np.concatenate(([0], np.cumsum(n)))
        return self.fold[self.at[np.repeat(self.offsets[rows], n) + np.arange(ends[-1]) - np.repeat(ends[:-1], n)]], ends


def same_letters(a: bytes, b: bytes) -> bool:
    """Whether two raw texts have the same letters."""
    return bool(Folded(pa.array([a, b], pa.large_binary())).same(np.array([0]), np.array([1]))[0])


def first_of_key(h1: np.ndarray, h2: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For the rows in among (ascending): the first of them with the same pair of hashes."""
    order = np.lexsort((among, h2[among], h1[among]))
    a, b = h1[among][order], h2[among][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    first = np.empty(len(order), np.int64)
    first[order] = lead
    return among[first]

