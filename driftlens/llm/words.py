"""Words of a batch of texts as numpy arrays: bounds, documents and hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from driftlens.llm.common import LOWER, mix64

_LOWER = np.frombuffer(LOWER, np.uint8)
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Everything but space and the control characters tab to carriage return.
VISIBLE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next batch."""
    if len(_powers[base]) < n:
        grown = np.full(max(n, 2 * len(_powers[base]), 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown)
    return _powers[base][:n]


def power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, for hashes of any span from one running sum."""
    return _power(_BASE, n), _power(_INVERSE, n)


def blocks(texts: list[bytes], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes together; a longer text is a block of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of the given texts: start, end (in .bytes) and doc of each, in order; n is the number of texts."""

    def __init__(self, texts: list[bytes], kind: np.ndarray = ALNUM):
        self.n = len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        edge = np.flatnonzero(np.diff(kind[self.bytes].view(np.int8), prepend=0))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self._sums: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each lower-cased word, or of its first prefix bytes, and of the length hashed."""
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((_LOWER[self.bytes].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(self.bytes)), out=self._sums[1:])
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        value = (self._sums[end] - self._sums[self.start]) * _power(_INVERSE, len(self.bytes))[self.start]
        return mix64(value ^ (end - self.start).astype(np.uint64))


def word_hash(word: str) -> int:
    return int(Words([word.encode()]).hashes()[0])
