"""Hashed character n-grams of whole texts as numpy arrays, a block of words at a time.

A rolling polynomial over code points gives the hash of any run of characters
from two prefix sums, so n-grams and words cost a few array passes and no
dictionary of words is kept. Memory follows the block, not the text; only a
single run without white space is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Characters of a block, about.
BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Told apart by length of the n-gram; 0 is for whole words.
_SALT = np.multiply.accumulate(np.full(32, 0xA0761D6478BD642F, np.uint64))
_SPACE = np.array([chr(c).isspace() for c in range(1 << 16)])
_ALNUM = np.array([chr(c).isalnum() for c in range(1 << 16)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i < n."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(2 * BLOCK)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (_UP, _DOWN) if n <= len(_UP) else _powers(n)


def pieces(texts: Iterable[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Lower-cased texts in blocks of about BLOCK characters: lists of (number of text, part of it).

    Long texts are cut at white space only.
    """
    block, size = [], 0
    for k, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            end = min(len(text), at + max(1, BLOCK - size))
            while end < len(text) and not text[end].isspace():
                end += 1
            block.append((k, text[at:end]))
            size += end - at
            at = end
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


@dataclass
class Words:
    """Words of a block: `text` is the number of each word's text, `length` its characters.

    `marked` holds the code points of all words with one mark (0) before, between
    and behind; word k begins behind the mark at `start[k]`.
    """

    text: np.ndarray
    length: np.ndarray
    start: np.ndarray
    marked: np.ndarray
    _prefix: np.ndarray | None = None
    _next: np.ndarray | None = None

    def _prepare(self) -> None:
        n = len(self.marked)
        up, self._down = _power(n + 1)
        self._prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.marked.astype(np.uint64) + np.uint64(7)) * up[:n])))
        self._next = np.repeat(self.start + self.length + 1, self.length + 1).astype(np.int64)

    def hashes(self, n: int, buckets: int) -> np.ndarray:
        """Bucket of the n-gram from each place of `marked` but the last mark's; `buckets` where it isn't within one marked word."""
        if self._prefix is None:
            self._prepare()
        m = len(self._next)
        k = min(m, m + 2 - n)
        out = np.full(m, buckets, np.int64)
        if k > 0:
            h = (self._prefix[n : n + k] - self._prefix[:k]) * self._down[:k] * _MIX ^ _SALT[n]
            h = ((h * _MIX) >> np.uint64(32)) % np.uint64(buckets)
            inside = np.arange(n - 1, n - 1 + k) <= self._next[:k]
            out[:k] = np.where(inside, h.astype(np.int64), buckets)
        return out

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each whole word."""
        if self._prefix is None:
            self._prepare()
        end = self.start + self.length + 2
        return ((self._prefix[end] - self._prefix[self.start]) * self._down[self.start] * _MIX ^ _SALT[0]) * _MIX

    def whole(self, buckets: int) -> np.ndarray:
        """Bucket of each whole word."""
        return ((self.keys() >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def run_keys(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run codes[begin:end], of different polynomials."""
    up, down = _power(len(codes) + 1)
    wide = codes.astype(np.uint64)
    out = []
    for values in (wide + np.uint64(7), (wide + np.uint64(11)) * (wide ^ np.uint64(0x5BD1)) + np.uint64(3)):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(codes)])))
        h = (prefix[end] - prefix[begin]) * down[begin] * _MIX
        out.append((h ^ (h >> np.uint64(32))) * _MIX)
    return out[0], out[1]


def words(block: list[tuple[int, str]]) -> Words:
    """Words of a block: runs without white space, from their first to their last letter or digit."""
    joined = " ".join(part for _, part in block)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(codes, 0xFFFF)
    alnum = np.flatnonzero(np.where(codes > 0xFFFF, True, _ALNUM[low]))
    of = np.cumsum(_SPACE[low] & (codes <= 0xFFFF))[alnum]
    if not len(alnum):
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.zeros(1, np.uint32))
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    begin, end = alnum[first], alnum[np.concatenate((first[1:], [len(alnum)])) - 1] + 1
    length = end - begin
    start = np.concatenate(([0], np.cumsum(length + 1)))
    marked = np.zeros(int(start[-1]) + 1, np.uint32)
    spread = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    marked[np.repeat(start[:-1] + 1, length) + spread] = codes[np.repeat(begin, length) + spread]
    sizes = np.array([len(part) for _, part in block], np.int64)
    bounds = np.cumsum(sizes + 1)
    text = np.array([k for k, _ in block], np.int64)[np.searchsorted(bounds, begin, "right")]
    return Words(text, length, start[:-1], marked)
