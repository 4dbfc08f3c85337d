"""Words of many texts at once: hashes, places, and min-hash bands of the beginnings of the texts."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

SHINGLE, BANDS, ROWS = 5, 10, 4
#: each length of a beginning is so many times the one before
STEP = 1.25
#: how much more of a partner can matter to a text of that length: alignment allows a tenth
REACH = 1.1

_random = np.random.default_rng(20240601)
_A = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)  # odd: it has an inverse
_R_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: no letters beyond
_LETTERS = 0x33480


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 none, 1 letter or digit, 2 a sign that is a word by itself (Han, kana), 3 Hangul."""
    out = np.zeros(0x110000, np.uint8)
    out[:_LETTERS] = np.char.isalnum(np.arange(_LETTERS, dtype=np.uint32).view("U1"))
    out[0x3041:0x3100] = out[0x3400:0xA000] = out[0xF900:0xFB00] = 2
    out[0xAC00:0xD7A4] = 3
    return out


@functools.cache
def _apart() -> np.ndarray:
    """The same with decimal digits (4) apart from letters."""
    out = _classes().copy()
    out[:_LETTERS][np.char.isdecimal(np.arange(_LETTERS, dtype=np.uint32).view("U1"))] = 4
    return out


_powers = np.ones((2, 1), np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of the base and of its inverse up to ``n``."""
    global _powers
    if _powers.shape[1] <= n:
        size = max(n + 1, 1 << 16, 2 * _powers.shape[1])
        _powers = np.stack([np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)])) for x in (_R, _R_BACK)])
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@functools.cache
def levels(most: int) -> np.ndarray:
    """Lengths in words of the beginnings that are compared, up to ``most``: 5, 6, 8, 10, 12, 15, ..."""
    out = [float(SHINGLE)]
    while round(out[-1] * STEP) <= most:
        out.append(out[-1] * STEP)
    return np.unique(np.round(out).astype(np.int64))


def slices(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Stretches of rows that have at most ``most`` letters together, or one row."""
    start = stop = total = 0
    for stop, n in enumerate(sizes):
        if stop > start and total + n > most:
            yield slice(start, stop)
            start, total = stop, 0
        total += n
    if total or stop > start:
        yield slice(start, stop + 1)


class Words:
    """The words of a list of texts: ``hash``, ``start`` and ``stop`` (places in all texts joined), ``first`` (number of the first word of each text) and ``count``.

    Han and kana signs are words by themselves; letter case does not count. ``digits_apart``: numbers are cut off from letters.
    """

    def __init__(self, texts: list[str], digits_apart: bool = False, classes: np.ndarray | None = None):
        """``classes``: another class for each code point; signs of class 2 are words by themselves, runs of any other are one word."""
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.size) - self.size
        total = int(self.size.sum())
        codes = np.frombuffer("".join(map(lowered, texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = (classes if classes is not None else _apart() if digits_apart else _classes())[codes]
        new = np.ones(total + 1, bool)  # a word or a gap begins here
        new[1:total] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[self.begin[self.size > 0]] = True
        at = np.flatnonzero(new)
        word = kind[at[:-1]] > 0
        self.start, self.stop = at[:-1][word], at[1:][word]
        self.number = kind[self.start] == 4
        self._sums = self._cumulated(codes)
        self.hash = self.stretch(self.start, self.stop)
        edges = np.searchsorted(self.start, np.append(self.begin, total))
        self.first, self.count = edges[:-1], np.diff(edges)

    @staticmethod
    def _cumulated(codes: np.ndarray) -> np.ndarray:
        """Sums of mixed codes times powers: the hash of a stretch is a difference, moved to the beginning of the stretch."""
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _power(len(codes))[0, :len(codes)], out=sums[1:])
        return sums

    def stretch(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of stretches in lower case."""
        return _mix((self._sums[stop] - self._sums[start]) * _power(len(self._sums))[1, start])

    @functools.cached_property
    def _raw_sums(self) -> np.ndarray:
        return self._cumulated(np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32))

    def beginnings(self, text: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Hash of each text up to the end of that many words, as it is written; of the whole words it has where these are fewer."""
        k = np.minimum(words, self.count[text])
        stop = np.where(k > 0, self.stop[np.maximum(self.first[text] + k - 1, 0)], self.begin[text])
        return _mix((self._raw_sums[stop] - self._raw_sums[self.begin[text]]) * _power(len(self._raw_sums))[1, self.begin[text]]).view(np.int64)

    @functools.cached_property
    def _shingles(self) -> np.ndarray:
        """Hash of the five words from each word on; those that reach into the next text are never used."""
        h = self.hash * _R
        for k in range(1, SHINGLE):
            later = np.concatenate([self.hash[k:], np.zeros(min(k, len(h)), np.uint64)])[:len(h)]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + later
        return h

    def keys(self, bands: range = range(BANDS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, level, keys): for each text of five words and more and each level up to its length, one 64-bit key per band."""
        some = np.flatnonzero(self.count >= SHINGLE)
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(bands)), np.int64)
        steps = levels(int(self.count.max()))
        many = np.searchsorted(steps, self.count[some], "right")  # levels of each text
        # shingles up to the last level, cut where the next level begins
        used = steps[many - 1] - SHINGLE + 1
        offset = np.cumsum(used) - used
        at = np.repeat(self.first[some] - offset, used) + np.arange(int(used.sum()))
        h = self._shingles[at]
        owner = np.repeat(np.arange(len(some)), many)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        edge = offset[owner] + np.where(level > 0, steps[np.maximum(level - 1, 0)] - SHINGLE + 1, 0)
        out = np.empty((len(owner), len(bands)), np.uint64)
        least = np.full((len(some), len(steps)), ~np.uint64(0))
        for i, b in enumerate(bands):
            key = _mix((level + 1).astype(np.uint64) * np.uint64(1000003) + np.uint64(b))
            for r in range(b * ROWS, (b + 1) * ROWS):
                x = h * _A[r] + _B[r]
                x ^= x >> np.uint64(32)
                least[owner, level] = np.minimum.reduceat(x, edge)
                key = _mix(key ^ np.minimum.accumulate(least, axis=1)[owner, level])
            out[:, i] = key
        return some[owner], level, out.view(np.int64)


def reach(level: np.ndarray, most: int) -> np.ndarray:
    """Words of a partner that can matter to a text whose longest compared beginning is of that level."""
    steps = levels(max(most, SHINGLE))
    return np.ceil(steps[level] * STEP * REACH).astype(np.int64) + 3


def shared(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the different shingles of ``a`` (word hashes) that ``b`` has: 1 where a is part of b."""
    def shingles(h: np.ndarray) -> np.ndarray:
        if len(h) < SHINGLE:
            return np.array([functools.reduce(lambda x, y: x * 31 + int(y), h.tolist(), 7) & (1 << 63) - 1], np.uint64)
        return np.unique(functools.reduce(lambda x, k: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:len(h) - SHINGLE + 1 + k], range(1, SHINGLE), h[:len(h) - SHINGLE + 1] * _R))

    x = shingles(a)
    return float(np.isin(x, shingles(b)).mean()) if len(x) else 0.0
