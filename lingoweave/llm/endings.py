"""How texts end: closing marks, and a model of which words close a sentence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .langid import CODES
from .words import Words

#: signs after which a sentence is complete
FULL = ".!?。！？｡．؟।"
DOTS = re.compile(r"(?:\.{2,}|…+|⋯+|[-–—]+|[(（\[「『“\"'«<{]+)\s*$")


def bare(text: str) -> str:
    """The text without control codes, tags and outer blanks."""
    return CODES.sub(" ", text).strip("​﻿ \t\r\n　\xa0")


def ends_full(text: str) -> bool:
    """Whether the text, without codes, ends in a full stop or the like; two and more dots do not count."""
    t = bare(text)
    k = len(t)
    while k and not t[k - 1].isalnum() and t[k - 1] not in FULL:
        k -= 1
        if t[k] in "…⋯":
            return False
    return k > 0 and t[k - 1] in FULL and not t[:k].endswith("..")


_CLOSED = re.compile(r"[^\s.][.!?。！？](?![.])[\s\W\d½¼¾_]*$")


def closed(text: str) -> bool:
    """As ``ends_full``, but marks, numbers and dots may follow the full stop (``Ja. 20°``, ``はい。……``)."""
    return bool(_CLOSED.search(bare(text)[-60:]))


def _join(*parts: np.ndarray) -> np.ndarray:
    """Hash of hashes, in order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + p
    return out ^ (out >> np.uint64(32))


_BEGIN, _NUMBER = np.uint64(0xA076_1D64_78BD_642F), np.uint64(0xE703_7ED1_A0B4_28DB)

#: n-grams of one to four tokens, whole words and beginnings of words, and the same after their two tokens before
ORDERS = (1, 2, 3, 4)
KINDS = len(ORDERS) + 2


def _kind(keys: np.ndarray, kind: int) -> np.ndarray:
    """Keys of one kind, apart from those of others."""
    return _join(keys, np.full(len(keys), kind + 1, np.uint64))


def end_counts(units: list[str], weights: np.ndarray | None = None, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, a, b) of whole sentences and lines: of n-grams how often they end a unit and how often not, of strings how often they are a word (after two tokens: the same place)
    and how often the beginning of one (a longer one; after two tokens any). ``wanted``: which keys to count."""
    w = Words(units, digits_apart=True)
    some = np.repeat(np.arange(len(units)), w.count)
    times = np.ones(len(some)) if weights is None else np.asarray(weights, float)[some]
    place = np.arange(len(some)) - w.first[some]
    last = place == w.count[some] - 1
    plain = np.where(w.number, _NUMBER, w.hash)  # all numbers alike
    before = lambda h, k: np.where(place >= k, np.roll(h, k), np.where(place == k - 1, _BEGIN, np.uint64(0)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def count(kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        keys = _kind(keys, kind).view(np.int64)
        if wanted is not None:
            own = wanted(keys)
            keys, a, b = keys[own], a[own], b[own]
        keys, at = np.unique(keys, return_inverse=True)
        found.append((keys, np.bincount(at, a, minlength=len(keys)), np.bincount(at, b, minlength=len(keys))))

    for n in ORDERS:
        whole = place + 2 >= n  # a unit may be a single word that is otherwise found inside, so its beginning counts as a token
        key = _join(*[before(plain, k) for k in range(n - 1, 0, -1)], plain)[whole]
        count(n - 1, key, (times * last)[whole], (times * ~last)[whole])
    size = w.stop - w.start
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + 1
    start = np.repeat(w.start, size)
    strings, own, each = w.stretch(start, start + k), k == np.repeat(size, size), np.repeat(times, size)
    count(KINDS - 2, strings, each * own, each * ~own)
    count(KINDS - 1, _join(np.repeat(_join(before(w.hash, 2), before(w.hash, 1)), size), strings), each * own, each)
    return tuple(np.concatenate(x) for x in zip(*found))


def end_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, KINDS) keys that say how each text ends, and which of them apply; none without words."""
    n = len(texts)
    w = Words([t[-80:] for t in texts], digits_apart=True)
    keys, valid = np.zeros((n, KINDS), np.int64), np.zeros((n, KINDS), bool)
    has = w.count > 0
    if not has.any():
        return keys, valid
    short = np.fromiter((len(t) <= 80 for t in texts), bool, n)
    plain = np.where(w.number, _NUMBER, w.hash)
    end = w.first + w.count - 1

    def token(h: np.ndarray, k: int) -> np.ndarray:
        """The token k places before the last; the beginning of the text where it is near."""
        at = np.maximum(end - k, 0)
        return np.where(w.count > k, h[np.minimum(at, len(h) - 1)], np.where((w.count == k) & short, _BEGIN, np.uint64(0)))

    for order in ORDERS:
        keys[:, order - 1] = _kind(_join(*[token(plain, k) for k in range(order - 1, -1, -1)]), order - 1).view(np.int64)
        valid[:, order - 1] = has & (w.count + short >= order)
    last = token(w.hash, 0)
    word = has & ~w.number[np.minimum(np.maximum(end, 0), len(w.number) - 1)]
    keys[:, -2], valid[:, -2] = _kind(last, KINDS - 2).view(np.int64), word
    keys[:, -1], valid[:, -1] = _kind(_join(_join(token(w.hash, 2), token(w.hash, 1)), last), KINDS - 1).view(np.int64), word & ((w.count > 2) | short)
    return keys, valid


def end_scores(a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positive where the last words usually close a unit, negative where they don't or the last word looks cut; 0 without words. ``a``, ``b``: (n, KINDS) counts of ``end_keys``."""
    out = np.zeros(len(a))
    for i in range(len(ORDERS)):
        good = (a[:, i] + b[:, i] >= 2) & valid[:, i]
        out = np.where(good, np.log((a[:, i] + 0.3) / (b[:, i] + 0.3)), out)
    # a word that never stands here, where longer ones do that begin like it
    out = np.where(valid[:, -1] & (a[:, -1] == 0) & (b[:, -1] >= 3), np.minimum(out, -4.0), out)
    seen, begun = a[:, -2], b[:, -2]
    cut = valid[:, -2] & (seen < 3) & (begun >= 5)
    out = np.where(cut, out - 2.0 - 0.5 * np.log(np.maximum(begun, 1) / (seen + 0.5)), out)
    return np.where(valid.any(axis=1), np.clip(out, -8, 8), 0.0)


class EndModel:
    """Log odds that a text may end after its last tokens (words, Han and kana signs, numbers), from texts that are mostly whole."""

    def __init__(self, units: list[str]):
        """``units``: whole sentences and lines."""
        keys, a, b = end_counts(units)
        order = np.argsort(keys)
        order = order[(a + b)[order] >= 2]  # what occurs once says nothing
        self.keys, self.a, self.b = keys[order], a[order].astype(np.float32), b[order].astype(np.float32)

    @classmethod
    def of_counts(cls, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> EndModel:
        """Of counts, as of ``end_counts``, for those keys only."""
        self, order = cls.__new__(cls), np.argsort(keys)
        self.keys, self.a, self.b = keys[order], a[order].astype(np.float32), b[order].astype(np.float32)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        """As ``end_scores``."""
        keys, valid = end_keys(texts)
        if not len(self.keys):
            return np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = (self.keys[at] == keys) & valid
        return end_scores(np.where(same, self.a[at], 0).astype(float), np.where(same, self.b[at], 0).astype(float), valid)

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


class Logistic:
    """Logistic regression by Newton's method with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.hstack([np.ones((len(z), 1)), z])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))

    @classmethod
    def of_table(cls, rows: DataFrame, ridge: float = 1e-2) -> Logistic | None:
        """Fit on all of ``rows`` (x array<double>, n0 bigint, n1 bigint: how often such a row is false and true); each step sums over the table, only the sums come to the driver. None where all rows are true or all false."""
        def total(of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts = [of(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), *(c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:])).ravel() for b in batches if b.num_rows]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tolist()], pa.list_(pa.float64()))], names=["s"])

            got = sorted(r.s for r in rows.select("x", "n0", "n1").mapInArrow(run, "s array<double>").collect())
            return np.sum(got, axis=0) if got else None

        sums = total(lambda x, n0, n1: np.concatenate([[n0.sum(), n1.sum()], (n0 + n1) @ x]))
        if sums is None or not sums[0] or not sums[1]:
            return None
        self = cls.__new__(cls)
        n = sums[0] + sums[1]
        mean = self.mean = sums[2:] / n
        self.scale = np.sqrt(total(lambda x, n0, n1: (n0 + n1) @ (x - mean) ** 2) / n) + 1e-9
        w = self.weights = np.zeros(len(mean) + 1)
        for _ in range(25):
            def step(x: np.ndarray, n0: np.ndarray, n1: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                z = self._design(x)
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                return np.vstack([(z * ((p * (1 - p) + 1e-6) * (n0 + n1))[:, None]).T @ z, z.T @ (n1 - p * (n0 + n1))])

            sums = total(step).reshape(len(w) + 1, len(w))
            by = np.linalg.solve(sums[:-1] + ridge * np.eye(len(w)), sums[-1] - ridge * w)
            w = w + by
            if np.abs(by).max() < 1e-6:
                break
        self.weights = w
        return self
