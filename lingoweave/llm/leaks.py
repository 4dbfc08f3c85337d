"""Passages of evaluation items inside corpus documents.

The items, a set of fixed size, go to all tasks as an index of sampled q-grams. A document's q-grams that hit it are counted by
item and diagonal in overlapping bands; a band with as many hits as a passage within the edit budget must leave is verified
by alignment inside the band.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import letters_digits

_MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
#: hits of q-grams that are held at once; a batch of texts with more is halved
MOST_HITS = 20_000_000


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all stretches of q code points (n - q + 1 values)."""
    if len(codes) < q:
        return np.empty(0, np.uint64)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (a >> np.uint64(31))) * _MIX + b * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))

    # powers of two by doubling, then the binary digits of q
    power, size, parts, at = codes.astype(np.uint64) * _MIX + np.uint64(1), 1, [], 0
    while size <= q:
        if q & size:
            parts.append((power, size))
        if size * 2 <= q:
            power = join(power[:len(power) - size], power[size:])
        size *= 2
    n = len(codes) - q + 1
    out = None
    for h, length in reversed(parts):
        piece = h[at:at + n]
        out = piece if out is None else join(out, piece)
        at += length
    return out


class ItemIndex:
    """Sampled q-grams of the items, for each length q by itself.

    A passage is a stretch of at least ``share`` of an item's letters (and of ``shortest``, or the whole item where it is shorter) with at most ``edits`` letters changed, lost or
    added. Each edit spoils at most ceil(q / step) sampled q-grams, so floor((needed - q + 1) / step) - edits * ceil(q / step) of them are left, on diagonals
    that lie within ``edits`` of each other: in one of the bands of 2 * (edits + 1) diagonals that overlap by half.

    A q-gram that more than ``common`` items share is left out where an item's passages have enough others: as many hits fewer are asked for as any
    passage can have of them.
    """

    def __init__(self, items: list[tuple[int, str]], share: float = 0.4, edits: int = 0, shortest: int = 1, common: int = 32):
        self.edits = edits
        self.items = [(i, code_points([t])) for i, t in items if t]
        self.ids = np.array([i for i, _ in self.items], np.int64)
        size = np.array([len(c) for _, c in self.items], np.int64)
        self.needed = np.maximum(np.maximum(1, np.ceil(share * size - 1e-9).astype(np.int64)), np.minimum(size, shortest))
        self.bound = np.ones(len(self.items), np.int64)
        plans = defaultdict(list)
        for k, n in enumerate(self.needed):
            room = int(n) // (edits + 1)
            q = max(q for q in (1, 2, 4, 6, 8, 12, 16, 24, 32) if q <= max(1, room // 3) or q == 1)
            step = max(1, (int(n) - q + 1) // (4 * (edits + 1)))
            self.bound[k] = max(1, (int(n) - q + 1) // step - edits * -(-q // step))
            plans[q].append((k, step))
        self.tables = []
        for q, members in sorted(plans.items()):
            h, item, at = [], [], []
            for k, step in members:
                g = gram_hashes(self.items[k][1], q)[::step]
                h.append(g)
                item.append(np.full(len(g), k, np.int64))
                at.append(np.arange(len(g), dtype=np.int64) * step)
            first, steps = np.cumsum([0, *map(len, h)]), [s for _, s in members]
            h, item, at = np.concatenate(h), np.concatenate(item), np.concatenate(at)
            keep = self._rare(h, item, first, [k for k, _ in members], steps, q, common)
            h, item, at = h[keep], item[keep], at[keep]
            o = np.argsort(h, kind="stable")
            h, item, at = h[o], item[o], at[o]
            unique, first, count = np.unique(h, return_index=True, return_counts=True)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(unique >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((q, unique, first, count, item, at, seen))

    def _rare(self, h: np.ndarray, item: np.ndarray, first: np.ndarray, members: list[int], steps: list[int], q: int, common: int) -> np.ndarray:
        """Which q-grams are kept; lowers the bounds of the items that lose some."""
        pairs = np.unique(np.stack([h, item.astype(np.uint64)]), axis=1)[0]
        many, n = np.unique(pairs, return_counts=True)
        heavy = np.isin(h, many[n > common])
        keep = np.ones(len(h), bool)
        for j in np.flatnonzero(np.add.reduceat(heavy, first[:-1])) if heavy.any() else ():
            part, k = slice(first[j], first[j + 1]), members[j]
            window = min(part.stop - part.start, -(-(int(self.needed[k]) - q + 1) // steps[j]) + 1)
            sums = np.concatenate([[0], np.cumsum(heavy[part])])
            left = int(self.bound[k]) - int((sums[window:] - sums[:-window]).max())
            if left >= 1:
                self.bound[k], keep[part] = left, ~heavy[part]
        return keep

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, matched length, item length, start in the text) for every text and item that share a passage."""
        return [x[:5] for x in self.passages(texts)]

    def passages(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """``search`` with the length of the longest stretch without an edit."""
        codes = code_points(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(texts)), size)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        width = self.edits + 1
        for q, unique, first, count, item, at, seen in self.tables:
            g = gram_hashes(codes, q)
            if not len(g) or not len(unique):
                continue
            p = np.flatnonzero(seen[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            p = p[of[p] == of[p + q - 1]]
            slot = np.minimum(np.searchsorted(unique, g[p]), len(unique) - 1)
            real = unique[slot] == g[p]
            p, slot = p[real], slot[real]
            n = count[slot]
            if int(n.sum()) > MOST_HITS and len(texts) > 1:
                half = len(texts) // 2
                return [*self.passages(texts[:half]), *((t + half, *rest) for t, *rest in self.passages(texts[half:]))]
            entry = np.repeat(first[slot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            where = np.repeat(p, n)
            k = item[entry]
            low = (where - begin[of[where]] - at[entry]) // width
            if not len(low):
                continue
            base, span = int(low.min()) - 1, int(low.max() - low.min()) + 3
            key = ((of[where] * len(self.items) + k) * span) + (low - base)
            # without edits each diagonal is a band; with edits a band is two neighbouring strips, and each strip counts in two of them
            bands, hits = np.unique(np.concatenate([key, key - 1]) if self.edits else key, return_counts=True)
            pair, row = bands // span, bands % span + base
            for j in np.flatnonzero(hits >= self.bound[pair % len(self.items)]):
                text, kk, r = int(pair[j]) // len(self.items), int(pair[j]) % len(self.items), int(row[j])
                found = self._verify(codes[begin[text]:begin[text] + size[text]], kk, r * width, (r + (2 if self.edits else 1)) * width - 1)
                if found:
                    old = best.get((text, kk), (0, 0, 0))
                    best[text, kk] = (*max(found[:2], old[:2], key=lambda x: x[0]), max(found[2], old[2]))
        return [(t, int(self.ids[k]), n, len(self.items[k][1]), a, u) for (t, k), (n, a, u) in best.items()]

    def _verify(self, text: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Longest stretch of the item aligned within the band with at most the budget of edits, if long enough: (length, start in text, longest stretch without an edit)."""
        item, need = self.items[k][1], int(self.needed[k])
        m, wide = len(item), high - low + 1
        at = np.arange(m) + np.arange(low, high + 1)[:, None]
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, max(0, len(text) - 1))] == item)
        # end of the run of equal letters from each place on, on each diagonal
        run = np.full((wide, m + 2), m, np.int64)
        run[:, m + 1] = m
        run[:, :m] = np.minimum.accumulate(np.where(same, m, np.arange(m))[:, ::-1], axis=1)[:, ::-1]
        place = np.arange(m)
        plain = run[:, :m] - place
        unbroken = int(plain.max())
        length, start = unbroken, int(np.argmax(plain))
        begin = (start // m, start % m)
        for d in range(wide if self.edits else 0):
            reach = np.full((wide, m), -1, np.int64)
            reach[d] = np.where(same[d], run[d, :m], -1)
            for _ in range(self.edits):
                more = reach.copy()
                for e in range(wide):
                    steps = [reach[e] + 1]  # a letter changed
                    if e + 1 < wide:
                        steps.append(reach[e + 1] + 1)  # a letter of the item lost
                    if e:
                        steps.append(reach[e - 1])  # a letter more in the text
                    x = np.maximum.reduce([np.where(s > 0, s, -1) for s in steps])
                    x = np.where((x < 0) | (x > m), -1, x)
                    # what is aligned must lie in the text
                    x = np.where((x >= 0) & (x + low + e <= len(text)) & (x + low + e >= 0), x, -1)
                    more[e] = np.maximum(more[e], np.where(x >= 0, run[e, np.minimum(np.maximum(x, 0), m + 1)], -1))
                reach = more
            far = reach.max(axis=0) - place
            i = int(np.argmax(far))
            if far[i] > length:
                length, begin = int(far[i]), (d, i)
        return (length, begin[1] + low + begin[0], unbroken) if length >= need else None


def leaked_items(documents: DataFrame, items: DataFrame, share: float = 0.4, edits: int = 1, shortest: int = 12) -> DataFrame:
    """(doc_id, item_id, matched, item_length, share, start, unbroken) for every document that holds a passage of an item.

    A passage has at least ``share`` of the item's letters and digits, ``shortest`` at least (or the whole item), in order with at most ``edits`` changed, lost or added;
    ``unbroken`` is the longest stretch of it without one. Both texts count by their letters and digits in lower case. ``items`` is held-out test material of fixed size; its
    index goes to every task and is refused above 64 million letters. Null and blank texts never match. Of repeated item ids all texts count, the best match is given.
    """
    spark = documents.sparkSession
    texts = items.select(F.col("item_id").cast("bigint"), letters_digits(F.col("text")).alias("t")).where("t <> ''")
    total = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    if total > 64_000_000:
        raise ValueError(f"{total} letters of evaluation items; split them into sets of 64 million")
    sent = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in texts.collect()], share, edits, shortest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        names = ["doc_id", "item_id", "matched", "item_length", "share", "start", "unbroken"]
        for batch in batches:
            ids, found = batch.column(0), []
            texts = batch.column(1).to_pylist()
            start, size = 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > 1_000_000:
                    if i > start:
                        found += [(start + t, *rest) for t, *rest in index.passages(texts[start:i])]
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i])
            text, item, matched, length, at, unbroken = np.array(found, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(item), pa.array(matched), pa.array(length), pa.array(matched / np.maximum(length, 1)), pa.array(at), pa.array(unbroken)], names=names)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), letters_digits(F.col("text")).alias("t")).where("t <> ''")
    return rows.mapInArrow(run, "doc_id bigint, item_id bigint, matched bigint, item_length bigint, share double, start bigint, unbroken bigint")


def unbroken_passages(hits: DataFrame, share: float = 0.4) -> DataFrame:
    """Those of the found passages that have ``share`` of their item without any edit."""
    return hits.where(F.col("unbroken") >= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("item_length") - 1e-9)))
