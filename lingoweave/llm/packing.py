"""Fill containers of fixed capacity with items, neighbours in content together.

Each text becomes a vector of signed counts of hashed byte 4-grams, projected to three dimensions and numbered along a Hilbert
curve. Rows are range-partitioned and sorted by that number; each partition is packed by itself, window by window along
the curve, longest item first into the fullest container that still takes it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import store

DIMENSIONS, BITS = 3, 10


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (n, d), each coordinate below 2**bits, along a Hilbert curve (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


def text_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of whole texts."""
    pad = b"\0\0\0\0"
    buffer = np.frombuffer(pad.join(texts) + pad, np.uint8)
    size = np.fromiter((len(t) + 4 for t in texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    gram = np.zeros(len(buffer), np.uint32)
    for k in range(4):
        gram[:len(buffer) - k] |= buffer[k:].astype(np.uint32) << np.uint32(8 * k)
    gram *= np.uint32(2654435769)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(2246822519)
    points = np.empty((len(texts), DIMENSIONS), np.int64)
    for k in range(DIMENSIONS):
        sign = ((gram >> np.uint32(31 - k)) & 1).astype(np.int8) * 2 - 1
        z = np.add.reduceat(sign, start, dtype=np.int64) / np.sqrt(size)
        points[:, k] = np.clip((np.tanh(z / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(points)


class Packer:
    """Packs items as they come, window by window; containers are numbered from 0.

    An item above the capacity is cut into full pieces, each a container of its own, and a rest; no other is cut. Only a window of items
    and the containers still open are held, whatever the number of items.
    """

    def __init__(self, capacity: int, windows: int = 64, most_open: int = 64):
        self.capacity, self.windows, self.most_open = capacity, windows, most_open
        self.boxes = self.items = self._total = 0
        self._free: list[tuple[int, int]] = []  # (room left, container), ascending
        self._waiting: list[tuple[int, int, int]] = []
        self._out: list[tuple[int, int, int, int]] = []

    @property
    def waiting_from(self) -> int:
        """Number of the first item that is not settled."""
        return min((item for _, item, _ in self._waiting), default=self.items)

    def add(self, sizes: Iterable[int]) -> list[tuple[int, int, int, int]]:
        """Pieces (item, part, size, container) that are settled by these items, among them pieces of earlier ones."""
        for size in sizes:
            part = 0
            while size > self.capacity:
                self._out.append((self.items, part, self.capacity, self.boxes))
                self.boxes += 1
                part += 1
                size -= self.capacity
            self._waiting.append((size, self.items, part))
            self.items += 1
            self._total += size
            if self._total >= self.windows * self.capacity or len(self._waiting) >= 50_000:
                self._settle()
        out, self._out = self._out, []
        return out

    def finish(self) -> list[tuple[int, int, int, int]]:
        self._settle()
        out, self._out = self._out, []
        return out

    def _settle(self) -> None:
        self._waiting.sort(key=lambda x: -x[0])
        for size, item, part in self._waiting:
            k = bisect_left(self._free, (size, -1))
            if k < len(self._free):
                room, box = self._free.pop(k)
            else:
                room, box = self.capacity, self.boxes
                self.boxes += 1
            self._out.append((item, part, size, box))
            insort(self._free, (room - size, box))
        del self._free[:-self.most_open]
        self._waiting.clear()
        self._total = 0


def pack(sizes: Iterable[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """All pieces, and the number of containers."""
    packer = Packer(capacity)
    return [*packer.add(sizes), *packer.finish()], packer.boxes


def fill_requests(entries: DataFrame, limits: DataFrame, texts: tuple[str, ...] = ("source", "context_text"), partitions: int | None = None) -> DataFrame:
    """(provider, request_no, ord, part_no, parts, from_char, chars) for every row of ``entries`` and every provider.

    The size of a row is the number of characters of its texts together; null counts 0 and an empty row still gets its
    place. ``limits`` (provider, max_chars) is a small dimension table: it is read by the driver, rows whose limit is null or below 1
    are left out, and of several rows of a provider the smallest limit holds. No request holds more than max_chars; only a row longer than that is
    split, into parts numbered from 1. Equal keys are spread by a hash of ``ord``, so that very frequent texts fill several partitions.
    """
    spark = entries.sparkSession
    caps = [(r.provider, int(r.m)) for r in limits.where("max_chars >= 1").groupBy("provider").agg(F.min("max_chars").alias("m")).orderBy("provider").collect()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, size = batch.column(1).to_pylist(), 0, 0
            keys = []
            for i, t in enumerate(rows):
                size += len(t)
                if size > 4 << 20:
                    keys.append(text_keys(rows[start:i + 1]))
                    start, size = i + 1, 0
            if start < len(rows):
                keys.append(text_keys(rows[start:]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(keys), pa.int32())], names=["ord", "chars", "key"])

    whole = F.concat_ws("\n", *[F.col(c).cast("string") for c in texts])
    chars = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in texts), F.lit(0))
    items = store(entries.select(F.col("ord").cast("bigint").alias("ord"), whole.cast("binary").alias("text"), chars.cast("bigint").alias("chars")).mapInArrow(measure, "ord bigint, chars bigint, key int"), "items")
    # as many partitions as the session shuffles into, more where they would have more than a million rows
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // 1_000_000))
    tie = F.xxhash64("ord", "chars")
    ordered = items.repartitionByRange(n, "key", tie).sortWithinPartitions("key", tie).select("ord", "chars", F.spark_partition_id().cast("bigint").alias("part"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [(provider, cap, Packer(cap)) for provider, cap in caps]
        held: dict[int, tuple[int, int]] = {}  # number -> ord and length of the items that some packer has not settled
        base = oldest = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            base = int(batch.column(2)[0].as_py()) << 32
            first = packers[0][2].items if packers else 0
            sizes = batch.column(1).to_pylist()
            held.update(zip(range(first, first + len(sizes)), zip(batch.column(0).to_pylist(), sizes)))
            for provider, cap, packer in packers:
                yield from pieces(provider, cap, packer.add(sizes), held, base)
            keep = min((p.waiting_from for _, _, p in packers), default=0)
            for k in range(oldest, keep):
                del held[k]
            oldest = max(oldest, keep)
        for provider, cap, packer in packers:
            yield from pieces(provider, cap, packer.finish(), held, base)

    def pieces(provider: str, cap: int, out: list[tuple[int, int, int, int]], held: dict[int, tuple[int, int]], base: int) -> Iterator[pa.RecordBatch]:
        if out:
            item, part, size, box = np.array(out, np.int64).reshape(-1, 4).T
            ids, chars = zip(*(held[k] for k in item.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([provider] * len(item), pa.string()), pa.array(box + base), pa.array(ids, pa.int64()), pa.array((part + 1).astype(np.int32)), pa.array(np.maximum(1, -(-np.array(chars) // cap)).astype(np.int32)), pa.array(part * cap), pa.array(size)],
                names=["provider", "request_no", "ord", "part_no", "parts", "from_char", "chars"])

    return ordered.mapInArrow(fill, "provider string, request_no bigint, ord bigint, part_no int, parts int, from_char bigint, chars bigint")


def fill_summary(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """(provider, requests, chars, fill): how full the requests of each provider are."""
    caps = limits.groupBy("provider").agg(F.min("max_chars").alias("cap"))
    used = requests.groupBy("provider", "request_no").agg(F.sum("chars").alias("chars")).groupBy("provider").agg(F.count(F.lit(1)).alias("requests"), F.sum("chars").alias("chars"))
    return used.join(F.broadcast(caps), "provider").select("provider", "requests", "chars", F.round(F.col("chars") / (F.col("requests") * F.col("cap")), 4).alias("fill"))
