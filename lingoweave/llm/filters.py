"""Bloom filters that tasks build and merge block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import store

BLOCK_BITS = 1 << 18
HASHES = 4
#: size of a filter, 128 MB, above which its keys are split among several
MOST_BITS = 1 << 30
#: size of a filter of keys (64 MB in each task) and of the pieces (16 MB) in which the driver sends it on
SENT_BITS, PIECE_BITS = 1 << 29, 1 << 27


def filter_bits(rows: int, bits_per_row: int = 16, most: int = 1 << 31) -> int:
    """Size of a filter: a power of two, at most ``most`` bits."""
    return max(BLOCK_BITS, min(most, 1 << max(0, rows * bits_per_row - 1).bit_length()))


def positions(d: np.ndarray, size: int) -> np.ndarray:
    """(n, HASHES) bit numbers of keys of two words each, in a filter of ``size`` bits, a power of two."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((d[:, :1] + steps * (d[:, 1:] | np.uint64(1))) & np.uint64(size - 1)).astype(np.int64)


def words_of(keys: np.ndarray) -> np.ndarray:
    """(n, 2) words of 64-bit keys."""
    k = keys.astype(np.int64, copy=False).view(np.uint64)
    x = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.stack([x ^ (x >> np.uint64(32)), y ^ (y >> np.uint64(31))], axis=-1)


def get(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def put(bitmap: np.ndarray, bits: np.ndarray) -> None:
    bits = bits.ravel()
    np.bitwise_or.at(bitmap, bits >> 3, np.left_shift(np.uint8(1), (bits & 7).astype(np.uint8)))


def _merged(df: DataFrame, words: Callable[[pa.Array], np.ndarray], size: int, repeats: bool) -> DataFrame:
    """(block, bits) of the filter of the keys in the one column of ``df``, or of those only that occur more than once (``repeats``).

    Each task fills bitmaps of its own, of keys seen once and seen again; their blocks are sent to one task each and merged there: seen again is what
    two tasks have seen as well.
    """
    width = BLOCK_BITS // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(size // 8, np.uint8), np.zeros(size // 8 if repeats else 0, np.uint8)
        for batch in batches:
            d = words(batch.column(0))
            if repeats:
                d, n = np.unique(d, axis=0, return_counts=True)
                bits = positions(d, size)
                put(again, bits[(n > 1) | get(once, bits)])
                put(once, bits)
            else:
                put(once, positions(d, size))
        pack = zstandard.ZstdCompressor(level=1).compress
        blocks = np.flatnonzero(once.reshape(-1, width).any(axis=1)).tolist()
        for i in range(0, len(blocks), 64):
            cut = [slice(k * width, (k + 1) * width) for k in blocks[i:i + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[i:i + 64], pa.int64()), pa.array([pack(once[c].tobytes()) for c in cut], pa.binary()),
                                              pa.array([pack(again[c].tobytes()) if repeats else b"" for c in cut], pa.binary())], names=["block", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, o, a in zip(*(c.to_pylist() for c in batch.columns)):
                o = np.frombuffer(unpack(o), np.uint8).copy()
                a = np.frombuffer(unpack(a), np.uint8).copy() if repeats else o
                if block in state:
                    once, again = state[block]
                    if repeats:
                        again |= a | once & o
                    once |= o
                else:
                    state[block] = (o, a)
        pack = zstandard.ZstdCompressor(level=1).compress
        keep = [(k, pack(a.tobytes())) for k, (_, a) in state.items() if a.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.int64()), pa.array([a for _, a in keep], pa.binary())], names=["block", "bits"])

    return df.mapInArrow(build, "block bigint, once binary, again binary").repartition("block").mapInArrow(merge, "block bigint, bits binary")


def _bitmap(blocks: DataFrame, first: int, size: int) -> np.ndarray:
    """Bitmap of ``size`` bits from the block ``first`` on; so much comes to the driver."""
    width = BLOCK_BITS // 8
    out = np.zeros(size // 8, np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for r in blocks.toLocalIterator():
        at = (r.block - first) * width
        out[at:at + width] = np.frombuffer(unpack(bytes(r.bits)), np.uint8)
    return out


def merged_filter(df: DataFrame, words: Callable[[pa.Array], np.ndarray], size: int, repeats: bool) -> np.ndarray:
    """Bitmap of the keys in the one column of ``df``, or of those only that occur more than once (``repeats``); ``size`` / 8 bytes come to the driver."""
    return _bitmap(_merged(df, words, size, repeats), 0, size)


class SentFilter:
    """A filter of the keys in a bigint column without nulls, as broadcasts of one piece after the other: the driver never holds more than one piece, whatever the number of keys."""

    def __init__(self, keys: DataFrame, rows: int, most: int = SENT_BITS, piece: int = PIECE_BITS):
        self.size = filter_bits(rows, most=most)
        self.piece = min(self.size, piece)
        blocks = _merged(keys, lambda c: words_of(c.to_numpy(zero_copy_only=False)), self.size, False)
        context = keys.sparkSession.sparkContext
        if self.size == self.piece:
            self.sent = [context.broadcast(_bitmap(blocks, 0, self.size))]
            return
        blocks, n, self.sent = store(blocks, "filter"), self.piece // BLOCK_BITS, []
        for first in range(0, self.size // BLOCK_BITS, n):
            own = blocks.where((F.col("block") >= first) & (F.col("block") < first + n))
            self.sent.append(context.broadcast(_bitmap(own, first, self.piece)))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which 64-bit keys the filter may hold."""
        bits = positions(words_of(keys), self.size)
        if len(self.sent) == 1:
            return get(self.sent[0].value, bits)
        out, own = np.ones(len(bits), bool), bits // self.piece
        for i, sent in enumerate(self.sent):
            row, k = np.nonzero(own == i)
            at = bits[row, k] - i * self.piece
            out[row[(sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0]] = False
        return out

    def destroy(self) -> None:
        for sent in self.sent:
            sent.destroy()
