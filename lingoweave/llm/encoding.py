"""Text decoded with the wrong character encoding: find it and restore the original.

A multinomial model over hashed byte bigrams is trained on a bounded sample of the texts themselves and on the same texts
garbled by every chain of a list. A row is suspect where the log odds of garbled against clean text, summed along its
bytes, rise by enough within some stretch. Chains between single-byte encodings, which change a letter here and there, have odds
of their own. Of a suspect the likeliest chains are inverted; an inversion counts where it
decodes strictly and gives text that the model finds far more usual.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import store
from .sampling import sample_distinct
from .words import slices

BUCKETS = 1 << 15

#: What wrong decoding leaves behind: control characters, replacement characters, private use, or three Latin-1 signs on end.
_SIGN = "\u00a1-\u00ff\u0152-\u017e\u0192"
MARKS = re.compile(f"[\u0080-\u009f\ufffd\ue000-\uf8ff]|(?=[\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{{0,2}}[{_SIGN}])[{_SIGN}\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{{3}}")

#: Chains of (true encoding, encoding it was read with), in the order of reading.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>cp1252": (("utf-8", "w1252"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>mac_roman": (("utf-8", "mac_roman"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "utf8>cp1258": (("utf-8", "cp1258"),),
    "utf8>koi8_r": (("utf-8", "koi8_r"),),
    "utf8>cp932": (("utf-8", "cp932"),),
    "utf8>gbk": (("utf-8", "gb18030"),),
    "utf8>cp949": (("utf-8", "cp949"),),
    "utf8>big5": (("utf-8", "big5"),),
    "utf8>cp1252>cp1252": (("utf-8", "w1252"), ("utf-8", "w1252")),
    "utf8>latin1>latin1": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8>latin1>cp1252": (("utf-8", "latin-1"), ("utf-8", "w1252")),
    "utf8>cp1252>latin1": (("utf-8", "w1252"), ("utf-8", "latin-1")),
    "cp932>cp1252": (("cp932", "w1252"),),
    "cp932>latin1": (("cp932", "latin-1"),),
    "euc_jp>cp1252": (("euc_jp", "w1252"),),
    "gbk>cp1252": (("gb18030", "w1252"),),
    "gbk>latin1": (("gb18030", "latin-1"),),
    "big5>cp1252": (("big5", "w1252"),),
    "cp949>cp1252": (("cp949", "w1252"),),
    "cp949>latin1": (("cp949", "latin-1"),),
    "cp932>gbk": (("cp932", "gb18030"),),
    "cp932>cp949": (("cp932", "cp949"),),
    "gbk>cp932": (("gb18030", "cp932"),),
    "gbk>cp949": (("gb18030", "cp949"),),
    "cp949>gbk": (("cp949", "gb18030"),),
    "cp949>cp932": (("cp949", "cp932"),),
    "euc_jp>gbk": (("euc_jp", "gb18030"),),
    "euc_jp>cp932": (("euc_jp", "cp932"),),
    "cp1252>utf8": (("w1252", "utf-8"),),
    "cp1258>utf8": (("cp1258", "utf-8"),),
    "cp932>utf8": (("cp932", "utf-8"),),
    "cp949>utf8": (("cp949", "utf-8"),),
    "gbk>utf8": (("gb18030", "utf-8"),),
}

#: Single-byte text read with another single-byte encoding. Text in Latin-1 is text in Windows-1252 as well.
_BYTES = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "latin1")
SINGLE: dict[str, tuple[tuple[str, str], ...]] = {
    f"{a}>{b}": (({"cp1252": "w1252"}.get(a, a), {"cp1252": "w1252", "latin1": "latin-1"}.get(b, b)),) for a in _BYTES[:-1] for b in _BYTES if a != b
}
CHAINS |= SINGLE
_TRUE = list(dict.fromkeys(x[0][0] for x in SINGLE.values()))

#: Marks that clean text has beside its letters; that another encoding would make letters of them says nothing.
_TYPOGRAPHIC = frozenset("\u00a0«»–—‘’“”„…")
#: what UTF-8 leaves when it was read as Latin-1: then the chain was another
_UTF8_AGAIN = re.compile("[\u00c2\u00c3][\u0080-\u00bf]")
#: signs that a single-byte encoding has beyond ASCII and those marks
_ODD = frozenset(c for _, b in (x[0] for x in SINGLE.values()) for c in bytes(range(128, 256)).decode("cp1252" if b == "w1252" else b, "ignore")) - _TYPOGRAPHIC
#: Letters of the languages here and of names, by their bases and accents
_LETTERS = frozenset(x for c in "äöüßàâæçéèêëîïôœùûÿáíñóúãõăđìĩòơũưýøåạảấầẩẫậắằẳẵặẹẻẽếềểễệịỉọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ" for x in (c, c.upper()))
#: Signs that clean text may well have beside a letter
_UNITS = frozenset("°ºª§€£©®™¿¡")
_STRANGE, _CAPITAL = (re.escape("".join(sorted(x))) for x in (_ODD - _LETTERS, {c for c in _ODD if c.isupper()}))
#: beside a Latin letter what is no letter of these languages, or a capital after a small letter
_BESIDE = re.compile(f"(?<=[A-Za-z])[{_STRANGE}]|[{_STRANGE}](?=[A-Za-z])|(?<=[a-z])[{_CAPITAL}]")

_UNASSIGNED = frozenset("\x81\x8d\x8f\x90\x9d")


def _own_byte(e: UnicodeError) -> tuple[bytes | str, int]:
    """The five bytes that Windows-1252 leaves unassigned stand for themselves."""
    if isinstance(e, UnicodeDecodeError):
        return e.object[e.start:e.end].decode("latin-1"), e.end
    part = e.object[e.start:e.end]
    if _UNASSIGNED.issuperset(part):
        return part.encode("latin-1"), e.end
    # only up to the first sign that really has no byte
    n = next(i for i, c in enumerate(part) if c not in _UNASSIGNED)
    if n:
        return part[:n].encode("latin-1"), e.start + n
    raise e


codecs.register_error("own_byte", _own_byte)


def encode(text: str, name: str) -> bytes:
    """Strict encoding; ``w1252`` is Windows-1252 with the five unassigned bytes as control characters."""
    return text.encode("cp1252", "own_byte") if name == "w1252" else text.encode(name)


def decode(data: bytes, name: str, errors: str = "strict") -> str:
    if name == "w1252":
        return data.decode("cp1252", "own_byte")
    return data.decode(name, errors)


def garble(text: str, chain: str) -> str | None:
    """``text`` as the chain shows it, unreadable bytes as U+FFFD; None where the true encoding lacks a character or nothing changes."""
    out = text
    for true, read in CHAINS[chain]:
        try:
            out = decode(encode(out, true), read, "replace")
        except UnicodeEncodeError:
            return None
    return None if out == text else out


def garble_all(texts: list[str], chain: str, some: list[str] | None = None) -> list[str]:
    """``garble`` of many texts without NUL, those left out that it can't garble: their bytes are decoded together, with NUL between them, which no character spans. ``some``: those that the true encoding has."""
    some = [t for t in texts if _has(t, CHAINS[chain][0][0])] if some is None else some
    out = "\0".join(some)
    for true, read in CHAINS[chain]:
        out = decode(encode(out, true), read, "replace")
    return [g for g, t in zip(out.split("\0"), some) if g != t] if some else []


def ungarble(text: str, chain: str) -> str | None:
    """The text that the chain turned into ``text``; None if any step fails strictly."""
    out = text
    try:
        for true, read in reversed(CHAINS[chain]):
            out = decode(encode(out, read), true)
    except UnicodeError:
        return None
    return None if out == text or "�" in out else out


def bigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each pair of neighbouring bytes (n - 1 values)."""
    pair = data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]
    return (pair * np.uint32(2654435769)) >> np.uint32(17)


class EncodingModel:
    """Log probabilities of hashed byte bigrams in clean text and under each chain."""

    def __init__(self, clean: list[str], smoothing: float = 0.05):
        self.chains = [c for c in CHAINS if c not in SINGLE]
        self.smoothing = smoothing
        texts = sorted({t for t in clean if t and "\0" not in t})
        # capitals are as clean as what they were made from
        clean = sorted({v for t in texts for v in (t, t.upper(), t.lower())})
        # the sample itself holds garbled texts: a model of a quarter of it tells which to leave out
        self._fit(clean, [t for t in texts if not t.isascii()][::4])
        wide = [t for t in clean if not t.isascii()]
        risen = {t for t, r in zip(wide, self.rises([t.encode("utf-8", "replace") for t in wide])) if r >= 8}
        keep = [t for t in clean if t.isascii() or t not in risen and not self._mended(t)]
        kept = set(keep)
        self._fit(keep, [t for t in texts if not t.isascii() and t in kept])

    @classmethod
    def of_table(cls, texts: DataFrame, column: str = "text", smoothing: float = 0.05) -> EncodingModel:
        """The same, learned from every different text of the table, all of them also for the first of the two models; only counts come to the driver."""
        self = cls([], smoothing)

        def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = {t for t in batch.column(0).to_pylist() if "\0" not in t}
                all_ = sorted({v for t in own for v in (t, t.upper(), t.lower())})
                yield pa.RecordBatch.from_arrays([pa.array(all_, pa.string()), pa.array([v in own for v in all_], pa.bool_())], names=["text", "own"])

        rows = texts.where(F.length(column) > 0).select(column).distinct().mapInArrow(variants, "text string, own boolean")
        rows = store(rows.groupBy("text").agg(F.max("own").alias("own")), "variants")
        counts = self._table_counts(rows)
        self._set(counts)
        sent = texts.sparkSession.sparkContext.broadcast(self)

        def garbled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for batch in batches:
                wide = [(i, t) for i, t in enumerate(batch.column(0).to_pylist()) if not t.isascii()]
                rises = m.rises([t.encode("utf-8", "replace") for _, t in wide])
                yield batch.take(pa.array([i for (i, t), r in zip(wide, rises) if r >= 8 or m._mended(t)], pa.int64()))

        # what is left out is taken from the counts: they are sums over the texts
        self._set(counts - self._table_counts(rows.mapInArrow(garbled, "text string, own boolean")))
        sent.destroy()
        return self

    @staticmethod
    def _table_counts(rows: DataFrame) -> np.ndarray:
        """``_counts`` of a table (text, own), where ``own`` are the texts as they are written."""
        shape = 2 + len(_TRUE) + len(CHAINS), BUCKETS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(shape)
            for batch in batches:
                texts, own = (c.to_pylist() for c in batch.columns)
                for s in slices(map(len, texts), 1_000_000):
                    n += EncodingModel._counts(texts[s], [t for t, o in zip(texts[s], own[s]) if o and not t.isascii()], True)
            pack = zstandard.ZstdCompressor(level=1).compress
            some = np.flatnonzero(n.any(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pack(n[i].tobytes()) for i in some], pa.binary())], names=["row", "n"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict[int, np.ndarray] = {}
            unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
            for batch in batches:
                for i, n in zip(*(c.to_pylist() for c in batch.columns)):
                    state[i] = state.get(i, 0) + np.frombuffer(unpack(n))
            yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int64()), pa.array([pack(n.tobytes()) for n in state.values()], pa.binary())], names=["row", "n"])

        form, unpack = "row bigint, n binary", zstandard.ZstdDecompressor().decompress
        out = np.zeros(shape)
        for r in rows.select("text", "own").mapInArrow(count, form).repartition("row").mapInArrow(merge, form).collect():
            out[r.row] = np.frombuffer(unpack(bytes(r.n)))
        return out

    def _mended(self, text: str) -> bool:
        """Whether a chain between single-byte encodings explains the text better."""
        return bool(_BESIDE.search(text) and self.rise(text, True)[0] >= 4 and self._restore_single(text)[0])

    @staticmethod
    def _count(texts: list[str], before: str = "") -> np.ndarray:
        n = np.zeros(BUCKETS)
        for i in range(0, len(texts), 4000):
            data = np.frombuffer((before + "\0".join(texts[i:i + 4000]) + "\0").encode("utf-8", "replace"), np.uint8)
            n += np.bincount(bigrams(data), minlength=BUCKETS)
        return n

    @staticmethod
    def _counts(clean: list[str], originals: list[str], apart: bool = False) -> np.ndarray:
        """Counts of byte pairs: in clean text, in the originals, in those that have a place in each encoding of ``_TRUE``, and as each chain shows them. ``apart``: no count depends
        on which text is beside which, so that those of several lists are sums."""
        # few texts have a place in a single-byte encoding: they are compared with themselves
        has = {x: [t for t in originals if _has(t, x)] for x in {**dict.fromkeys(_TRUE), **{c[0][0]: None for c in CHAINS.values()}}}
        lead, tail = ("\0", [""]) if apart else ("", [])
        garbled = (garble_all([], c, [*has[CHAINS[c][0][0]], *tail]) for c in CHAINS)
        return np.stack([EncodingModel._count(x, lead) for x in (clean, originals, *(has[x] for x in _TRUE), *garbled)])

    def _fit(self, clean: list[str], originals: list[str]) -> None:
        self._set(self._counts(clean, originals))

    def _set(self, counts: np.ndarray) -> None:
        def log(n: np.ndarray) -> np.ndarray:
            return np.log((n + self.smoothing) / (n.sum() + self.smoothing * BUCKETS)).astype(np.float32)

        self.clean = log(counts[0])
        # Any chain may be the one. What a chain leaves as it was says nothing: of each chain only the pairs count that are
        # more frequent in it than in the texts it was made from.
        source, *own = (n / max(1.0, n.sum()) for n in counts[1:2 + len(_TRUE)])
        pooled, by_chain = np.zeros((2, BUCKETS)), []
        for c, n in zip(CHAINS, counts[2 + len(_TRUE):]):
            before = own[_TRUE.index(CHAINS[c][0][0])] if c in SINGLE else source
            if c not in SINGLE:
                by_chain.append(log(n))
            share = n / max(1.0, n.sum())
            pooled[int(c in SINGLE)] += np.where(share > 2 * before, share, 0)
        self.by_chain = np.stack(by_chain)
        pooled = np.maximum(pooled / [[len(self.chains)], [len(SINGLE)]], 1e-9)
        self.odds, self.single_odds = np.clip(np.log(pooled) - self.clean, -8, 9).astype(np.float32)

    def rise(self, text: str, single: bool = False) -> tuple[float, int, int]:
        """The largest sum of log odds over a stretch of bytes, and where the stretch lies; ``single``: by the chains between single-byte encodings."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(data) < 2:
            return 0.0, 0, 0
        odds = self.single_odds if single else self.odds
        s = np.concatenate([[0], np.cumsum(odds[bigrams(data)], dtype=np.float64)])
        low = np.minimum.accumulate(s)
        end = int(np.argmax(s - low))
        return float(s[end] - low[end]), int(np.argmin(s[:end + 1])), end + 1

    def rises(self, texts: list[bytes]) -> np.ndarray:
        """``rise`` of many texts at once."""
        out = np.zeros(len(texts))
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) < 4 << 20):
                size += len(texts[stop])
                stop += 1
            part = texts[start:stop]
            data = np.frombuffer(b"\0".join(part) + b"\0\0", np.uint8)
            length = np.fromiter((len(t) + 1 for t in part), np.int64, len(part))
            first = np.cumsum(length) - length
            step = self.odds[bigrams(data)][:int(length.sum())].astype(np.float64)
            # pairs with the sign between texts say nothing
            step[first + length - 1] = 0
            step[np.maximum(first + length - 2, 0)] = 0
            s = np.cumsum(step)
            # at each border the sum falls below all before, so that no stretch crosses it
            drop = np.zeros(len(s))
            total = float(np.abs(self.odds).max()) * (length + 2)
            drop[first[1:] - 1] = total[:-1] + total[1:]
            s -= np.cumsum(drop)
            low = np.minimum.accumulate(np.concatenate([[0], s[:-1]]))
            out[start:stop] = np.maximum(np.maximum.reduceat(s - low, first), 0)
            start = stop
        return out

    def usual(self, text: str) -> float:
        """Log probability of the text's bytes as clean text, per byte pair of its own."""
        data = np.frombuffer(f"\0{text}\0".encode("utf-8", "replace"), np.uint8)
        return float(self.clean[bigrams(data)].sum())

    def plain(self, text: str) -> float:
        """Mean log probability, as clean text, of the byte pairs that touch a byte beyond ASCII."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        wide = (data[:-1] > 127) | (data[1:] > 127)
        return float(self.clean[bigrams(data)[wide]].mean()) if wide.any() else -20.0

    def likely(self, text: str) -> list[tuple[float, str]]:
        """Chains other than those between single-byte encodings, with the log odds of the text under them against clean text, best first."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(data) < 2:
            return []
        b = bigrams(data)
        score = (self.by_chain[:, b] - self.clean[b]).sum(axis=1)
        return sorted(zip(score.tolist(), self.chains), reverse=True)

    def restore(self, text: str, tries: int = 8, margin: float = 10.0, least: float = -9.0) -> tuple[str | None, str | None]:
        """(original text, chain) where some chain can be inverted strictly for a part of the text and makes it more usual."""
        found = self._restore(text, tries, margin, least)
        return found if found[0] else self._restore_single(text, margin)

    def _restore_single(self, text: str, margin: float = 10.0) -> tuple[str | None, str | None]:
        """``restore`` by the chains between single-byte encodings, all of which are tried."""
        best: tuple[float, str | None, str | None] = (0.0, None, None)
        signs = {m.group() for m in _BESIDE.finditer(text)}
        for chain in SINGLE:
            if any(_becomes_letter(c, chain) for c in signs):
                out, gain = self._invert(text, chain, margin, -np.inf)
                if out and gain > best[0] and not MARKS.search(out) and not _UTF8_AGAIN.search(out) and _UNITS.issuperset(_BESIDE.findall(out)):
                    best = (gain, out, chain)
        return best[1:]

    def _restore(self, text: str, tries: int = 8, margin: float = 10.0, least: float = -9.0) -> tuple[str | None, str | None]:
        _, a, b = self.rise(text)
        data = text.encode("utf-8", "replace")
        span = data[max(0, a - 1):b + 1].decode("utf-8", "ignore")
        best: tuple[float, str, str] | None = None
        for score, chain in self.likely(span)[:tries]:
            if score <= 0:
                break  # the stretch speaks against this chain and all after it
            out, gain = self._invert(text, chain, margin, least)
            if out and (best is None or gain > best[0]):
                best = (gain, out, chain)
        return (best[1], best[2]) if best else (None, None)

    def guess(self, text: str, tries: int = 4) -> str:
        """The original as far as it can be had: the strict restoration, else what a likely chain leaves when unreadable bytes are skipped."""
        base = self._restore(text)[0] or text
        if not MARKS.search(base):
            return base
        _, a, b = self.rise(text)
        span = text.encode("utf-8", "replace")[max(0, a - 1):b + 1].decode("utf-8", "ignore")
        best = (self.plain(base), base)
        for score, chain in self.likely(span)[:tries]:
            if score <= 0:
                break
            out = text
            for true, read in reversed(CHAINS[chain]):
                raw = b"".join(_skip(c, read) for c in out)
                out = raw.decode("cp1252" if true == "w1252" else true, "ignore")
            if sum(map(str.isalpha, out)) >= 4:
                best = max(best, (self.plain(out), out))
        return best[1]

    def _invert(self, text: str, chain: str, margin: float, least: float) -> tuple[str | None, float]:
        read = CHAINS[chain][-1][1]
        gain, out = 0.0, []

        def attempt(piece: str) -> str | None:
            nonlocal gain
            if piece.isascii() or chain in SINGLE and not _BESIDE.search(piece):
                return None
            back = ungarble(piece, chain)
            if back is None:
                return None
            if chain in SINGLE:
                if not any(back[m.start()].isalpha() and not (back[m.start()].isupper() and back[m.start() - 1:m.start()].islower()) for m in _BESIDE.finditer(piece)):
                    return None
                # what usual marks would turn into neither speaks for the chain nor against it
                more = self.usual("".join(" " if x in _TYPOGRAPHIC else y for x, y in zip(piece, back))) - self.usual("".join(" " if x in _TYPOGRAPHIC else x for x in piece))
            else:
                more = self.usual(back) - self.usual(piece)
            # reading anything but UTF-8 has no check of its own: ask for more
            if more < margin * (1 if CHAINS[chain][0][0] == "utf-8" or chain in SINGLE else 2) or self.plain(back) < least:
                return None
            gain += more
            return back

        for run in _runs(text, read):
            if chain in SINGLE and not _BESIDE.search(run):
                out.append(run)  # nothing in it can be inverted
                continue
            back = attempt(run)
            if back is None:
                parts = re.split(r"(\n| +|(?<=[.!?。！？]))", run)
                back = "".join((x and attempt(x)) or x or "" for x in parts)
            out.append(back)
        whole = "".join(out)
        return (whole, gain) if gain else (None, 0.0)


def _has(text: str, name: str) -> bool:
    try:
        encode(text, name)
    except UnicodeError:
        return False
    return True


@functools.lru_cache(maxsize=1 << 16)
def _becomes_letter(c: str, chain: str) -> bool:
    """Whether a chain between single-byte encodings, inverted, makes a letter of the sign."""
    (true, read), = CHAINS[chain]
    try:
        return decode(encode(c, read), true).isalpha()
    except UnicodeError:
        return False


def _skip(c: str, read: str) -> bytes:
    try:
        return encode(c, read)
    except UnicodeError:
        return b""


def _runs(text: str, read: str) -> list[str]:
    """The text cut into runs of characters that the encoding has and runs of those it lacks."""
    out, at = [], 0
    while at < len(text):
        try:
            encode(text[at:], read)
            out.append(text[at:])
            break
        except UnicodeEncodeError as e:
            if e.start:
                out.append(text[at:at + e.start])
            out.append(text[at + e.start:at + e.end])
            at += e.end
    return out


def train_encoding_model(texts: DataFrame, column: str = "text", sample_rows: int = 12_000, frequent_rows: int = 4_000) -> EncodingModel:
    """Fit on a bounded sample of distinct texts, in full: the ``sample_rows`` with the smallest hashes and the ``frequent_rows`` most frequent."""
    rows = sample_distinct(texts.where(F.length(column) > 0), [column], sample_rows, frequent_rows, "encoding")
    return EncodingModel([r[0] for r in rows])


def garbled_texts(texts: DataFrame, model: EncodingModel, column: str = "text", suspect: float = 6.0, certain: float = 9.0) -> DataFrame:
    """The rows of ``texts`` that hold wrongly decoded text, with ``restored`` (null where nothing decodes strictly), ``complete`` (no damage
    is left in it), ``chain`` and ``score``.

    Null, empty and ASCII texts are never garbled: all encodings of the list agree on ASCII. ``suspect`` is the rise of the log odds from which
    a row is inverted on trial (by the chains between single-byte encodings only if it has signs beside Latin letters that clean text lacks), ``certain`` the rise from which it counts although no chain can be inverted, if
    it shows one of ``MARKS``.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    own = {"restored", "complete", "chain", "score"}
    rows = texts.select(*[c for c in texts.columns if c not in own]).where(F.col(column).rlike(r"[^\x00-\x7f]"))
    fields = rows.columns
    place = fields.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            score = m.rises(batch.column(place).cast(pa.binary()).to_pylist())
            for i, text in enumerate(batch.column(place).to_pylist()):
                if score[i] < suspect and _BESIDE.search(text) and (rise := m.rise(text, True)[0]) >= suspect:
                    score[i] = rise
            keep, restored, chain = [], [], []
            for i in np.flatnonzero(score >= suspect):
                text = batch.column(place)[int(i)].as_py()
                back, name = m.restore(text)
                if back is not None or score[i] >= certain and MARKS.search(text):
                    keep.append(int(i))
                    restored.append(back)
                    chain.append(name)
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(restored, pa.string()), pa.array([x is not None and not MARKS.search(x) for x in restored], pa.bool_()), pa.array(chain, pa.string()), pa.array(score[keep], pa.float64())], names=[*fields, "restored", "complete", "chain", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, restored string, complete boolean, chain string, score double")


def both_texts(entries: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, ord, text) of entries.source and results.target."""
    return (entries.select(F.lit("entries").alias("table_name"), F.col("ord").cast("bigint").alias("ord"), F.col("source").alias("text"))
            .unionByName(results.select(F.lit("results").alias("table_name"), F.col("ord").cast("bigint").alias("ord"), F.col("target").alias("text"))))
