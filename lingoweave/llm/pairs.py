"""Broken source and answer pairs: empty, refusing, copied, wrong in language, truncated."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import store
from .encoding import EncodingModel
from .endings import DOTS, KINDS, EndModel, Logistic, bare, closed, end_counts, end_keys, end_scores
from .filters import SentFilter
from .langid import DENSE, LANGUAGES, LanguageModel, blank_codes, labelled_texts, letters, sentences
from .skew import lookup
from .words import slices

#: Words that stand for no value.
STAND_INS = {"null", "none", "nil", "nan", "na", "n/a", "n.a", "undefined", "empty", "blank", "void", "#n/a", "missing", "novalue", "no value"}

#: What a provider says of itself and of its task (first group) and how it declines (second), by language. A refusal has both.
_TASK = {
    "en": r"\b(?:language (?:model|assistant)|ai\b|assistant|translat\w*|content guidelines?|content polic\w*|this (?:kind of )?(?:content|request)|that request|your request|guidelines|process\b|this passage|material\b)",
    "de": r"\b(?:sprachmodell|ki\b|ki-\w+|assistent\w*|übersetz\w*|inhalte?n?\b|anfrage|richtlinien)",
    "fr": r"\b(?:modèle de langue|assistant\w*|ia\b|tradui\w*|traduction|contenu|cette demande|votre demande|directives)",
    "es": r"\b(?:modelo de lenguaje|asistente|ia\b|traduc\w*|traduzca|contenido|solicitud|petición|directrices)",
    "pt": r"\b(?:modelo de linguagem|assistente|ia\b|traduz\w*|tradução|conteúdo|pedido|solicitação|diretrizes)",
    "vi": r"(?:mô hình ngôn ngữ|trợ lý|\bai\b|\bdịch\b|nội dung|yêu cầu)",
    "ja": r"(?:言語モデル|アシスタント|(?<![a-z])ai(?![a-z])|翻訳|コンテンツ|内容|ご依頼|リクエスト|ガイドライン)",
    "ko": r"(?:언어 모델|어시스턴트|(?<![a-z])ai(?![a-z])|번역|콘텐츠|내용|요청|가이드라인)",
    "zh": r"(?:语言模型|語言模型|助手|(?<![a-z])ai(?![a-z])|翻译|翻譯|内容|請求|请求|准则)",
}
_DECLINE = {
    "en": r"(?:\bcan(?:no|')t\b|\bcannot\b|\bcan not\b|unable|won'?t|not able|not allowed|not permitted|may not|must decline|decline|violat\w*|no translation|apolog\w*|refuse)",
    "de": r"(?:kann \w*\s?(?:\w+ ){0,6}nicht|kann keine?|nicht (?:übersetzen|möglich|gestattet|erlaubt)|darf (?:\w+ ){0,6}(?:keine?|nicht)|leider|tut mir leid|unmöglich|verstößt)",
    "fr": r"(?:ne (?:peux|puis|peut)|impossible|pas autorisé\w*|désolé|refuse|enfreint)",
    "es": r"(?:no puedo|no me (?:está|es)|imposible|lo siento|no es posible|no (?:está )?permitido|no tengo permi\w*|infringe|lamento)",
    "pt": r"(?:não (?:posso|consigo|tenho|é possível|me é)|impossível|desculpe|lamento|viola)",
    "vi": r"(?:không thể|không được phép|xin lỗi|rất tiếc|từ chối|vi phạm)",
    "ja": r"(?:できません|できかねます|お応えできません|応じられません|申し訳|お断り|いたしかねます|致しかねます|違反)",
    "ko": r"(?:수 없습니다|없습니다|죄송|거부|거절|위반)",
    "zh": r"(?:无法|無法|不能|抱歉|拒绝|拒絕|对不起|不便|违反)",
}
#: phrases of a character who talks of something else than the task would miss these
_SURE = re.compile(r"\bas an? (?:ai|language|artificial)\b|\b(?:language|ai) (?:model|assistant)\b|als (?:ki|sprachmodell|sprachassistent)|en tant qu'(?:ia|assistant|modèle)|como (?:asistente|assistente|modelo|ia)\b|là một (?:trợ lý|mô hình|ai)|aiアシスタント|言語モデル|언어 모델|ai 어시스턴트|作为(?:一个|一名)?(?:ai|人工智能|语言)", re.I)
_REFUSAL = {x: (re.compile(_TASK[x], re.I), re.compile(_DECLINE[x], re.I)) for x in LANGUAGES}

#: What every refusal above contains, in lower case: a text without any of it is none. The short ones stand by themselves.
_STEMS = [
    "language model", "language assistant", "artificial", "assistant", "translat", "content", "this request", "that request", "your request", "guideline", "process", "passage", "material",
    "sprachmodell", "sprachassistent", "assistent", "übersetz", "inhalt", "anfrage", "richtlinien", "modèle", "tradui", "traduction", "contenu", "cette demande", "votre demande",
    "directives", "modelo", "asistente", "traduc", "traduz", "contenido", "solicitud", "petición", "directrices", "assistente", "tradução", "conteúdo", "pedido", "solicitação", "diretrizes",
    "mô hình", "trợ lý", "dịch", "nội dung", "yêu cầu", "言語モデル", "アシスタント", "翻訳", "コンテンツ", "内容", "ご依頼", "リクエスト", "ガイドライン", "언어 모델", "어시스턴트", "번역", "콘텐츠", "내용", "요청",
    "가이드라인", "语言模型", "語言模型", "助手", "翻译", "翻譯", "請求", "请求", "准则", "人工智能",
]
_SHORT_STEMS = ["ai", "ki", "ia"]


@functools.cache
def _stems() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in (*_STEMS, *_SHORT_STEMS):
        found.add_word(x, x)
    found.make_automaton()
    return found


def _may_refuse(text: str) -> bool:
    """Whether a text names the task or the provider at all: one pass over its signs, before the expressions."""
    low = text.lower()
    for end, stem in _stems().iter(low):
        if stem not in _SHORT_STEMS or not (low[end - 2:end - 1].isascii() and low[end - 2:end - 1].isalpha() if end > 1 else False) and not (low[end + 1:end + 2].isascii() and low[end + 1:end + 2].isalpha()):
            return True
    return False


_NOT_ALNUM = regex.compile(r"[^\p{L}\p{N}]+")


def key(text: str) -> str:
    return _NOT_ALNUM.sub("", text.casefold())


def is_empty(target: str | None, source: str | None = None) -> bool:
    """Nothing but blanks, invisible signs, marks, codes and tags, or a stand-in for no value.

    A source that is the same word is no gap. Names that are spelled like a stand-in are left to ``PairModel.defect``.
    """
    if target is None:
        return True
    kind = emptiness(target)
    return kind == EMPTY or kind == STAND_IN and key(bare(source or "")) != key(bare(target).strip(" \"'[](){}<>*_.-").lower())


WRITTEN, EMPTY, STAND_IN = range(3)


def emptiness(target: str) -> int:
    """Whether a target is written, empty, or a stand-in for no value, which is no gap where the source is the same word."""
    t = bare(target)
    if not key(t):
        return EMPTY
    return STAND_IN if t.strip(" \"'[](){}<>*_.-").lower() in STAND_INS else WRITTEN


def is_refusal(target: str, source: str) -> bool:
    """The provider declines: dictionary words for its task or itself together with words for declining, in one language and near each other."""
    t = bare(target)
    if not _may_refuse(t):
        return False
    if _SURE.search(t):
        return not _SURE.search(source or "")
    for a, b in sentences(t):
        part = t[a:b]
        for task, decline in _REFUSAL.values():
            if (x := task.search(part)) and decline.search(part) and not task.search(source or ""):
                return x is not None
    return False


#: share of the letters and digits that may differ between a source and its copies
NEAR = 0.05


@functools.lru_cache(maxsize=256)
def _compressor(source: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_dict_id=False)


def copy_likely(source: bytes, target: bytes) -> bool:
    """Whether ``target`` compresses to next to nothing with ``source`` as a zstandard dictionary: a copy, or one with a few changes."""
    return len(_compressor(source).compress(target)) <= 24 + len(target) // 8


def edits(a: str, b: str, most: int) -> int | None:
    """Edit distance of two strings up to ``most``, else None: furthest places on each diagonal, one edit after the other."""
    if abs(len(a) - len(b)) > most:
        return None
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))

    def slide(i: int, d: int) -> int:
        """End of the run of equal letters from place i of a, on the diagonal where b is d ahead."""
        j, step = i + d, 16
        while i < len(x) and j < len(y):
            n = min(step, len(x) - i, len(y) - j)
            off = np.flatnonzero(x[i:i + n] != y[j:j + n])
            if len(off):
                return i + int(off[0])
            i, j, step = i + n, j + n, step * 4
        return i

    reach = {0: slide(0, 0)}
    for k in range(most + 1):
        if reach.get(len(y) - len(x), -1) >= len(x):
            return k
        more = {}
        for d in range(-k - 1, k + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
            if i >= 0 and 0 <= i + d and (i := min(i, len(x), len(y) - d)) >= 0:
                more[d] = slide(i, d)
        reach = more
    return None


def copy_edits(source: str, target: str) -> int | None:
    """In how many letters and digits the target differs from the source, or from the source again and again, where that is at most a twentieth; None for what is no copy.

    Sources below 24 letters (10 if ja, ko or zh) are no case. Where no more may differ, some piece of the source is unchanged in the target: only such targets are compressed with their
    source as dictionary, and only those that shrink to next to nothing are compared.
    """
    plain = bare(source)
    n = letters(plain)
    if n < 10 or n < 24 and sum("ぁ" <= c <= "鿿" or "가" <= c <= "힯" for c in plain) * 2 < n:
        return None
    best = None
    for s, t in ((key(source), key(target)), (key(plain), key(bare(target)))):
        times = round(len(t) / len(s)) if s else 0
        if not times:
            continue
        pieces = int(NEAR * len(s)) + 1
        size = len(s) // pieces
        if not any(s[i * size:(i + 1) * size] in t for i in range(pieces)) or not copy_likely(s.encode("utf-8", "replace"), t.encode("utf-8", "replace")):
            continue
        k = 0 if s * times == t else edits(s * times, t, int(NEAR * len(s) * times))
        if k is not None and (best is None or k < best):
            best = k
    return best


def is_copy(source: str, target: str) -> bool:
    """The target is the source, once or again and again, but for case, blanks, marks and symbols."""
    return copy_edits(source, target) == 0


_STAND_IN_KEYS = {key(x) for x in STAND_INS}


def _spelling(source: str, target: str) -> tuple[str, str] | None:
    """Keys of a short source and of an answer that is a stand-in, capital first ('' for any other answer); None for longer sources."""
    s = key(bare(source))
    if len(s) > 12:
        return None
    t = bare(target)
    return s, w if t.istitle() and (w := key(t)) in _STAND_IN_KEYS else ""


def spelled_names(results: DataFrame) -> DataFrame:
    """(source, answer) keys of the names that are spelled like a stand-in: short sources most of whose answers, at least two, are one and the same. Counts every row; repeated pairs are combined on the map side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for pair, k in Counter(zip(*(c.to_pylist() for c in batch.columns))).items():
                if spelling := _spelling(*pair):
                    n[spelling] += k
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["source", "answer", "n"])

    counts = results.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").mapInArrow(run, "source string, answer string, n bigint")
    counts = counts.groupBy("source", "answer").agg(F.sum("n").alias("n")).groupBy("source").agg(F.sum("n").alias("all"), F.max_by("answer", F.when(F.col("answer") != "", F.col("n"))).alias("answer"), F.max(F.when(F.col("answer") != "", F.col("n"))).alias("n"))
    return counts.where((F.col("n") >= 2) & (F.col("n") * 2 > F.col("all"))).select("source", "answer")


#: a pair counts as often as it occurs, but at most so many times for lengths and endings and as an example of an end
MOST, EXAMPLES = 20, 4

_KEYS = [f"k{i}" for i in range(KINDS)]


def _ratio(source: str, target: str) -> float:
    return np.log((len(bare(target)) + 4) / (len(bare(source)) + 4))


def _examples(source: str, target: str, times: int, rng: np.random.Generator) -> Iterator[tuple[str, int]]:
    """Targets that are whole (0) and beginnings of the target (1), at random; nothing where only one of the two texts ends in a full stop: it may be cut itself."""
    full = closed(target)
    if full != closed(source):
        return
    stripped = bare(target)
    size = len(key(stripped))
    for _ in range(min(times, EXAMPLES)):
        yield target, 0
        if full and rng.random() < 0.15:
            less = stripped.rstrip(".!?。！？\"'”’»」』 ")
            yield less + ("…" if rng.random() < 0.3 else ""), 0
        if len(stripped) >= 8:
            for _ in range(2):
                cut = stripped[:int(rng.integers(max(2, len(stripped) // 8), len(stripped)))]
                if rng.random() < 0.3 and " " in cut:
                    cut = cut[:cut.rindex(" ")]
                if closed(cut) or not 2 <= len(key(cut)) < size:
                    continue
                yield cut + ("…" if rng.random() < 0.08 else ""), 1


class PairModel:
    """What the judgement of a pair needs: languages, encodings, endings and lengths, learned from a list of pairs or from a table (``of_table``), and the names
    that are spelled like a stand-in (``spelled_names``; without them those of the list)."""

    def __init__(self, language: LanguageModel, encoding: EncodingModel, sample: list[tuple[str, str]], seed: int = 7, named: set[tuple[str, str]] | None = None):
        self.language, self.encoding = language, encoding
        if named is None:
            answers: dict[str, Counter] = defaultdict(Counter)
            for s, w in filter(None, (_spelling(s, t) for s, t in sample)):
                answers[s][w] += 1
            named = {(s, w) for s, c in answers.items() for w, n in c.most_common(1) if w and n >= 2 and n > sum(c.values()) / 2}
        self.named = named
        times = Counter(sample)
        good = self._good(list(times))
        ratios = defaultdict(list)
        for s, t, x, y in good:
            for k in ((x, y), ("", y), ("", "")):
                ratios[k] += [_ratio(s, t)] * times[s, t]
        self.ratio = {k: (float(np.median(v)), float(np.std(v)) + 0.05) for k, v in ratios.items() if len(v) >= 30 or k == ("", "")}
        # where only the source ends in a full stop, the answer may be cut
        whole = [bare(t) for s, t, _, _ in good if closed(s) == closed(t) for _ in range(times[s, t])]
        self.ends = EndModel([t[a:b] for t in whole for a, b in sentences(t)])
        rng = np.random.default_rng(seed)
        rows, truth = [], []
        for s, t, x, y in good:
            for shown, cut in _examples(s, t, times[s, t], rng):
                rows.append((s, shown, x, y))
                truth.append(cut)
        self.cut = Logistic(self.features(rows), np.array(truth, float)) if len(set(truth)) == 2 else None

    @classmethod
    def of_table(cls, results: DataFrame, seed: int = 7) -> PairModel:
        """Learned from every row of ``results``. Words, bytes, lengths, ends and examples are counted where the rows are; of the ends only those come to the driver that the
        targets of this table without a full stop ask for, so other tables need a model of their own."""
        self = cls.__new__(cls)
        self.named = {tuple(r) for r in spelled_names(results).collect()}
        self.language = LanguageModel.of_table(labelled_texts(results))
        self.encoding = EncodingModel.of_table(results.select(F.col("target").alias("text")))
        context = results.sparkSession.sparkContext
        sent = context.broadcast(self)
        pairs = results.where(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))

        def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns[:2])))
                n = dict(zip(rows, batch.column(2).to_pylist()))
                for s in slices((len(a) + len(b) for a, b in rows), 1_000_000):
                    found = [(*r, n[r[:2]], float(_ratio(*r[:2]))) for r in sent.value._good(rows[s])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 6, [pa.string()] * 4 + [pa.int64(), pa.float64()])], names=["source", "target", "x", "y", "n", "r"])

        found = store(pairs.mapInArrow(good, "source string, target string, x string, y string, n bigint, r double"), "good")
        times = F.least(F.col("n"), F.lit(MOST))
        sums = found.rollup("y", "x").agg(F.percentile("r", F.lit(0.5), times).alias("median"), F.sum(times).alias("n"), F.sum(times * F.col("r")).alias("s"), F.sum(times * F.col("r") * F.col("r")).alias("q"))
        self.ratio = {(r.x or "", r.y or ""): (r.median, math.sqrt(max(0.0, r.q / r.n - (r.s / r.n) ** 2)) + 0.05) for r in sums.collect() if r.n and (r.n >= 30 or r.y is None)}
        sent.destroy()
        self._fit_ends(results, found, seed)
        return self

    def _good(self, pairs: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
        """(source, target, their languages) of the pairs without another defect than a cut and with letters on both sides."""
        fine = [(s, t) for s, t in pairs if not (is_empty(t, s) or is_refusal(t, s) or is_copy(s, t))]
        rise = self.encoding.rises([t.encode("utf-8", "replace") for _, t in fine]) if fine else np.empty(0)
        fine = [p for p, r in zip(fine, rise) if r < 9]
        langs = [[LANGUAGES[k] if own.any() else None for own, k in zip(total, total.argmax(axis=1))] for total in (self.language.totals([p[i] for p in fine]) for i in (0, 1))]
        return [(s, t, x, y) for (s, t), x, y in zip(fine, *langs) if x and y]

    def _fit_ends(self, results: DataFrame, good: DataFrame, seed: int) -> None:
        """``ends`` and ``cut`` of the pairs (source, target, x, y, n): counts of ends and examples are tables that are joined, the regression sums over them."""
        lengths = PairModel.__new__(PairModel)  # all that examples need
        lengths.ratio = self.ratio

        def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = list(zip(*(batch.column(c).to_pylist() for c in ("source", "target", "x", "y", "n"))))
                for s in slices((len(p[0]) + len(p[1]) for p in pairs), 200_000):
                    n: Counter = Counter()
                    for source, target, x, y, times in pairs[s]:
                        rng = np.random.default_rng((xxhash.xxh64_intdigest(f"{source}\0{target}".encode("utf-8", "surrogatepass")), seed))
                        n.update((source, shown, x, y, cut) for shown, cut in _examples(source, target, times, rng))
                    shape, last = lengths._shape([r[:4] for r in n])
                    full = shape[:, 4] > 0  # the last words of these don't matter
                    keys, valid = end_keys(last)
                    keys = np.where(valid, keys, 0)
                    sig = np.array([xxhash.xxh64_intdigest(k.tobytes()) for k in keys], np.uint64).view(np.int64)
                    valid &= ~full[:, None]
                    bits = shape[:, [0, 1, 2, 3, 4, 8]].astype(np.int32) @ (1 << np.arange(6, dtype=np.int32)) | (shape[:, 7].astype(np.int32) + 3) << 6
                    yield pa.RecordBatch.from_arrays([pa.array(sig, mask=full), pa.array(shape[:, 5]), pa.array(bits.astype(np.int32)), *(pa.array([v * (r[4] == y) for r, v in n.items()], pa.int64()) for y in (0, 1)),
                                                      *(pa.array(keys[:, i], mask=~valid[:, i]) for i in range(KINDS))], names=["sig", "short", "bits", "n0", "n1", *_KEYS])

        shown = store(good.mapInArrow(examples, "sig bigint, short double, bits int, n0 bigint, n1 bigint, " + ", ".join(f"{k} bigint" for k in _KEYS)), "examples")
        ends = store(shown.where("sig is not null").groupBy("sig").agg(*[F.first(k).alias(k) for k in _KEYS], F.count(F.lit(1)).alias("examples")), "ends")

        def open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, valid = end_keys([DOTS.sub("", bare(t)) for t in set(batch.column(0).to_pylist()) if not closed(t)])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys[valid]), pa.int64())], names=["key"])

        asked = results.where("target is not null").select("target").mapInArrow(open_ends, "key bigint").distinct().withColumn("open", F.lit(1))
        keyed = ends.select("sig", F.posexplode(F.array(*_KEYS)).alias("kind", "key")).where("key is not null")
        uses = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).withColumn("open", F.lit(0)).unionByName(asked.withColumn("uses", F.lit(0).cast("bigint")))
        uses = store(uses.groupBy("key").agg(F.sum("uses").alias("uses"), F.max("open").alias("open")), "uses")
        sent = SentFilter(uses.select("key"), uses.count())

        def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = list(zip(*(batch.column(c).to_pylist() for c in ("source", "target", "n"))))
                for s in slices((len(p[0]) + len(p[1]) for p in pairs), 500_000):
                    # where only the source ends in a full stop, the answer may be cut
                    whole = [(bare(t), min(n, MOST)) for a, t, n in pairs[s] if closed(a) == closed(t)]
                    parts = [(t[a:b], n) for t, n in whole for a, b in sentences(t)]
                    found = end_counts([u for u, _ in parts], np.array([n for _, n in parts], float), sent.holds)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "a", "b"])

        counts = good.mapInArrow(units, "key bigint, a double, b double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 2")  # what occurs once says nothing
        counts = store(uses.join(counts, "key"), "counts")
        sent.destroy()
        found = counts.where("open = 1").select("key", "a", "b").toArrow()
        self.ends = EndModel.of_counts(*(found.column(c).to_numpy() for c in ("key", "a", "b")))
        known = lookup(keyed, counts.where("uses > 0").select("key", "uses", "a", "b"), ["key"], "uses", max(1, ends.count()))
        sums = known.repartition("sig").groupBy("sig").agg(*[F.sum(F.when(F.col("kind") == i, F.col(x))).alias(f"{x}{i}") for x in "ab" for i in range(KINDS)])

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = (np.nan_to_num(np.stack([batch.column(f"{x}{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(KINDS)], axis=1)) for x in "ab")
                    yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("examples"), pa.array(end_scores(a, b, a + b > 0))], names=["sig", "examples", "e"])

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    short, bits, e = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("short", "bits", "e"))
                    flags = (bits[:, None] >> np.arange(6) & 1).T.astype(float)
                    x = PairModel._with_ends(np.stack([*flags[:5], short, np.minimum(short, 0), (bits >> 6) - 3.0, flags[5]], axis=1), e)
                    yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column("n0"), batch.column("n1")], names=["x", "n0", "n1"])

        scored = store(ends.select("sig", "examples").join(sums, "sig", "left").mapInArrow(scores, "sig bigint, examples bigint, e double"), "scores")
        shown = shown.select("sig", "short", "bits", "n0", "n1")
        shown = lookup(shown.where("sig is not null"), scored, ["sig"], "examples", max(1, shown.count())).unionByName(shown.where("sig is null").withColumn("e", F.lit(0.0)))
        self.cut = Logistic.of_table(store(shown.mapInArrow(features, "x array<double>, n0 bigint, n1 bigint"), "features"))

    def features(self, rows: list[tuple[str, str, str | None, str | None]]) -> np.ndarray:
        """One row for each (source, target, their languages)."""
        shape, last = self._shape(rows)
        return self._with_ends(shape, self.ends.scores(last))

    def _shape(self, rows: list[tuple[str, str, str | None, str | None]]) -> tuple[np.ndarray, list[str]]:
        """(n, 9) full stops, dots and lengths of each (source, target, their languages), and the targets without dots at their end."""
        out = np.zeros((len(rows), 9))
        last, seen = [], {}
        for i, (source, target, x, y) in enumerate(rows):
            if source not in seen:
                s = bare(source)
                seen[source] = len(s), closed(source), len(sentences(s))
            size, sf, parts = seen[source]
            t = bare(target)
            mean, spread = self.ratio.get((x, y)) or self.ratio.get(("", y)) or self.ratio.get(("", "")) or (0.0, 1.0)
            short = min(6.0, max(-6.0, (math.log((len(t) + 4) / (size + 4)) - mean) / spread))
            tf = closed(target)
            missing = min(3.0, max(-3.0, parts - sum(closed(t[a:b]) for a, b in sentences(t)))) if sf else 0.0
            out[i] = sf and not tf, sf and tf, not sf and not tf, bool(DOTS.search(t)) and not tf, tf, short, min(short, 0), missing, sf
            last.append(DOTS.sub("", t))
        return out, last

    @staticmethod
    def _with_ends(shape: np.ndarray, e: np.ndarray) -> np.ndarray:
        """What the regression reads; ``e``: the scores of the last words."""
        open_, both, none, dots, tf, short, low, missing, sf = shape.T
        return np.stack([open_, both, none, dots, e * (1 - tf), np.maximum(e, 0) * (1 - tf), short, low, low * (1 - tf), missing, missing * (1 - tf), open_ * e], axis=1)

    def truncated(self, rows: list[tuple[str, str, str | None, str | None]], least: float = 0.4) -> list[bool]:
        """For each (source, target, their languages) whether the target is cut."""
        out = [False] * len(rows)
        some = [i for i, r in enumerate(rows) if not closed(r[1])]
        if self.cut is None or not some:
            return out
        f = self.features([rows[i] for i in some])
        for i, row, p in zip(some, f, self.cut.probability(f)):
            if row[0]:
                out[i] = bool(p >= least)
                continue
            # A source without a full stop, as names and labels, says nothing of how its answer ends: it must be long enough to be a sentence, the answer far too short
            # and its last words such as never close one.
            source = rows[i][0]
            n = letters(bare(source))
            dense = sum("ぁ" <= c <= "鿿" or "가" <= c <= "힯" for c in source) * 2 > n
            out[i] = bool(p >= 0.7 and n >= (10 if dense else 24) and row[6] <= -1.5 and row[4] < 0)
        return out

    def defect(self, source: str | None, target: str | None, source_lang: str | None, target_lang: str | None) -> str | None:
        return self.defects([(source, target, source_lang, target_lang)])[0]

    def defects(self, rows: list[tuple[str | None, str | None, str | None, str | None]]) -> list[str | None]:
        """The defect of each pair, or None; a source without letter and digit is never judged. ``near_copied`` are copies in which up to a twentieth of the letters differ,
        if they have no other defect."""
        out: list[str | None] = [None] * len(rows)
        left: list[int] = []
        near: set[int] = set()
        for i, (source, target, _, _) in enumerate(rows):
            if not source or not any(map(str.isalnum, source)):
                continue
            if is_empty(target, source):
                named = target is not None and (key(bare(source)), key(bare(target))) in self.named
                out[i] = None if named else "empty"
            elif is_refusal(target, source):
                out[i] = "refusal"
            else:
                k = copy_edits(source, target)
                if k == 0:
                    out[i] = "copied"
                    continue
                left.append(i)
                if k is not None:
                    near.add(i)
        wide = [i for i in left if not rows[i][1].isascii()]
        damaged = {i for i, r in zip(wide, self.encoding.rises([rows[i][1].encode("utf-8", "replace") for i in wide])) if r >= 9} if wide else set()
        left = [i for i in left if i not in damaged]
        if not left:
            return out
        asked = [(rows[i][2] or "").strip().lower() for i in left]
        unknown = [k for k, x in enumerate(asked) if x not in LANGUAGES]
        if unknown:
            for k, total in zip(unknown, self.language.totals([rows[left[k]][0] for k in unknown])):
                asked[k] = LANGUAGES[int(total.argmax())] if total.any() else None
        targets = [rows[i][1] for i in left]
        totals, parts = self.language.totals(targets), self.language.many(targets)
        doubtful = []
        for i, own, total, part in zip(left, asked, totals, parts):
            wanted = (rows[i][3] or "").strip().lower()
            if len(part) == 1 and wanted in LANGUAGES and part[0][0] not in (wanted, own):
                lead = total[LANGUAGES.index(part[0][0])] - max(total[LANGUAGES.index(z)] for z in {wanted, own} - {None})
                if lead >= 9 and letters(blank_codes(rows[i][1])) >= (6 if part[0][0] in DENSE else 12):
                    out[i] = "other_language"
                    continue
            # a target that changes language may be cut as well: its end is in the last one
            doubtful.append((i, (rows[i][0], rows[i][1], own, part[-1][0] if part else None)))
        for (i, _), cut in zip(doubtful, self.truncated([r for _, r in doubtful])):
            if cut:
                out[i] = "truncated"
            elif i in near:
                out[i] = "near_copied"
        return out


def train_pair_model(results: DataFrame, sample_rows: int | None = None, frequent_rows: int | None = None) -> PairModel:
    """Fit on every row of ``results``, which is also the table that ``defective_pairs`` can judge by it. ``sample_rows`` and ``frequent_rows`` bounded the sample of an earlier
    version; they are taken and change nothing."""
    return PairModel.of_table(results)


def defective_pairs(results: DataFrame, model: PairModel) -> DataFrame:
    """(ord, defect) of every defective row of ``results``; repeated rows come each by itself. Beside the five defects ``near_copied``: see ``PairModel.defects``.

    Null and blank sources are never judged; a null target is ``empty``; unknown language codes leave ``other_language`` out.
    """
    sent = results.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            # each different pair of the batch is judged once
            pairs = list(zip(*(c.to_pylist() for c in batch.columns[1:])))
            different = list(dict.fromkeys(pairs))
            kind: dict[tuple, str | None] = {}
            start = size = 0
            for i in range(len(different) + 1):
                if i == len(different) or size > 1_000_000:
                    kind.update(zip(different[start:i], m.defects(different[start:i])))
                    start, size = i, 0
                if i < len(different):
                    size += sum(len(x or "") for x in different[i])
            kinds = [kind[p] for p in pairs]
            keep = pa.array([k is not None for k in kinds], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([k for k in kinds if k], pa.string())], names=["ord", "defect"])

    return results.select(F.col("ord").cast("bigint").alias("ord"), "source", "target", "source_lang", "target_lang").mapInArrow(run, "ord bigint, defect string")
