"""Language of texts and of the segments of mixed texts.

Script ranges narrow the candidates of each word; within a script a multinomial model over whole words and character
n-grams scores them. A Viterbi path over the word scores, with one penalty for a switch between sentences and a far larger one
within a sentence, labels the text.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import store
from .sampling import sample_distinct
from .words import Words, lowered, slices

LANGUAGES = ["en", "de", "fr", "es", "pt", "vi", "ja", "ko", "zh"]
LATIN = [LANGUAGES.index(x) for x in ("en", "de", "fr", "es", "pt", "vi")]
HAN = [LANGUAGES.index(x) for x in ("ja", "zh")]
JA, KO, ZH = (LANGUAGES.index(x) for x in ("ja", "ko", "zh"))
#: languages whose texts are dense: fewer letters suffice
DENSE = {"ja", "ko", "zh"}

#: Spellings of the languages' names, apart from the code with a region.
NAMES = {
    "en": "en eng english anglais englisch inglés",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castilian",
    "pt": "pt por portuguese português portugues brazilian",
    "vi": "vi vie vietnamese tiếng viet",
    "ja": "ja jpn jp japanese 日本語",
    "ko": "ko kor kr korean 한국어",
    "zh": "zh zho chi cmn cn chinese mandarin 中文 汉语 漢語",
}
#: Function words, so that a language is known beyond the topics of the sample.
COMMON = {
    "en": "the of and to in is that it for was on are as with his they at be this have from or had by not but what all were when we there can an your which their said if will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know this text content request sorry unable cannot please provide unfortunately given any other different help translation passage assistant language",
    "de": "der die das und ist nicht ein eine einen dem den des zu mit auf für von im sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich du wir ihr mein dein kann können leider diesen text keine inhalte darf",
    "fr": "le la les de des un une et est que qui dans en pour pas au sur se ce il elle ne plus par avec son sa ses mais nous vous je tu ou si leur y cette ces été être avoir fait comme tout bien aux où même peut sont ont désolé contenu demande impossible texte",
    "es": "el la los las de un una y es que en no se por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno les ni contra otros ese eso ante ellos puedo contenido solicitud siento texto",
    "pt": "o a os as de um uma e é que em não se por com para seu sua ao do da dos das no na como mais mas ou já este esta isso quando muito sem sobre também me até há onde quem desde tudo nos pelo pela você eu ele ela são foi ser ter posso conteúdo pedido desculpe texto",
    "vi": "và của là không có cho được trong một người những với các này đã khi để đến từ tôi bạn anh chị ông bà nó họ chúng ta thì mà ở ra vào lên xuống rồi cũng như nhưng nếu vì sẽ đang rất nhiều hơn nhất lại còn chỉ nào gì ai đâu sao nội dung yêu cầu xin lỗi dịch thể",
    "zh": "的 了 是 不 我 在 有 他 这 个 们 来 说 你 就 也 都 那 要 会 对 没 去 能 和 到 着 把 让 吗 呢 吧 什么 怎么 知道 没有 自己 可以 我们 他们 这里 那里 因为 所以 但是 如果 还是 已经 时候",
    "ja": "今日 本当 残念 時間 場所 言 気 見 行 思 者 何 私 君 彼 誰 前 後 中 上 下 年 日 時 人 力 村 扉 森 王 女 男",
}
_SPELLING = {w: code for code, words in NAMES.items() for w in words.split()}

CODES = re.compile(r"\\[A-Za-z]+(?:\[[^\]\n]*\])?|\\[^A-Za-z\s]|%\d+|<[^<>\n]{0,80}>|\{[^{}\n]{0,80}\}")
_WORD = re.compile("[\u3041-\u30ff\uff66-\uff9f]+|[\u3400-\u9fff\uf900-\ufaff々]+|[\uac00-\ud7af\u1100-\u11ff\u3130-\u318f]+|[A-Za-z\u00c0-\u024f\u1e00-\u1eff]+")


@functools.cache
def _scripts() -> np.ndarray:
    """The same scripts as classes of code points."""
    out = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(((0x41, 0x5A, 0x61, 0x7A, 0xC0, 0x24F, 0x1E00, 0x1EFF), (0x3400, 0x9FFF, 0xF900, 0xFAFF, 0x3005, 0x3005), (0xAC00, 0xD7AF, 0x1100, 0x11FF, 0x3130, 0x318F), (0x3041, 0x30FF, 0xFF66, 0xFF9F)), 5):
        for a, b in zip(ranges[::2], ranges[1::2]):
            out[a:b + 1] = k
    return out


_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』”）]*|\n+|\s/\s|…+(?=[^\s.!?。！？])")


def label_language(label: str | None) -> str | None:
    """Code of a usual spelling of one of the nine languages, None for anything else."""
    if not label:
        return None
    first = re.split(r"[-_ (]", unicodedata.normalize("NFC", label).strip().lower(), maxsplit=1)[0]
    return _SPELLING.get(first)


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, without gaps; control codes are as long as they were."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.end() > start:
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def blank_codes(text: str) -> str:
    """Control codes, placeholders and tags replaced by as many blanks; composed letters."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return CODES.sub(lambda m: " " * len(m[0]), text) if "\\" in text or "<" in text or "%" in text or "{" in text else text


def prepared(text: str) -> str:
    """Composed letters in lower case, codes replaced by as many blanks."""
    return lowered(blank_codes(text))


class LanguageModel:
    """Word scores and the Viterbi path over them."""

    FLOOR = -7.0  # the least a word can say for a language against the best one

    def __init__(self, rows: list[tuple[str, str]], between: float = 5.0, within: float = 60.0):
        self.between, self.within = between, within
        rows = [(prepared(t), LANGUAGES.index(x)) for t, x in rows if t and x in LANGUAGES]
        self._fit(rows)
        # labels may be wrong: leave out what the first model reads clearly otherwise, and fit again
        total = self.totals([t for t, _ in rows])
        kept = [(t, x) for (t, x), own in zip(rows, total) if own.any() and own[x] > own.max() - 6]
        self._fit(kept)

    @staticmethod
    def _grams(word: str) -> list[str]:
        if "\u3400" <= word[0] <= "\u9fff":
            return [*word, *(word[i:i + 2] for i in range(len(word) - 1))]
        padded = f"<{word}>"
        return [f"={word}", *(padded[i:i + 2] for i in range(len(padded) - 1)), *(padded[i:i + 3] for i in range(len(padded) - 2)), *(padded[i:i + 4] for i in range(len(padded) - 3))]

    def _fit(self, rows: list[tuple[str, int]]) -> None:
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for t, x in rows:
            for w in _WORD.findall(t):
                words[w][x] += 1
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for w, n in words.items():
            if not ("\u3041" <= w[0] <= "\u30ff" or "\uac00" <= w[0] <= "\ud7af"):
                for g in self._grams(w):
                    counts[g] += np.sqrt(n)  # damped, so that frequent words do not rule the n-grams
        self._set(counts)

    def _set(self, counts: dict[str, np.ndarray]) -> None:
        """Scores by the counts (languages) of each n-gram, to which those of the function words are added."""
        for code, text in COMMON.items():
            for w in text.split():
                for g in self._grams(w):
                    counts[g][LANGUAGES.index(code)] += 3
        total = sum(counts.values(), np.zeros(len(LANGUAGES))) + 1
        mean = total[LATIN].mean()
        self.grams = {g: np.log((n + 0.3) / (total + 0.3 * mean)) for g, n in counts.items()}
        self.unseen = np.log(0.3 / (total + 0.3 * mean))
        self.cache: dict[str, np.ndarray] = {}

    @classmethod
    def of_table(cls, texts: DataFrame, between: float = 5.0, within: float = 60.0) -> LanguageModel:
        """The same, learned from every different row of ``texts`` (t, l: text and language); only the n-grams of its different words come to the driver.

        N-grams count as if each language had equally many texts, so that rare ones are learned too.
        """
        self = cls.__new__(cls)
        self.between, self.within = between, within
        texts = store(texts.select("t", "l").distinct(), "labelled")
        words = store(self._word_counts(texts), "words")
        self._set(self._gram_counts(words))
        sent = texts.sparkSession.sparkContext.broadcast(self)

        def otherwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns)))
                for s in slices((len(t) for t, _ in rows), 1_000_000):
                    total = sent.value.totals([t for t, _ in rows[s]])
                    out = [r for r, own in zip(rows[s], total) if not (own.any() and own[LANGUAGES.index(r[1])] > own.max() - 6)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], names=["t", "l"])

        less = self._word_counts(texts.mapInArrow(otherwise, "t string, l string"), -1)
        self._set(self._gram_counts(words.unionByName(less).groupBy("word", "l").agg(F.sum("n").alias("n")).where("n > 0")))
        sent.destroy()
        return self

    @staticmethod
    def _word_counts(texts: DataFrame, times: int = 1) -> DataFrame:
        """(word, l, n), each text counted so many times; the texts themselves are counted as the word ''."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n: Counter = Counter()
                for t, x in zip(*(c.to_pylist() for c in batch.columns)):
                    n[x, ""] += times
                    for w in _WORD.findall(prepared(t)):
                        n[x, w] += times
                yield pa.RecordBatch.from_arrays([pa.array([w for _, w in n], pa.string()), pa.array([x for x, _ in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "l", "n"])

        return texts.mapInArrow(run, "word string, l string, n bigint").groupBy("word", "l").agg(F.sum("n").alias("n"))

    @classmethod
    def _gram_counts(cls, words: DataFrame) -> dict[str, np.ndarray]:
        """Counts (languages) of the n-grams of the words (word, l, n); whole numbers are summed, so that their order does not matter."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n: Counter = Counter()
                for w, x, k in zip(*(c.to_pylist() for c in batch.columns)):
                    if not w:
                        n[x, w] += k
                    elif not ("\u3041" <= w[0] <= "\u30ff" or "\uac00" <= w[0] <= "\ud7af"):
                        damped = round(math.sqrt(k) * (1 << 20))
                        for g in cls._grams(w):
                            n[x, g] += damped
                yield pa.RecordBatch.from_arrays([pa.array([g for _, g in n], pa.string()), pa.array([x for x, _ in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "l", "n"])

        found = words.select("word", "l", "n").mapInArrow(run, "gram string, l string, n bigint")
        table = found.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("l") == x, F.col("n"))), F.lit(0)).alias(x) for x in LANGUAGES]).toArrow()
        sums = np.stack([table.column(x).to_numpy() for x in LANGUAGES], axis=1).astype(float)
        counts = defaultdict(lambda: np.zeros(len(LANGUAGES)), zip(table.column("gram").to_pylist(), sums / (1 << 20)))
        many = counts.pop("", np.zeros(len(LANGUAGES))) * (1 << 20)
        if many.any():
            weight = np.sqrt(many[many > 0].mean() / np.maximum(many, 1))
            for g in counts:
                counts[g] = counts[g] * weight
        return counts

    def word(self, w: str) -> np.ndarray:
        """Scores of a lower-case word for each language, 0 for the best."""
        got = self.cache.get(w)
        if got is None:
            got = np.full(len(LANGUAGES), self.FLOOR)
            c = w[0]
            if "\u3041" <= c <= "\u30ff" or "\uff66" <= c <= "\uff9f":
                got[JA] = 0
            elif "\uac00" <= c <= "\ud7af" or "\u1100" <= c <= "\u11ff" or "\u3130" <= c <= "\u318f":
                got[KO] = 0
            else:
                some = HAN if c > "\u2fff" else LATIN
                s = np.zeros(len(LANGUAGES))
                for g in self._grams(w):
                    s = s + self.grams.get(g, self.unseen)
                s = 0.5 * s[some]
                # a run of Han signs is many words
                least = self.FLOOR * max(1, len(w) / 2) if c > "\u2fff" else self.FLOOR
                got[:] = least
                got[some] = np.maximum(s - s.max(), least)
            if len(self.cache) < 200_000 and len(w) < 40:
                self.cache[w] = got
        return got

    def known(self, w: str) -> np.ndarray:
        """For which languages a lower-case word occurs in the sample or among the function words; kana and Hangul are known by their script, Han signs one by one."""
        c = w[0]
        if "\u3041" <= c <= "\u30ff" or "\uff66" <= c <= "\uff9f" or "\uac00" <= c <= "\ud7af" or "\u1100" <= c <= "\u11ff" or "\u3130" <= c <= "\u318f":
            return np.ones(len(LANGUAGES), bool)
        least = self.unseen + 0.5
        if c > "\u2fff":
            return np.mean([self.grams.get(x, self.unseen) > least for x in w], axis=0) >= 0.5
        return self.grams.get(f"={w}", self.unseen) > least

    def words(self, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of prepared texts, their scores (words, languages) and in which languages they are known; each different word is scored once."""
        w = Words(texts, classes=_scripts())
        joined = "".join(texts)
        _, first, back = np.unique(w.hash, return_index=True, return_counts=False, return_inverse=True)
        different = [joined[a:b].lower() for a, b in zip(w.start[first].tolist(), w.stop[first].tolist())]
        scores = np.array([self.word(x) for x in different]).reshape(-1, len(LANGUAGES))
        known = np.array([self.known(x) for x in different], bool).reshape(-1, len(LANGUAGES))
        return w, scores[back], known[back]

    def score(self, text: str) -> np.ndarray:
        """(words, languages) of a prepared text."""
        found = [self.word(w) for w in _WORD.findall(text)]
        return np.array(found) if found else np.zeros((0, len(LANGUAGES)))

    def totals(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): sums of the scores of all words of each text."""
        w, scores, _ = self.words([prepared(t) for t in texts])
        sums = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(scores, axis=0)])
        return sums[w.first + w.count] - sums[w.first]

    def whole(self, text: str | None) -> tuple[str | None, float]:
        """The one language that fits the whole text best, and its lead over the second in nats."""
        total = self.totals([text or ""])[0]
        if not total.any():
            return None, 0.0
        order = np.argsort(total)
        return LANGUAGES[order[-1]], float(total[order[-1]] - total[order[-2]])

    def segments(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """``many`` for one text, without the shares."""
        return [x[:4] for x in self.many([text or ""])[0]]

    def many(self, texts: list[str], within: float | None = None) -> list[list[tuple[str, int, int, float, float]]]:
        """For each text (language, start, end, confidence, known share) of its longest stretches in one language; nothing without known letters.

        Stretches are of whole sentences, each in the language of most of its words, or, if ``within`` is given (the penalty of a switch inside a sentence), of words. Positions are of the text
        with composed letters. Confidence is the probability of the language against the others by the scores of the stretch, damped; the known share is that of the letters of words
        that are known in the language.
        """
        plain = [prepared(t) for t in texts]
        w, scores, known = self.words(plain)
        spans = [sentences(t) for t in plain]
        starts = np.array([int(b) + a for b, s in zip(w.begin, spans) for a, _ in s], np.int64)
        first = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)
        owner = np.searchsorted(starts, w.start, "right") - 1  # sentence of each word
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        sums = np.add.reduceat(scores, edge, axis=0) if len(edge) else np.zeros((0, len(LANGUAGES)))
        heard = owner[edge]  # sentences with words
        best = sums.argmax(axis=1)
        bounds = np.searchsorted(heard, first)
        size = w.stop - w.start
        out: list[list[tuple[str, int, int, float, float]]] = []
        for i in range(len(texts)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if a == b:
                out.append([])
                continue
            p = slice(int(w.first[i]), int(w.first[i] + w.count[i]))
            if within is None and (best[a:b] == best[a]).all():
                out.append([self._part(int(best[a]), 0, len(plain[i]), sums[a:b].sum(axis=0), known[p], size[p])])
                continue
            path = self._viterbi(scores[p], owner[p].tolist(), self.within if within is None else within)
            if within is None:
                # the language of a sentence is that of most of its words; the path switches between sentences but for very mixed ones
                of: dict[int, list[int]] = {}
                for x, o in zip(path, owner[p].tolist()):
                    of.setdefault(o, []).append(x)
                pieces = [[max(set(x), key=x.count) if (x := of.get(o)) else None, *spans[i][o - int(first[i])]] for o in range(int(first[i]), int(first[i + 1]))]
            else:
                pieces = [[x, int(u), int(v)] for x, u, v in zip(path, w.start[p] - w.begin[i], w.stop[p] - w.begin[i])]
            merged: list[list] = []
            for x, u, v in pieces:
                if merged and (x is None or merged[-1][0] == x):
                    merged[-1][2] = v
                elif x is not None:
                    if within is not None and merged:
                        merged[-1][2] = u
                    merged.append([x, u if merged else 0, v])
            merged[-1][2] = len(plain[i])
            parts = []
            for x, u, v in merged:
                inside = np.flatnonzero((w.start[p] - w.begin[i] >= u) & (w.start[p] - w.begin[i] < v)) + p.start
                parts.append(self._part(x, u, v, scores[inside].sum(axis=0), known[inside], size[inside]))
            out.append(parts)
        return out

    @staticmethod
    def _part(x: int, start: int, end: int, total: np.ndarray, known: np.ndarray, size: np.ndarray) -> tuple[str, int, int, float, float]:
        return LANGUAGES[x], start, end, float(1 / np.exp((total - total[x]) / 4).sum()), float(size[known[:, x]].sum() / max(1, size.sum()))

    def _viterbi(self, s: np.ndarray, owner: list[int], within: float) -> list[int]:
        best = s[0].copy()
        back = np.empty((len(s), s.shape[1]), np.int8)
        stay = np.arange(s.shape[1])
        for i in range(1, len(s)):
            cost = min(self.between, within) if owner[i] != owner[i - 1] else within
            top = int(best.argmax())
            jump = best[top] - cost
            take = jump > best
            back[i] = np.where(take, top, stay)
            best = np.where(take, jump, best) + s[i]
        at = int(best.argmax())
        path = [at]
        for i in range(len(s) - 1, 0, -1):
            at = int(back[i, at])
            path.append(at)
        return path[::-1]


def labelled_texts(results: DataFrame) -> DataFrame:
    """(t, l) of the texts whose language is given: targets by target_lang and sources by source_lang."""
    return (results.select(F.col("target").alias("t"), F.lower("target_lang").alias("l"))
            .unionByName(results.select(F.col("source").alias("t"), F.lower("source_lang").alias("l")))
            .where(F.col("l").isin(LANGUAGES) & (F.length("t") > 0)))


def train_language_model(results: DataFrame, sample_rows: int = 24_000) -> LanguageModel:
    """Fit on at most ``sample_rows`` texts whose language is given: targets by target_lang and sources by source_lang, those with the smallest
    hashes; an equal bounded number for each language, so that rare ones are learned too."""
    return LanguageModel([(r.t, r.l) for r in sample_distinct(labelled_texts(results), ["t", "l"], sample_rows // len(LANGUAGES), salt="language", by="l")])
