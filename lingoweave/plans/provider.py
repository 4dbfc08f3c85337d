"""Translation providers: the interface, a deterministic one that works offline, and calls with retries."""

from __future__ import annotations

import json
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import OWN_DELAY, REFUSALS, RETRY_AFTER, SPLIT, text


class Provider(ABC):
    """Translates a batch of texts, in order; it may raise."""

    @abstractmethod
    def translate(self, texts: list[str], target_lang: str, source_lang: str) -> list[str]: ...

    def translate_items(self, items: list[dict], target_lang: str, source_lang: str, glossary: str = "") -> list[str | None]:
        """Answers to items (id, key, source, hint); a provider that takes no more than texts leaves hints and glossary aside."""
        return self.translate([x["source"] for x in items], target_lang, source_lang)


class TextProvider(Provider):
    """A service that takes one text at a time, with a pause of so many seconds between two."""

    pause = 0.2

    @abstractmethod
    def translate_text(self, text: str, target_lang: str, source_lang: str) -> str: ...

    def translate(self, texts: list[str], target_lang: str, source_lang: str) -> list[str]:
        out = []
        for i, t in enumerate(texts):
            if i and self.pause:
                time.sleep(self.pause)
            out.append(self.translate_text(t, target_lang, source_lang))
        return out


class ChatProvider(Provider):
    """A service that is given the glossary and the items as JSON and answers with JSON, which is mended, parsed and matched by id."""

    @abstractmethod
    def complete(self, system: str, user: str) -> str: ...

    def translate(self, texts: list[str], target_lang: str, source_lang: str) -> list[str]:
        return [x or "" for x in self.translate_items([{"id": str(i), "key": str(i), "source": t, "hint": ""} for i, t in enumerate(texts)], target_lang, source_lang)]

    def translate_items(self, items: list[dict], target_lang: str, source_lang: str, glossary: str = "") -> list[str | None]:
        user = json.dumps({"target": target_lang, "source": source_lang, "items": items}, ensure_ascii=False)
        good, _ = parse_answers(self.complete(glossary, user))
        by_id = {x["id"]: x["target"] for x in good if x.get("id")}
        # keys name a text only where all are of one file
        one = len({x["id"].split("\x1f")[0] for x in items}) == 1
        by_key = {x["key"]: x["target"] for x in good if x.get("key")} if one else {}
        found = [by_id.get(x["id"], by_key.get(x["key"])) for x in items]
        return [t if isinstance(t, str) or t is None else parse_segments(t) for t in found]


class UpperProvider(Provider):
    """Answers with the text in capitals: enough to test every step, and to be expressed in SQL."""

    def translate(self, texts: list[str], target_lang: str, source_lang: str) -> list[str]:
        return [t.upper() for t in texts]


class UpperChat(ChatProvider):
    """The same as a conversation in JSON."""

    def complete(self, system: str, user: str) -> str:
        items = json.loads(user)["items"]
        return "```json\n" + json.dumps([{"id": x["id"], "key": x["key"], "target": x["source"].upper()} for x in items], ensure_ascii=False) + "\n```"


PROVIDERS: dict[str, Callable[[], Provider]] = {"upper": UpperProvider, "upper-json": UpperChat}


def make_provider(name: str) -> Provider:
    """A provider by its registered name; networks are not part of this package, register your own."""
    if name.lower() not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name.lower()]()


def judge(message: str) -> tuple[bool, float, bool]:
    """(retry?, seconds to wait, split the batch?) for an error; a refusal is never tried again."""
    low = message.lower()
    split = any(s in low for s in SPLIT)
    if any(r in low for r in REFUSALS):
        return False, 0.0, False
    own = re.search(OWN_DELAY, message)
    if own:
        return True, float(own[1]), split
    for parts, seconds in RETRY_AFTER:
        if any(p in low for p in parts):
            return True, seconds, split
    return False, 0.0, split


def call(provider: Provider, texts: list[str] | list[dict], target_lang: str, source_lang: str, attempts: int = 4, depth: int = 6, wait: float = 5.0, glossary: str = "") -> list[str | None]:
    """Answers to texts, or to items (id, key, source, hint), None where the provider gave none: ``attempts`` tries with growing waits, then halves, down to ``depth``; a text that fails by itself stays None."""
    split = True
    for n in range(attempts):
        try:
            out = provider.translate_items(texts, target_lang, source_lang, glossary) if texts and isinstance(texts[0], dict) else provider.translate(texts, target_lang, source_lang)
            if len(out) != len(texts):
                raise ValueError("not valid JSON: another number of answers")
            return list(out)
        except Exception as e:  # noqa: BLE001 - providers raise anything
            retry, delay, split = judge(str(e))
            if not retry:
                break
            if split and len(texts) > 1:
                break
            if n < attempts - 1 and wait:
                time.sleep(max(delay, wait * 2 ** n))
    if len(texts) == 1 or depth == 0 or not split:
        return [None] * len(texts)
    half = len(texts) // 2
    return [*call(provider, texts[:half], target_lang, source_lang, attempts, depth - 1, wait, glossary), *call(provider, texts[half:], target_lang, source_lang, attempts, depth - 1, wait, glossary)]


def translate_batches(rows: DataFrame, provider: str, target_lang: str, source_lang: str = "auto", batch: list[str] | None = None, wait: float = 5.0, glossary: str = "") -> DataFrame:
    """``rows`` (masked, and the columns of ``batch``) with ``answer``: batches are calls of their own, spread over the executors.

    Columns ``file``, ``key`` and ``hint``, where there are such, go to the provider with the text, and so does ``glossary``, a text of bounded size. Rows of a batch are gathered as
    they stream by, so at most one batch is held. Write the result before it is used twice: a provider may cost money.
    """
    batch = batch or ["file", "block", "batch_no"]
    names = rows.columns
    ordered = rows.repartition(*batch).sortWithinPartitions(*batch)
    make = PROVIDERS[provider]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, at = make(), [], None

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            get = lambda c: [x or "" for x in whole.column(names.index(c)).to_pylist()] if c in names else [""] * whole.num_rows
            items = [{"id": f"{f}\x1f{k}" if k else str(i), "key": k or str(i), "source": t, "hint": h} for i, (f, k, t, h) in enumerate(zip(get("file"), get("key"), get("masked"), get("hint")))]
            answers = call(own, items, target_lang, source_lang, wait=wait, glossary=glossary)
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(answers, pa.string())], names=[*names, "answer"])

        for part in parts:
            if not part.num_rows:
                continue
            keys = list(zip(*(part.column(names.index(b)).to_pylist() for b in batch)))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if held and at != keys[start]:
                        yield flush()
                        held = []
                    held.append(part.slice(start, i - start))
                    at, start = keys[i - 1], i
        if held:
            yield flush()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ordered.mapInArrow(run, f"{schema}, answer string")


def payload(entries: DataFrame, by: list[str]) -> DataFrame:
    """(*by, payload): the JSON that a batch sends: id, key, text, hint. Batches are bounded in rows and characters."""
    from ..functions.contexts import context_hint

    item = F.struct(F.concat_ws("\x1f", "file", "key").alias("id"), "key", text(F.col("source")).alias("source"), context_hint(text(F.col("context"))).alias("hint"))
    return entries.groupBy(*by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x.item)).alias("payload"))


def _loads(raw: str) -> object:
    """JSON of an answer: without a code fence, and with lone backslashes doubled where it can't be read otherwise."""
    body = raw.strip()
    if body.startswith("```"):
        body = body.removeprefix("```").removeprefix("json").rsplit("```", 1)[0].strip()
    try:
        return json.loads(body)
    except ValueError:
        return json.loads(re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", body))


def parse_names(raw: str, asked: set[str]) -> dict[str, str]:
    """Names and translations of an answer, an object or an array of pairs; {} where it can't be read.

    Only names that were asked for count. One that stays as it is counts unless it has signs of Chinese, Japanese or Korean: then it wasn't translated.
    """
    try:
        found = _loads(raw)
    except ValueError:
        return {}
    if isinstance(found, dict):
        pairs = list(found.items())
    else:
        items = [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []
        pairs = [(x.get("original") or x.get("source") or x.get("name"), x.get("translation") or x.get("target")) for x in items]
    good = {}
    for name, into in pairs:
        if isinstance(name, str) and isinstance(into, str) and name in asked and into.strip():
            same = into.strip() == name
            if not (same and re.search("[㐀-䶿一-鿿぀-ヿ가-힣]", name)):
                good[name] = into.strip()
    return good


def parse_segments(found: object) -> str:
    """Text of an answer that comes as a list of lists of segments, the text first in each."""
    head = found[0] if isinstance(found, list) and found else None
    return "".join(p[0] for p in head if isinstance(p, list) and p and isinstance(p[0], str)) if isinstance(head, list) else ""


def parse_answers(raw: str) -> tuple[list[dict], int]:
    """Items of an answer (objects with an id or key and a target) and the number of others; raises where the answer is no JSON array."""
    found = _loads(raw)
    if not isinstance(found, list):
        raise ValueError("the answer is no array")
    good = [x for x in found if isinstance(x, dict) and (x.get("id") or x.get("key")) and x.get("target") is not None]
    return good, len(found) - len(good)


def match_answers(batch: DataFrame, answers: DataFrame) -> DataFrame:
    """``batch`` (batch_no, file, key, source) with ``target``: the answer by id, else by key where the batch is of one file, else the source.

    ``answers`` (batch_no, id, key, target, n): of repeated ids the last counts.
    """
    ident = F.concat_ws("\x1f", "file", "key")
    one = batch.groupBy("batch_no").agg(F.count_distinct("file").alias("_files"))
    by_id = answers.where("id is not null").groupBy("batch_no", F.col("id").alias("_id")).agg(F.max_by("target", "n").alias("_by_id"))
    by_key = answers.where("key is not null").groupBy("batch_no", "key").agg(F.max_by("target", "n").alias("_by_key"))
    j = batch.withColumn("_id", ident).join(by_id, ["batch_no", "_id"], "left").join(by_key, ["batch_no", "key"], "left").join(one, "batch_no")
    return j.select(*batch.columns, F.coalesce("_by_id", F.when(F.col("_files") == 1, F.col("_by_key")), "source").alias("target"))
