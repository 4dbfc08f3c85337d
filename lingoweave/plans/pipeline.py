"""A translation run: resume, memory, grouping, batches, provider, repair, fan-out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contexts import context_hint
from ..functions.text import blank, box_name, corrected, mask, postprocess, repair_syntax, replace_box_name, text, unmask
from ..operators.batching import char_batches
from ..operators.glossary import auto_glossary, load_glossary, namebox_names, prompt, prompt_by_category
from ..operators.results import dedupe_last, effective_memory, fan_out, lookup_memory, pending, representatives, wanted
from ..runtime import store
from .provider import translate_batches


@dataclass
class Options:
    target_lang: str
    source_lang: str = "auto"
    provider: str = "upper"
    batch_size: int = 30
    max_chars: int = 12_000
    restart: bool = False
    corrections: list[tuple[str, str]] = field(default_factory=list)
    wait: float = 5.0
    auto_glossary: bool = False


def finish(rows: DataFrame, corrections: list[tuple[str, str]], names: DataFrame | None = None) -> DataFrame:
    """Answers made into targets: tokens put back, corrections, repairs of codes and name boxes. A missing answer falls back to the source.

    One path for all rows, also for those that were tried again (deviation D3).
    """
    raw = F.when(F.col("answer").isNull(), F.col("source")).otherwise(unmask(F.col("answer"), F.col("tokens")))
    out = rows.withColumn("target", corrected(raw, corrections))
    out = out.withColumn("target", postprocess(F.col("source"), F.col("target")))
    if names is not None:
        out = out.withColumn("_name", box_name(F.col("source"))).join(names.select(F.col("original").alias("_name"), F.col("translation").alias("_t")), "_name", "left")
        out = out.withColumn("target", replace_box_name(F.col("source"), F.col("target"), F.col("_t"))).drop("_name", "_t")
    return out.withColumn("target", repair_syntax(F.col("source"), F.col("target")))


def translate_names(entries: DataFrame, options: Options, known: DataFrame | None = None, glossary: str = "") -> DataFrame:
    """(original, translation) of the names in boxes: each is asked for once, before anything else; names that are ``known`` (original, translation) are not asked for again.

    A name that the provider leaves as it is wasn't translated and is left out.
    """
    names = namebox_names(entries).select(F.col("name").alias("masked"))
    if known is not None:
        names = names.join(known.select(F.col("original").alias("masked")), "masked", "left_anti")
    numbered = names.withColumn("batch_no", F.pmod(F.xxhash64("masked"), F.lit(1 << 20)))
    made = store(translate_batches(numbered, options.provider, options.target_lang, options.source_lang, ["batch_no"], options.wait, glossary), "names")
    made = made.where(~blank(F.col("answer")) & (F.col("answer") != F.col("masked"))).select(F.col("masked").alias("original"), F.trim("answer").alias("translation"))
    return made if known is None else made.unionByName(known.select("original", "translation"))


def glossary_block(terms: DataFrame | None, results: DataFrame | None = None) -> str:
    """The glossary of a run as the provider is given it, at most 4,000 characters: the given terms, and those that earlier ``results`` show. Taken once for the whole run (deviation D5)."""
    parts = [load_glossary(terms)] if terms is not None else []
    if results is not None:
        found = auto_glossary(results)
        if parts:
            found = found.join(parts[0].select("term"), "term", "left_anti")
        parts.append(found.select("term", "translation", F.lit("").alias("category"), (F.monotonically_increasing_id() + (1 << 40)).alias("line_no")))
    if not parts:
        return ""
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    by_category = every.where("category <> ''").limit(1).count()
    return (prompt_by_category if by_category else prompt)(every).first().prompt


def run(entries: DataFrame, options: Options, results: DataFrame | None = None, memory: DataFrame | None = None, names: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """(file, key, source, target, context, sub_keys, extra, origin) of every entry: ``done`` before, from ``memory``, or ``provider``.

    Plan order is the order of cost: what is done and what is remembered never reaches the provider, of equal texts of one kind one is sent. Names in boxes are asked for first, unless
    ``names`` (original, translation) gives them; the provider sees the ``glossary`` (term, translation, category, line_no) and, with ``auto_glossary``, the terms of earlier results. Its answers are written once
    before anything reads them. ``extra`` of earlier results stays.
    """
    keep = ["file", "key", "source", "target", "context", "sub_keys", "extra", "origin"]
    none = F.create_map().cast("map<string,string>").alias("extra")
    e = dedupe_last(entries.select("file", "key", text(F.col("source")).alias("source"), text(F.col("context")).alias("context"), text(F.col("context_text")).alias("context_text"), "sub_keys", "ord"))
    todo, parts = e, []
    block = glossary_block(glossary, results if options.auto_glossary and results is not None and not options.restart else None)
    if results is not None and not options.restart:
        kept = F.coalesce("extra", none) if "extra" in results.columns else none
        old = dedupe_last(wanted(results, e).select("file", "key", "target", kept.alias("extra"), "ord"))
        done = e.join(old.where(~blank(F.col("target"))).select("file", "key", "target", "extra"), ["file", "key"])
        parts.append(done.withColumn("origin", F.lit("done")).select(keep))
        todo = pending(e, old)
    if memory is not None:
        found = lookup_memory(todo, effective_memory(memory, options.target_lang, options.source_lang))
        parts.append(found.where("remembered is not null").withColumn("target", F.col("remembered")).withColumn("origin", F.lit("memory")).withColumn("extra", none).select(keep))
        todo = found.where("remembered is null").drop("remembered")
    todo = store(todo, "todo")
    first = representatives(todo)
    if names is None:
        names = translate_names(first, options, glossary=block)
    numbered = char_batches(first.select("file", "ord", "source", "context_text"), options.batch_size, options.max_chars)
    masked = first.join(numbered.select("ord", "block", "batch_no"), "ord").withColumn("_m", mask(F.col("source")))
    asked = masked.select("file", "key", "block", "batch_no", context_hint(F.col("context")).alias("hint"), "source", "category", F.col("_m.masked").alias("masked"), F.col("_m.tokens").alias("tokens"))
    answers = store(translate_batches(asked, options.provider, options.target_lang, options.source_lang, wait=options.wait, glossary=block), "answers")
    # what failed is tried once more, each text by itself
    failed = answers.where("answer is null").drop("answer")
    if failed.limit(1).count():
        again = store(translate_batches(failed, options.provider, options.target_lang, options.source_lang, ["file", "block", "batch_no", "source", "category"], options.wait, block), "again")
        answers = answers.where("answer is not null").unionByName(again)
    made = fan_out(todo, finish(answers, options.corrections, names)).withColumn("origin", F.lit("provider")).withColumn("extra", none).select(keep)
    for p in parts:
        made = made.unionByName(p)
    return made
