"""Relational steps of a translation run: resume, memory, grouping, fan-out, comparison, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contexts import NAME_CONTEXTS, context_hint, dedup_category
from ..functions.text import blank, has_cjk, needs_retry, quoted, strip, text, warnings

ID = ["file", "key"]


# --- identity ---------------------------------------------------------------------------------------------------------

def loaded(df: DataFrame) -> DataFrame:
    """Rows with a file and a key, null texts as '' and null sub_keys as an empty array."""
    out = df.where(~blank(F.col("file")) & ~blank(F.col("key")))
    for c, kind in df.dtypes:
        if kind == "string":
            out = out.withColumn(c, text(F.col(c)))
    if "sub_keys" in df.columns:
        out = out.withColumn("sub_keys", F.coalesce("sub_keys", F.array().cast("array<string>")))
    return out


def dedupe_last(df: DataFrame, order: str = "ord", keys: list[str] = ID) -> DataFrame:
    """One row per (file, key), or other ``keys``: the values of the last row, ``first_ord`` the place of the first.

    One aggregation with map-side combine; null keys are keys of their own, rows that tie on ``order`` are decided by their values.
    """
    rest = [c for c in df.columns if c not in keys]
    comparable = [c for c, kind in df.dtypes if c in rest and not kind.startswith("map")]
    best = F.max_by(F.struct(*rest), F.struct(order, *[c for c in comparable if c != order]))
    return df.groupBy(*keys).agg(best.alias("_r"), F.min(order).alias("first_ord")).select(*keys, "_r.*", "first_ord")


def pending(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Entries without a result whose target is not blank (a target equal to its source counts as done)."""
    return entries.join(results.where(~blank(F.col("target"))).select(*ID).distinct(), ID, "left_anti")


def wanted(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Results of entries that exist."""
    return results.join(entries.select(*ID).distinct(), ID, "left_semi")


# --- memory -----------------------------------------------------------------------------------------------------------

MEMORY_KEY = ["context", "source"]


def effective_memory(memory: DataFrame, target_lang: str, source_lang: str | None = None, order: list[str] | None = None) -> DataFrame:
    """(context, source, target) that hold for a language: no blank texts, no other target language, source language unknown, ``auto`` or the one wanted.

    The last row by ``order`` wins (ties: the larger target). The caller unites several memories with their precedence as the first order column.
    """
    order = order or ["updated_at"]
    own = F.lower(strip(F.col("target_lang")))
    source = F.lower(strip(F.col("source_lang")))
    keep = ~blank(F.col("source")) & ~blank(F.col("target")) & ((own == "") | (own == target_lang.lower()))
    if source_lang and source_lang.lower() != "auto":
        keep = keep & source.isin("", "auto", source_lang.lower())
    return (memory.where(keep).select(text(F.col("context")).alias("context"), "source", "target", F.struct(*order, "target").alias("_o"))
            .groupBy(*MEMORY_KEY).agg(F.max_by("target", "_o").alias("target")))


def lookup_memory(entries: DataFrame, memory: DataFrame) -> DataFrame:
    """``entries`` with ``remembered``: the memory's target for the entry's context, else for no context, else null.

    Two left joins with unique keys on the right: the first on context and source, the second on the source alone. A source with a third of the entries
    is split by the adaptive skew join; the memory's rows are never gathered.
    """
    exact = memory.select(F.col("context").alias("_c"), F.col("source").alias("_s"), F.col("target").alias("_exact"))
    general = memory.where("context = ''").select(F.col("source").alias("_g"), F.col("target").alias("_general"))
    found = entries.join(exact, (text(F.col("context")) == F.col("_c")) & (F.col("source") == F.col("_s")), "left").join(general, F.col("source") == F.col("_g"), "left")
    return found.select(*[entries[c] for c in entries.columns], F.coalesce("_exact", "_general").alias("remembered"))


def upsert_memory(memory: DataFrame, results: DataFrame, target_lang: str, source_lang: str = "auto", provider: str = "", now: Column | None = None) -> DataFrame:
    """The memory with results added: the newest row per (source, context, languages) stays. Blank and untranslated results are not kept."""
    columns = ["source", "target", "source_lang", "target_lang", "provider", "context", "updated_at"]
    fresh = results.where(~blank(F.col("target")) & (F.col("target") != text(F.col("source")))).select(
        "source", "target", F.lit(source_lang.lower() or "auto").alias("source_lang"), F.lit(target_lang.lower()).alias("target_lang"), F.lit(provider).alias("provider"),
        text(F.col("context")).alias("context"), (now if now is not None else F.current_timestamp()).alias("updated_at"))
    both = memory.select(*columns, F.lit(0).alias("_b")).unionByName(fresh.withColumn("_b", F.lit(1)))
    both = both.where(~blank(F.col("source")) & ~blank(F.col("target_lang")))
    source = F.when(blank(F.col("source_lang")), "auto").otherwise(F.lower("source_lang"))
    best = F.max_by(F.struct(*columns), F.struct("_b", "updated_at", "target"))
    return both.groupBy("source", text(F.col("context")).alias("_c"), F.lower("target_lang").alias("_t"), source.alias("_s")).agg(best.alias("_r")).select("_r.*")


# --- grouping ---------------------------------------------------------------------------------------------------------

def source_groups(entries: DataFrame, order: str = "ord") -> DataFrame:
    """(source, category, first_ord, members): entries that share one translation; the first one stands for all."""
    category = dedup_category(F.col("context"))
    return entries.groupBy("source", category.alias("category")).agg(F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("members"))


def representatives(entries: DataFrame, order: str = "ord") -> DataFrame:
    """The first entry of each group, with its ``category``."""
    rest = [c for c in entries.columns if c != "source"]
    e = entries.withColumn("category", dedup_category(F.col("context")))
    return e.groupBy("source", "category").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("source", "category", "_r.*")


def fan_out(entries: DataFrame, translated: DataFrame) -> DataFrame:
    """Every entry with the target of its group. ``translated`` (source, category, target) has one row per group; a hot source is split by AQE."""
    e = entries.withColumn("category", dedup_category(F.col("context")))
    return e.join(translated.select("source", "category", "target"), ["source", "category"])


# --- comparison -------------------------------------------------------------------------------------------------------

def diff(old: DataFrame, new: DataFrame, results: DataFrame, keys: list[str] = ID) -> DataFrame:
    """(file, key, source, target, status) for new texts against old texts and their translations.

    ``unchanged``: same source and a translation that is not blank; ``changed``: another source (the old target in the status); ``new``: otherwise; ``removed``: translated
    before and no longer there. All three inputs have one row per (file, key), or other ``keys``.
    """
    n = new.select(*keys, text(F.col("source")).alias("source"))
    if results is old:  # the old texts carry their translations: one join does for all
        o = old.select(*keys, text(F.col("source")).alias("old_source"), text(F.col("target")).alias("old_target"))
        joined = n.join(o, keys, "full")
    else:
        o = old.select(*keys, text(F.col("source")).alias("old_source"))
        t = results.select(*keys, text(F.col("target")).alias("old_target"), text(F.col("source")).alias("translated_source"))
        joined = n.join(o, keys, "left").join(t, keys, "left")
    same = F.col("old_source").isNotNull() & (F.col("old_source") == F.col("source"))
    old_target = text(F.col("old_target"))
    status = (F.when(F.col("source").isNull(), "removed").when(same & ~blank(old_target), "unchanged")
              .when(F.col("old_source").isNotNull() & ~same, F.when(~blank(old_target), F.concat(F.lit("changed (was: "), F.substring(old_target, 1, 80), F.lit(")"))).otherwise("changed"))
              .otherwise("new"))
    gone = F.col("source").isNull()
    out = joined.select(*keys, F.coalesce("source", "old_source").alias("source"), F.when(same | gone, old_target).otherwise("").alias("target"), status.alias("status"))
    if results is old:
        return out
    left = t.join(n.select(*keys), keys, "left_anti").select(*keys, F.col("translated_source").alias("source"), F.col("old_target").alias("target"), F.lit("removed").alias("status"))
    return out.unionByName(left)


# --- filters and reviews ----------------------------------------------------------------------------------------------

def retry_filter(results: DataFrame, which: str) -> DataFrame:
    """Rows to translate again: ``fallback``, ``empty``, ``cjk-leak``, ``needs-retry``, ``all`` or ``context=NAME``."""
    s, t = text(F.col("source")), text(F.col("target"))
    tests = {"fallback": (t == s) & ~blank(s), "empty": blank(t), "cjk-leak": has_cjk(t), "needs-retry": needs_retry(s, t), "all": F.lit(True)}
    if which.startswith("context="):
        return results.where(text(F.col("context")) == which[8:])
    if which not in tests:
        raise ValueError(f"unknown filter {which!r}")
    return results.where(tests[which])


def cleared(results: DataFrame, which: str) -> DataFrame:
    """The results with the chosen targets blanked, so that a run translates them again."""
    hit = retry_filter(results, which).select(*ID).distinct().withColumn("_hit", F.lit(True))
    return results.join(hit, ID, "left").withColumn("target", F.when(F.col("_hit"), "").otherwise(F.col("target"))).drop("_hit")


def editor_filter(results: DataFrame, which: str, search: str = "") -> DataFrame:
    """Rows of the review table: ``all``, ``fallback`` (trimmed comparison), ``cjk_leak``, ``needs_retry``, ``translated``; and a search without case."""
    s, t = strip(F.col("source")), strip(F.col("target"))
    tests = {"all": F.lit(True), "fallback": (s == t) & (s != ""), "cjk_leak": has_cjk(t), "needs_retry": needs_retry(F.col("source"), F.col("target")), "translated": (t != "") & (s != t)}
    keep = tests[which]
    if search:
        keep = keep & F.contains(F.lower(F.concat_ws("\n", text(F.col("source")), text(F.col("target")), text(F.col("key")))), F.lit(search.lower()))
    return results.where(keep)


def preview_filter(results: DataFrame, status: str | None = None, hint: str | None = None, search: str = "") -> DataFrame:
    """Rows of the preview by status (``done``, ``warn``, ``fallback``), kind of text and a search over source, target, key and file."""
    out = with_status(results)
    if status:
        out = out.where(F.col("status") == status)
    if hint:
        out = out.where(context_hint(text(F.col("context"))) == hint)
    if search:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", *[text(F.col(c)) for c in ("source", "target", "key", "file")])), F.lit(search.lower())))
    return out


def with_status(results: DataFrame) -> DataFrame:
    """The results with ``warnings`` and ``status``: fallback, warn or done."""
    s, t = text(F.col("source")), text(F.col("target"))
    w = warnings(s, t, text(F.col("context")))
    return results.withColumn("warnings", w).withColumn("status", F.when(blank(t) | (t == s), "fallback").when(F.size("warnings") > 0, "warn").otherwise("done"))


def merge_batch(review: DataFrame, batch: DataFrame) -> DataFrame:
    """The review rows with a batch's targets; rows edited by hand keep theirs."""
    b = batch.groupBy(*ID).agg(F.max("target").alias("_new"))
    return review.join(b, ID, "left").withColumn("target", F.when(F.col("_new").isNotNull() & ~F.coalesce("manually_edited", F.lit(False)), F.col("_new")).otherwise(F.col("target"))).drop("_new")


def next_warning(results: DataFrame, order: str = "ord", block: int = 100_000) -> DataFrame:
    """(file, ord, next): for every row the place of the next row of its file that has a warning, from the start again after the last; null without any.

    A file may hold any share of the rows: it is cut into blocks of ``block`` places. Only the first warning of each block goes on to the blocks before it, so that no task sees more
    than one block of rows, or one row per block of a file.
    """
    w = with_status(results).select("file", order, F.floor(F.col(order) / block).cast("bigint").alias("_k"), F.when(F.col("status") == "warn", F.col(order)).alias("_w"))
    ahead = F.min("_w").over(Window.partitionBy("file", "_k").orderBy(order).rowsBetween(1, Window.unboundedFollowing))
    first = w.groupBy("file", "_k").agg(F.min("_w").alias("_w"))
    by = Window.partitionBy("file")
    later = F.min("_w").over(by.orderBy("_k").rowsBetween(1, Window.unboundedFollowing))
    first = first.select(F.col("file").alias("_f"), F.col("_k").alias("_b"), F.coalesce(later, F.min("_w").over(by)).alias("_later"))
    inside = w.select("file", order, "_k", ahead.alias("_ahead"))
    return inside.join(first, F.col("file").eqNullSafe(F.col("_f")) & (F.col("_k") == F.col("_b"))).select("file", order, F.coalesce("_ahead", "_later").alias("next"))


# --- reports ----------------------------------------------------------------------------------------------------------

def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(0.0)


def validation_report(results: DataFrame) -> DataFrame:
    """One row: rows, empty and untranslated ones, the share of the latter, rows with warnings."""
    s, t = text(F.col("source")), text(F.col("target"))
    w = F.size(warnings(s, t, text(F.col("context")))) > 0
    n = F.count(F.lit(1))
    fallback = F.count_if((t == s) & ~blank(t))
    return results.agg(n.alias("total"), F.count_if(blank(t)).alias("empty"), fallback.alias("fallback"), _share(fallback, n).alias("fallback_pct"), F.count_if(w).alias("warned"))


def warning_counts(results: DataFrame) -> DataFrame:
    """(warning, rows): how often each kind occurs; details in brackets are left out."""
    w = F.explode(warnings(text(F.col("source")), text(F.col("target")), text(F.col("context"))))
    return results.select(w.alias("w")).select(strip(F.substring_index("w", "(", 1)).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("rows"))


def translate_report(results: DataFrame) -> DataFrame:
    s, t = text(F.col("source")), text(F.col("target"))
    ok = ~blank(t) & (t != s)
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("translated"), F.count_if(~ok).alias("fallback"))


def preflight(entries: DataFrame, results: DataFrame) -> DataFrame:
    """How many entries are done, fell back to their source, or are to do; the last result of an entry counts."""
    last = dedupe_last(results.select(*ID, "target", "ord")).select(*ID, "target")
    j = entries.select(*ID, "source").join(last, ID, "left")
    s, t = text(F.col("source")), text(F.col("target"))
    return j.agg(F.count_if(~blank(t) & (t != s)).alias("done"), F.count_if(~blank(t) & (t == s)).alias("fallback"), F.count_if(blank(t)).alias("todo"))


def noun_inconsistency(results: DataFrame, order: str = "ord") -> DataFrame:
    """(source, targets, variants) of names translated in two or more ways; targets in order of their first use."""
    s, t = strip(F.col("source")), strip(F.col("target"))
    names = results.where((t != "") & (text(F.col("target")) != text(F.col("source"))) & F.col("context").isin(NAME_CONTEXTS) & (s != "") & (F.length(s) <= 80))
    each = names.groupBy(s.alias("source"), t.alias("target")).agg(F.min(order).alias("first"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "target"))), lambda x: x.target), " | ")
    return each.groupBy("source").agg(listed.alias("targets"), F.count(F.lit(1)).alias("variants")).where("variants >= 2")


def noun_messages(results: DataFrame, most: int = 30) -> DataFrame:
    """(n, message): the first ``most`` inconsistencies by source, and a line for the rest."""
    nouns = noun_inconsistency(results)
    top = nouns.orderBy("source").limit(most)
    numbered = top.select(F.posexplode(F.array(F.struct("source", "targets"))).alias("p", "x"), "source", "targets")
    lines = numbered.select("source", F.concat(F.lit("Noun inconsistency: '"), F.col("source"), F.lit("' translated as: ["), F.col("targets"), F.lit("]")).alias("message"))
    rest = nouns.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit(None).cast("string").alias("source"), F.concat(F.lit("...and "), (F.col("n") - most).cast("string"), F.lit(" more noun inconsistencies")).alias("message"))
    return lines.unionByName(rest)


def scan_contexts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("context").agg(F.count(F.lit(1)).alias("entries"))


def top_files(entries: DataFrame, most: int = 10, order: str = "ord") -> DataFrame:
    """The files with most entries; of equal ones the first met."""
    return entries.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.min(order).alias("first_ord")).orderBy(F.desc("entries"), "first_ord").limit(most)


def missing_token_rows(results: DataFrame) -> DataFrame:
    from ..functions.text import missing_codes

    missing = missing_codes(F.col("source"), F.col("target"))
    return results.select("ord", F.array_join(F.transform(missing, quoted), ",").alias("missing")).where("missing <> ''")
