"""Glossaries: loading, checking, deriving from results, rendering for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contexts import AUTO_GLOSSARY_CONTEXTS
from ..functions.text import CJK, CODE, NAMEBOX, blank, quoted, strip, text

HEADER = "## Glossary (use these EXACT translations for these terms; never substitute)\n"


def load_glossary(glossary: DataFrame, order: str = "line_no") -> DataFrame:
    """(term, translation, category, line_no), trimmed, without blank ones; the first of repeated terms holds."""
    t = glossary.select(strip(F.col("term")).alias("term"), strip(F.col("translation")).alias("translation"), strip(F.col("category")).alias("category"), F.col(order).alias("line_no"))
    t = t.where("term <> '' and translation <> ''")
    return t.groupBy("term").agg(F.min_by(F.struct("translation", "category", "line_no"), "line_no").alias("_r")).select("term", "_r.*")


def lint(glossary: DataFrame, order: str = "line_no") -> DataFrame:
    """(line_no, warning) for padded, blank, repeated and re-cased terms and control characters in translations.

    Letter case is compared by ``lower``, not full case folding (deviation D6).
    """
    raw, raw_t = text(F.col("term")), text(F.col("translation"))
    t = glossary.select(F.col(order).alias("line_no"), raw.alias("raw"), strip(raw).alias("term"), strip(raw_t).alias("translation"))
    t = t.where("term <> '' or translation <> ''").withColumn("good", F.expr("term <> '' and translation <> ''"))
    by_term = Window.partitionBy("term")
    first = F.min(F.when(F.col("good"), F.col("line_no"))).over(by_term)
    t = t.withColumn("first", first).withColumn("fold", F.lower("term"))
    lead = F.min(F.when(F.col("good"), F.struct("line_no", "term"))).over(Window.partitionBy("fold"))
    t = t.withColumn("lead", lead["term"])
    line = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "))
    named = F.concat(line, F.lit("term "), quoted(F.col("term")))
    is_first = F.col("first") == F.col("line_no")
    found = F.array(
        F.when(F.col("raw") != F.col("term"), F.concat(line, F.lit("term has leading/trailing whitespace ("), quoted(F.col("raw")), F.lit(")"))),
        F.when(F.col("term") == "", F.concat(line, F.lit("term is blank"))),
        F.when((F.col("term") != "") & (F.col("translation") == ""), F.concat(named, F.lit(" has blank translation"))),
        F.when(F.col("good") & F.col("translation").rlike(r"[\n\r\t]"), F.concat(named, F.lit(" translation contains control chars (will break prompt formatting)"))),
        F.when(F.col("good") & ~is_first, F.concat(line, F.lit("duplicate term "), quoted(F.col("term")), F.lit(" (first seen at line "), F.col("first").cast("string"), F.lit(", later rows ignored)"))),
        F.when(F.col("good") & is_first & (F.col("lead") != F.col("term")), F.concat(named, F.lit(" differs only in case from "), quoted(F.col("lead")), F.lit(" — only one will match"))))
    return t.select("line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("warning"))


def auto_glossary(results: DataFrame, most: int = 80, longest: int = 40, order: str = "ord") -> DataFrame:
    """(term, translation) of translated names and short lines, the first use of each term, the first ``most`` terms."""
    keep = ~blank(F.col("target")) & (text(F.col("target")) != text(F.col("source"))) & F.col("context").isin(AUTO_GLOSSARY_CONTEXTS) & F.length("source").between(1, longest)
    each = results.where(keep).groupBy(F.col("source").alias("term")).agg(F.min_by(strip(F.col("target")), order).alias("translation"), F.min(order).alias("_first"))
    return each.orderBy("_first").limit(most).select("term", "translation")


def speaker_glossary(results: DataFrame, order: str = "ord") -> DataFrame:
    """(term, translation): actors' names by the aliases that speakers' boxes show, else by the name itself.

    An alias counts for every actor whose name ends with it; instead of comparing all names with all aliases, each name is
    expanded to its endings, which meet the aliases in an equi-join.
    """
    translated = ~blank(F.col("target")) & (text(F.col("target")) != text(F.col("source")))
    actors = results.where(translated & (F.col("context") == "rpg_maker_actors_name")).groupBy("source").agg(
        F.max_by(strip(F.col("target")), order).alias("translation"), F.min(order).alias("first"))
    tag = F.regexp_extract(text(F.col("source")), r"<([^<>]{1,80})>", 1)
    aliases = results.where(F.col("context") == "rpg_maker_event_text").select(strip(tag).alias("alias")).where("alias <> ''").distinct()
    n = F.length("source")
    endings = actors.where("source <> ''").select("source", "translation", "first", F.explode(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(80))), lambda k: F.right(F.col("source"), k))).alias("alias"))
    hits = endings.join(aliases, "alias")
    own = actors.join(hits.select("source").distinct(), "source", "left_anti").where("source <> ''").select(F.col("source").alias("alias"), "source", "translation", "first")
    every = hits.select("alias", "source", "translation", "first").unionByName(own)
    return every.groupBy(F.col("alias").alias("term")).agg(F.min_by("translation", F.struct("first", "source")).alias("translation"))


def prompt(glossary: DataFrame, max_chars: int = 4000) -> DataFrame:
    """One row (prompt): the glossary's lines in order as far as they fit, and a note on the rest; '' for an empty one.

    A prompt is one small text: the lines are gathered in one task, at most the glossary itself.
    """
    line = F.concat(F.lit('- "'), F.col("term"), F.lit('" -> "'), F.col("translation"), F.lit('"\n'))
    one = Window.partitionBy(F.lit(0))
    t = glossary.select("line_no", line.alias("line")).withColumn("used", F.sum(F.length("line")).over(one.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") + len(HEADER) <= max_chars
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("line_no", "line")))), lambda x: x.line), "")
    left = F.count_if(~fits)
    note = F.when(left > 0, F.concat(F.lit("(..."), left.cast("string"), F.lit(" more terms omitted to keep prompt short)\n"))).otherwise("")
    return t.agg(F.when(F.count(F.lit(1)) == 0, "").otherwise(F.concat(F.lit(HEADER), body, note)).alias("prompt"))


def prompt_by_category(glossary: DataFrame, max_chars: int = 4000) -> DataFrame:
    """One row (prompt): terms without category first, then a section for each category in order of its name, as far as they fit."""
    line = F.concat(F.lit('- "'), F.col("term"), F.lit('" -> "'), F.col("translation"), F.lit('"\n'))
    terms = glossary.select("category", F.lit(1).alias("kind"), "line_no", line.alias("line"))
    heads = glossary.where("category <> ''").select("category").distinct().select("category", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("### "), F.col("category"), F.lit("\n")).alias("line"))
    one = Window.partitionBy(F.lit(0)).orderBy("category", "kind", "line_no")
    t = terms.unionByName(heads).withColumn("used", F.sum(F.length("line")).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") + len(HEADER) <= max_chars
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("category", "kind", "line_no", "line")))), lambda x: x.line), "")
    note = F.when(F.count_if(~fits) > 0, "(...more terms omitted to keep prompt short)\n").otherwise("")
    return t.agg(F.when(F.count(F.lit(1)) == 0, "").otherwise(F.concat(F.lit(HEADER), body, note)).alias("prompt"))


def namebox_names(entries: DataFrame, order: str = "ord") -> DataFrame:
    """(name, content): names in boxes with signs of Chinese, Japanese or Korean, and the box's content where each was first met."""
    content = F.regexp_extract(text(F.col("source")), NAMEBOX, 2)
    name = strip(F.regexp_replace(content, CODE, ""))
    return (entries.select(name.alias("name"), content.alias("content"), F.col(order).alias("_o")).where((F.col("name") != "") & F.col("name").rlike(CJK))
            .groupBy("name").agg(F.min_by("content", "_o").alias("content")))
