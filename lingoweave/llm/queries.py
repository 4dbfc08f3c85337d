"""Queries on training text and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .copies import entry_copies
from .cuts import cut_documents, cuts_by_source, train_cut_model
from .encoding import both_texts, garbled_texts, train_encoding_model
from .labels import text_languages, train_label_models, wrong_labels
from .leaks import leaked_items, unbroken_passages
from .mixing import Mixture
from .packing import fill_requests, fill_summary
from .pairs import defective_pairs, train_pair_model


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "results")
    return defective_pairs(results, train_pair_model(results)).where("defect <> 'near_copied'").distinct()


def p2_near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Targets that are their source but for a few letters."""
    results = table(spark, d, "results")
    return defective_pairs(results, train_pair_model(results)).where("defect = 'near_copied'").select("ord")


def _languages(spark: SparkSession, d: str, within: float | None = None) -> DataFrame:
    results = table(spark, d, "results")
    return text_languages(results, *train_label_models(results), within)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(_languages(spark, d)).distinct()


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of words in one language, also inside sentences, with its confidence."""
    return _languages(spark, d, 12.0).select("ord", "segment_no", "lang", F.round("confidence", 4).alias("confidence"), "start", "length", "labelled")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return entry_copies(table(spark, d, "entries")).members.where("ord <> first_ord").select("first_ord", F.col("ord").alias("copy_ord"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return entry_copies(table(spark, d, "entries")).records


def p5_requests(spark: SparkSession, d: str) -> DataFrame:
    return fill_requests(table(spark, d, "entries"), table(spark, d, "batch_limits"))


def p5_assigned(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every entry and provider: its characters are in requests, once and in so many parts, none of them too full."""
    requests, limits = p5_requests(spark, d), table(spark, d, "batch_limits")
    full = requests.groupBy("provider", "request_no").agg(F.sum("chars").alias("used")).join(F.broadcast(limits), "provider")
    over = full.where("used > max_chars").groupBy("provider").agg(F.count(F.lit(1)).alias("over"))
    each = requests.groupBy("provider", "ord").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("parts"))
    return each.join(F.broadcast(over), "provider", "left").select("provider", "ord", "chars", "parts", F.coalesce("over", F.lit(0).cast("bigint")).alias("over_full"))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_summary(p5_requests(spark, d), table(spark, d, "batch_limits"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    texts = both_texts(table(spark, d, "entries"), table(spark, d, "results"))
    return garbled_texts(texts, train_encoding_model(texts))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("table_name", "ord").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("table_name", "ord", "text", "restored", "complete", "chain")


def _unbroken(spark: SparkSession, d: str) -> DataFrame:
    """Passages as the case is stated: 40 % of the item whatever its length, in one piece."""
    return unbroken_passages(leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), shortest=1))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _unbroken(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item that leaked, with its documents and the letters of the longest stretch."""
    return _unbroken(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("unbroken").alias("longest"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages with up to two edits."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=2).select("doc_id", "item_id", "matched", "item_length", "unbroken")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).chosen


def p9_caps(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every source that is used: no document oftener than the source may be repeated, and none in two rows."""
    targets = table(spark, d, "mix_targets")
    each = Mixture(table(spark, d, "documents"), targets).chosen.join(F.broadcast(targets.select("source", "max_repeats")), "source")
    return each.groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("doubled"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return cut_documents(documents, train_cut_model(documents))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).select("doc_id").distinct()


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return cuts_by_source(table(spark, d, "documents"), _cuts(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_near_copies, p3_found, p3_segments, p4_found, p4_records, p5_requests, p5_assigned, p5_fill, p7_found, p7_restored, p8_found, p8_items, p8_near, p9_mixture, p9_caps, p9_shares, p10_found, p10_sources)}


_CANONICAL = r"""
with e as (
  select ord, regexp_replace(lower(replace(upper(source), 'ẞ', 'SS')), '[^\p{L}\p{N}]+', '', 'g') as t,
         list_sort(list_filter(list_transform(string_split_regex(context, '[|;,/]'), lambda x: regexp_replace(lower(replace(upper(x), 'ẞ', 'SS')), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')) as f
  from entries),
g as (select ord, min(ord) over (partition by t, f) as first_ord, count(*) over (partition by t, f) as copies from e where t <> '' and len(f) > 0)
"""


#: stretches of an item with the letters that are needed meet the documents by their first 16 letters, then in full
_LEAKS = r"""
with d as (select doc_id, regexp_replace(lower(replace(upper(text), 'ẞ', 'SS')), '[^\p{L}\p{N}]+', '', 'g') as t from documents),
i0 as (select item_id, regexp_replace(lower(replace(upper(text), 'ẞ', 'SS')), '[^\p{L}\p{N}]+', '', 'g') as t from eval_items),
i as (select item_id, t, length(t) as n, greatest(1, cast(ceil(0.4 * length(t) - 1e-9) as bigint)) as need from i0 where t <> ''),
w as (select item_id, n, substr(t, p, need) as s, substr(t, p, least(16, need)) as g from (select *, unnest(range(1, n - need + 2)) as p from i)),
l as (select distinct length(g) as k from w),
a as (select distinct doc_id, t, substr(t, p, k) as g from (select doc_id, t, k, unnest(range(1, length(t) - k + 2)) as p from d, l)),
h as (select distinct doc_id, item_id from a join w using (g) where contains(a.t, w.s))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_assigned": """with l as (select provider, min(max_chars) as m from batch_limits where max_chars >= 1 group by 1), e as (select ord, length(coalesce(source, '')) + length(coalesce(context_text, '')) as chars from entries)
select provider, ord, chars, greatest(1, cast(ceil(chars / m) as bigint)) as parts, cast(0 as bigint) as over_full from e, l""",
        "p9_caps": "select source, cast(0 as bigint) as over_cap, cast(0 as bigint) as doubled from mix_targets where weight > 0 and max_repeats > 0 and source in (select source from documents where text <> '')",
        "p8_items": _LEAKS + """, r as (select h.doc_id, h.item_id, max(x.k) as longest from h join i using (item_id) join d using (doc_id), lateral (select unnest(range(i.need, i.n + 1)) as k) x
where list_bool_or(list_transform(range(1, i.n - x.k + 2), lambda p: contains(d.t, substr(i.t, p, x.k)))) group by all) select item_id, count(distinct doc_id) as documents, max(longest) as longest from r group by 1""",
        "p8_found": _LEAKS + "select doc_id, item_id from h",
        "p4_found": _CANONICAL + "select first_ord, ord as copy_ord from g where ord <> first_ord",
        "p4_records": _CANONICAL + "select first_ord, copies from g where ord = first_ord",
    }
