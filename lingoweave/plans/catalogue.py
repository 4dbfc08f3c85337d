"""Registered queries of the core and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contexts as C
from ..functions import text as X
from ..operators import batching, glossary, results
from ..operators.nested import flatten_json, latest_readable
from ..operators.snapshots import snapshot_changes
from ..runtime import shared_dir, table
from ..sources import games, json_tree, text_pairs
from ..streaming.memory_stream import compacted, stream_memory
from . import lens, pipeline, provider
from .lens import ENTRIES, RESULTS, quote_list, strip_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- what changed, nested records -------------------------------------------------------------------------------------

@query("""
with s as (select snapshot_no, file, key, arg_max(coalesce(source, ''), ord) as source, arg_max(coalesce(target, ''), ord) as target from text_snapshots group by all),
o as (select snapshot_no as b, lead(snapshot_no) over (order by t, snapshot_no) as a from (select snapshot_no, min(taken_at) as t from text_snapshots group by 1)),
new as (select s.* from s join o on o.a = s.snapshot_no),
old as (select o.a as snapshot_no, file, key, source, target from s join o on o.b = s.snapshot_no where o.a is not null)
select coalesce(new.snapshot_no, old.snapshot_no) as snapshot_no, coalesce(new.file, old.file) as file, coalesce(new.key, old.key) as key,
       case when old.snapshot_no is null then 'added' when new.snapshot_no is null then 'removed' else 'changed' end as change
from new full join old on new.snapshot_no = old.snapshot_no and new.file is not distinct from old.file and new.key is not distinct from old.key
where old.snapshot_no is null or new.snapshot_no is null or new.source <> old.source or new.target <> old.target""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "text_snapshots"), ["file", "key"], ["source", "target"])


#: every value of the latest readable body of each file, with its path in two spellings, the nearest enclosing object and the names on the way down
READABLE = r"d0 as (select file, body, loaded_at, delivery_no, regexp_replace(coalesce(body, ''), '^[ \t\r\n]*\x{feff}?[ \t\r\n]*|[ \t\r\n]+$', '', 'g') as b from game_files)"
TREE = f"""{READABLE}, d1 as (select coalesce(file, chr(0)) as file, arg_max(b, {{'a': loaded_at, 'b': delivery_no}}) as b from d0 where json_valid(b) group by 1), t as (select d1.file, x.* from d1, json_tree(d1.b) x),
v as (select file, id, type, atom, '' as name, '' as holder, '$' as path, '$' as plain, '$' as up, [] :: varchar[] as keys, 0 as depth from t where parent is null
union all select t.file, t.id, t.type, t.atom, case when v.type = 'OBJECT' then t.key else '' end, v.name,
concat(v.path, case when v.type = 'ARRAY' then concat('[', t.key, ']') when regexp_full_match(t.key, '[A-Za-z0-9_]+') then concat('.', t.key) else concat('[', chr(39), t.key, chr(39), ']') end),
concat(v.plain, case when v.type = 'ARRAY' then concat('[', t.key, ']') else concat('.', t.key) end), case when v.type = 'OBJECT' then v.path else v.up end,
case when v.type = 'OBJECT' then list_append(v.keys, t.key) else v.keys end, v.depth + 1 from v join t on t.file = v.file and t.parent = v.id),
w as (select * replace (nullif(file, chr(0)) as file), atom ->> '$' as text from v),
n as (select file, up as parent_path, path, case type when 'OBJECT' then 'object' else 'text' end as kind, case when type <> 'OBJECT' then text end as value, depth, plain, name, holder, keys
from w where type = 'OBJECT' and depth > 0 or type = 'VARCHAR' and {strip_sql('text')} <> '')"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten_json(latest_readable(table(spark, d, "game_files")), "body", ["file"])


@query(f"with recursive {TREE} select file, parent_path, path, kind from n")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("file", "parent_path", "path", "kind")


@query(f"with recursive {TREE} select file, path, parent_path, cast(depth as int) as depth from n where kind = 'object'")
def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    """The parent table: one row per object."""
    return _nodes(spark, d).where("kind = 'object'").select("file", "path", "parent_path", "depth")


@query(f"with recursive {TREE} select file, parent_path, path, value from n where kind = 'text'")
def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The child table: one row per text, linked to its object."""
    return _nodes(spark, d).where("kind = 'text'").select("file", "parent_path", "path", "value")


# --- stores, identity, resume -----------------------------------------------------------------------------------------

@query(f"""select file, key, coalesce(source, '') as source, coalesce(context, '') as context, coalesce(context_text, '') as context_text,
array_to_string(coalesce(sub_keys, []), chr(31)) as sub_keys, ord from entries where {strip_sql('file')} <> '' and {strip_sql('key')} <> '' and {strip_sql('source')} <> ''""")
def entries_nonblank(spark: SparkSession, d: str) -> DataFrame:
    e = results.loaded(table(spark, d, "entries")).where(~X.blank(F.col("source")))
    return e.select("file", "key", "source", "context", "context_text", F.array_join("sub_keys", "\x1f").alias("sub_keys"), "ord")


@query(f"""select file, key, coalesce(source, '') as source, coalesce(target, '') as target, coalesce(context, '') as context, array_to_string(coalesce(sub_keys, []), chr(31)) as sub_keys,
coalesce(cast(len(map_keys(extra)) as bigint), 0) as extras, ord from results where {strip_sql('file')} <> '' and {strip_sql('key')} <> ''""")
def results_load(spark: SparkSession, d: str) -> DataFrame:
    r = results.loaded(table(spark, d, "results"))
    return r.select("file", "key", "source", "target", "context", F.array_join("sub_keys", "\x1f").alias("sub_keys"), F.coalesce(F.cardinality("extra"), F.lit(0)).cast("bigint").alias("extras"), "ord")


LAST = "l as (select file, key, arg_max(source, ord) as source, arg_max(target, ord) as target, max(ord) as ord, min(ord) as first_ord from r group by file, key)"


@query(f"with {RESULTS}, {LAST} select * from l")
def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return results.dedupe_last(lens.results(spark, d).select("file", "key", "source", "target", "ord"))


DONE = f"{strip_sql('target')} <> ''"


@query(f"with {ENTRIES}, {RESULTS} select file, key, ord from e where not exists (select 1 from r where r.file = e.file and r.key = e.key and {DONE})")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return results.pending(lens.entries(spark, d), lens.results(spark, d)).select("file", "key", "ord")


@query(f"with {ENTRIES}, {RESULTS} select file, key, ord from r where exists (select 1 from e where r.file = e.file and r.key = e.key)")
def wanted_results(spark: SparkSession, d: str) -> DataFrame:
    return results.wanted(lens.results(spark, d), lens.entries(spark, d)).select("file", "key", "ord")


# --- memory -----------------------------------------------------------------------------------------------------------

MEMORY = f"""m as (select coalesce(context, '') as context, source, arg_max(target, {{'a': updated_at, 'b': target}}) as target from memory
where {strip_sql('source')} <> '' and {strip_sql('target')} <> '' and lower({strip_sql('target_lang')}) in ('', 'vi') and lower({strip_sql('source_lang')}) in ('', 'auto', 'ja') group by 1, 2)"""


@query(f"with {MEMORY} select * from m")
def memory_effective(spark: SparkSession, d: str) -> DataFrame:
    return results.effective_memory(table(spark, d, "memory"), "vi", "ja")


@query(f"""with {ENTRIES}, {MEMORY} select e.ord, coalesce(a.target, b.target) as remembered from e left join m a on a.source = e.source and a.context = e.context
left join m b on b.source = e.source and b.context = ''""")
def memory_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    return results.lookup_memory(lens.entries(spark, d), results.effective_memory(table(spark, d, "memory"), "vi", "ja")).select("ord", "remembered")


@query(f"""with {RESULTS}, n as (select source, target, 'auto' as source_lang, 'de' as target_lang, 'upper' as provider, context, timestamptz '2030-01-01 00:00:00+00' as updated_at, 1 as b from r where target_lang = 'de' and {DONE} and target <> source),
a as (select source, target, source_lang, target_lang, provider, context, updated_at, 0 as b from memory union all by name select * from n),
g as (select source, coalesce(context, '') as c, lower(target_lang) as t, case when {strip_sql('source_lang')} = '' then 'auto' else lower(source_lang) end as s, arg_max(target, {{'a': b, 'b': updated_at, 'c': target}}) as target
from a where {strip_sql('source')} <> '' and {strip_sql('target_lang')} <> '' group by all)
select source, c as context, t as target_lang, s as source_lang, target from g""")
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    fresh = lens.results(spark, d).where("target_lang = 'de'")
    out = results.upsert_memory(table(spark, d, "memory"), fresh, "de", "auto", "upper", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    lang = F.when(X.blank(F.col("source_lang")), "auto").otherwise(F.lower("source_lang"))
    return out.select("source", X.text(F.col("context")).alias("context"), F.lower("target_lang").alias("target_lang"), lang.alias("source_lang"), "target")


@query("""select source, coalesce(context, '') as context, source_lang, target_lang, arg_max(target, {'a': updated_at, 'b': target}) as target from memory group by source, coalesce(context, ''), source_lang, target_lang""")
def memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """The memory as a stream of files, kept in a log that a second reader compacts."""
    import uuid

    base = f"{shared_dir(spark)}/lingoweave/stream-{uuid.uuid4().hex}"
    table(spark, d, "memory").withColumn("context", X.text(F.col("context"))).write.parquet(f"{base}/in")
    stream_memory(spark, f"{base}/in", f"{base}/log", f"{base}/progress")
    return compacted(spark.read.parquet(f"{base}/log")).select("source", "context", "source_lang", "target_lang", "target")


# --- groups -----------------------------------------------------------------------------------------------------------

#: written out, so that the lists of the library are checked too
CATEGORY = """case when context in ('rpg_maker_actors_name', 'rpg_maker_actors_nickname', 'rpg_maker_enemies_name', 'rpg_maker_skills_name', 'rpg_maker_items_name', 'rpg_maker_weapons_name', 'rpg_maker_armors_name',
'rpg_maker_states_name', 'rpg_maker_classes_name', 'rpg_maker_map_display_name', 'rpg_maker_system_gameTitle', 'rpg_maker_system_currencyUnit', 'rpg_maker_speaker_name', 'rpg_maker_troops_name', 'rpg_maker_event_name',
'rpg_maker_map_info_name', 'rpg_maker_common_event_name', 'rpg_maker_troop_name') then 'name'
when context in ('rpg_maker_event_text', 'rpg_maker_map_dialogue', 'rpg_maker_map_comment', 'rpg_maker_comment') or regexp_full_match(context, 'rpg_maker_(skills_message[12]|states_message[1234])') then 'dialogue'
when context in ('rpg_maker_choice', 'rpg_maker_map_choice', 'rpg_maker_map_choice_label') then 'choice' when context in ('rpg_maker_map_script_string', 'rpg_maker_script') then 'script'
when regexp_full_match(context, 'rpg_maker_(skills|items|weapons|armors|states)_description') or context = 'rpg_maker_actors_profile' then 'description'
when regexp_full_match(context, 'rpg_maker_terms_(basic|commands|params|messages)|rpg_maker_system_(elements|weaponTypes|armorTypes|equipTypes|skillTypes)') then 'ui'
when starts_with(context, 'rpg_maker_plugin_ui_') then 'plugin_ui' when starts_with(context, 'rpg_maker_generic_') then 'generic' when starts_with(context, 'rpg_maker_plugin_param_') then 'plugin_param' else context end"""
GROUPS = f"g as (select source, {CATEGORY} as category, min(ord) as first_ord, count(*) as members from e group by 1, 2)"


@query(f"with {ENTRIES}, {GROUPS} select * from g")
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    return results.source_groups(lens.entries(spark, d))


@query(f"with {ENTRIES}, {GROUPS} select cast(sum(members) as bigint) as entries, count(*) as calls, cast(sum(members) - count(*) as bigint) as saved from g")
def dedup_savings(spark: SparkSession, d: str) -> DataFrame:
    g = results.source_groups(lens.entries(spark, d))
    return g.agg(F.sum("members").alias("entries"), F.count(F.lit(1)).alias("calls"), (F.sum("members") - F.count(F.lit(1))).alias("saved"))


@query(f"with {ENTRIES}, {GROUPS} select e.ord, concat('T', g.first_ord) as target from e join g on g.source = e.source and g.category = {CATEGORY.replace('context', 'e.context')}")
def fanout(spark: SparkSession, d: str) -> DataFrame:
    e = lens.entries(spark, d)
    made = results.source_groups(e).select("source", "category", F.concat(F.lit("T"), F.col("first_ord").cast("string")).alias("target"))
    return results.fan_out(e, made).select("ord", "target")


@query(f"with {ENTRIES} select context, {CATEGORY} as category, count(*) as entries from e group by all")
def dedup_categories(spark: SparkSession, d: str) -> DataFrame:
    return lens.entries(spark, d).groupBy("context", C.dedup_category(F.col("context")).alias("category")).agg(F.count(F.lit(1)).alias("entries"))


HINT = """case when starts_with(context, 'rpg_maker_plugin_ui_') then 'plugin UI text' else coalesce(case string_split(context, '_plugin_')[1] when 'rpg_maker_event_text' then 'dialogue' when 'rpg_maker_choice' then 'choice option'
when 'rpg_maker_map_display_name' then 'map name' when 'rpg_maker_skills_name' then 'skill name' when 'rpg_maker_skills_description' then 'skill description' when 'rpg_maker_skills_message1' then 'battle message'
when 'rpg_maker_skills_message2' then 'battle message' when 'rpg_maker_items_name' then 'item name' when 'rpg_maker_items_description' then 'item description' when 'rpg_maker_weapons_name' then 'weapon name'
when 'rpg_maker_weapons_description' then 'weapon description' when 'rpg_maker_armors_name' then 'armor name' when 'rpg_maker_armors_description' then 'armor description' when 'rpg_maker_actors_name' then 'actor name'
when 'rpg_maker_actors_nickname' then 'actor nickname' when 'rpg_maker_actors_profile' then 'actor profile' when 'rpg_maker_enemies_name' then 'enemy name' when 'rpg_maker_states_name' then 'state name'
when 'rpg_maker_states_description' then 'state description' when 'rpg_maker_classes_name' then 'class name' when 'rpg_maker_system_gameTitle' then 'game title' when 'rpg_maker_system_currencyUnit' then 'currency unit'
when 'rpg_maker_terms_basic' then 'term' when 'rpg_maker_terms_commands' then 'command' when 'rpg_maker_terms_params' then 'parameter name' when 'rpg_maker_terms_messages' then 'system message'
when 'rpg_maker_speaker_name' then 'speaker name' when 'rpg_maker_troops_name' then 'troop name' when 'rpg_maker_mz_plugin_text' then 'plugin text' when 'rpg_maker_system_elements' then 'element name'
when 'rpg_maker_system_weaponTypes' then 'weapon type' when 'rpg_maker_system_armorTypes' then 'armor type' when 'rpg_maker_system_equipTypes' then 'equip type' when 'rpg_maker_system_skillTypes' then 'skill type' end,
case when regexp_full_match(string_split(context, '_plugin_')[1], 'rpg_maker_states_message[1234]') then 'state message' when contains(context, '_plugin_') then 'plugin text' else context end) end"""


@query(f"with {ENTRIES} select context, {HINT} as hint, count(*) as entries from e group by all")
def context_hints(spark: SparkSession, d: str) -> DataFrame:
    return lens.entries(spark, d).groupBy("context", C.context_hint(F.col("context")).alias("hint")).agg(F.count(F.lit(1)).alias("entries"))


# --- batches ----------------------------------------------------------------------------------------------------------

BATCHES = f"""w as (select file, cast(floor(ord / 100000) as bigint) as block, ord, length(source) + length(context_text) as chars, row_number() over (partition by file, floor(ord / 100000) order by ord) as n from e),
b as (select *, cast(0 as bigint) as batch_no, 1 as k, chars as total from w where n = 1
union all select w.*, case when b.k >= 30 or b.total + w.chars > 12000 then b.batch_no + 1 else b.batch_no end, case when b.k >= 30 or b.total + w.chars > 12000 then 1 else b.k + 1 end,
case when b.k >= 30 or b.total + w.chars > 12000 then w.chars else b.total + w.chars end from b join w on w.file = b.file and w.block = b.block and w.n = b.n + 1)"""


@query(f"with recursive {ENTRIES}, {BATCHES} select file, block, ord, chars, batch_no from b")
def char_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.char_batches(lens.entries(spark, d))


@query(f"""with recursive {ENTRIES}, {BATCHES} select file, block, batch_no, count(*) as entries, cast(sum(chars) as bigint) as chars,
least(greatest(cast(floor(sum(chars) * 1.5) as bigint) + 512, 1024), 16384) as tokens from b group by all""")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return batching.batch_summary(batching.char_batches(lens.entries(spark, d)))


@query(f"with {ENTRIES} select least(greatest(cast(floor(8000 / greatest(avg(length(source) + length(context_text)) / 3.5, 1)) as bigint), 1), 60) as batch_size from (select * from e order by ord limit 20)")
def auto_batch_size(spark: SparkSession, d: str) -> DataFrame:
    return batching.auto_batch_size(lens.entries(spark, d))


# --- filters ----------------------------------------------------------------------------------------------------------

BLANK_T = f"{strip_sql('target')} = ''"
LEAK = f"regexp_matches(target, '{X.CJK}')"
RETRY = f"({BLANK_T} or target = source or {LEAK})"
for _name, _which, _test in (("fallback", "fallback", f"target = source and {strip_sql('source')} <> ''"), ("empty", "empty", BLANK_T), ("cjk_leak", "cjk-leak", LEAK), ("needs_retry", "needs-retry", RETRY),
                             ("context", "context=rpg_maker_choice", "context = 'rpg_maker_choice'"), ("all", "all", "true")):
    query(f"with {RESULTS} select file, key, ord from r where {_test}", f"retry_filter_{_name}")(
        functools.partial(lambda spark, d, which: results.retry_filter(lens.results(spark, d), which).select("file", "key", "ord"), which=_which))

S, T = strip_sql("source"), strip_sql("target")
for _name, _test in (("all", "true"), ("fallback", f"{S} = {T} and {S} <> ''"), ("cjk_leak", f"regexp_matches({T}, '{X.CJK}')"), ("needs_retry", RETRY), ("translated", f"{T} <> '' and {T} <> {S}")):
    query(f"with {RESULTS} select file, key, ord from r where {_test} and contains(lower(concat_ws(chr(10), source, target, key)), 'stone')", f"editor_filter_{_name}")(
        functools.partial(lambda spark, d, which: results.editor_filter(lens.results(spark, d), which, "STONE").select("file", "key", "ord"), which=_name))


@query(f"with {RESULTS} select file, key, source, '' as target, ord from r where {LEAK} union all by name select file, key, source, target, ord from r where not {LEAK} and not exists (select 1 from r x where x.file = r.file and x.key = r.key and regexp_matches(x.target, '{X.CJK}')) union all by name select file, key, source, '' as target, ord from r where not {LEAK} and exists (select 1 from r x where x.file = r.file and x.key = r.key and regexp_matches(x.target, '{X.CJK}'))")
def retry_cleared(spark: SparkSession, d: str) -> DataFrame:
    return results.cleared(lens.results(spark, d), "cjk-leak").select("file", "key", "source", "target", "ord")


@query(f"with {RESULTS} select ord, replace(target, 'the ', 'THE ') as target from r where contains(target, 'the ')")
def bulk_replace_case(spark: SparkSession, d: str) -> DataFrame:
    return lens.results(spark, d).where(F.contains("target", F.lit("the "))).select("ord", X.replaced(F.col("target"), "the ", "THE ").alias("target"))


@query(f"with {RESULTS} select ord, regexp_replace(target, '(?i)the ', '$1 \\\\', 'g') as target from r where contains(lower(target), 'the ')")
def bulk_replace_nocase(spark: SparkSession, d: str) -> DataFrame:
    return lens.results(spark, d).where(F.contains(F.lower("target"), F.lit("the "))).select("ord", X.replaced(F.col("target"), "the ", "$1 \\", True).alias("target"))


# --- codes, boxes, corrections ----------------------------------------------------------------------------------------

def mask_sql(c: str, pattern: str, first: str) -> tuple[str, str]:
    """SQL of the masked text and of the list of matches."""
    p = pattern.replace("'", "''")
    found = f"regexp_extract_all({c}, '{p}')"
    between = f"string_split_regex({c}, '{p}')"
    return f"array_to_string(list_transform({between}, lambda x, i: case when i <= len({found}) then concat(x, 'ZXQ', lpad(cast({first} + i - 1 as varchar), 4, '0'), 'QXZ') else x end), '')", found


BOX = X.NAMEBOX
_head, _t1 = mask_sql("box", X.CODE, "0")
_body, _t2 = mask_sql("rest", X.CODE, "len(t1)")
_tail, _t3 = mask_sql("body", X.TAG, "len(t1) + len(t2)")
MASKED = f"""k0 as (select *, regexp_extract(source, '{BOX}') as box from r), k1 as (select *, substr(source, length(box) + 1) as rest, {_t1} as t1, {_head} as head from k0),
k2 as (select *, {_t2} as t2, {_body} as body from k1), k3 as (select *, {_t3} as t3, {_tail} as tail from k2)"""


@query(f"with {RESULTS}, {MASKED} select ord, concat(head, tail) as masked, array_to_string(list_concat(list_concat(t1, t2), t3), chr(31)) as tokens from k3")
def mask_tokens(spark: SparkSession, d: str) -> DataFrame:
    m = lens.results(spark, d).select("ord", X.mask(F.col("source")).alias("m"))
    return m.select("ord", "m.masked", F.array_join("m.tokens", "\x1f").alias("tokens"))


@query(f"with {RESULTS} select ord, source as restored from r")
def mask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m = lens.results(spark, d).select("ord", X.mask(F.col("source")).alias("m"))
    return m.select("ord", X.unmask(F.col("m.masked"), F.col("m.tokens")).alias("restored"))


SPACED = "regexp_replace(replace(target, '[', ' [ '), '%', '% ', 'g')"
FIXED = SPACED
for _p, _into in X.SPACED_TOKENS:
    FIXED = f"regexp_replace({FIXED}, '{_p.replace(chr(92) + 'w', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')}', '{_into.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"


@query(f"with {RESULTS} select ord, {FIXED} as fixed from r")
def token_format_fix(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose codes have been torn apart, mended."""
    torn = F.replace(F.replace(F.col("target"), F.lit("["), F.lit(" [ ")), F.lit("%"), F.lit("% "))
    return lens.results(spark, d).select("ord", X.fix_token_spacing(torn).alias("fixed"))


def box_sql(c: str, g: int = 0) -> str:
    return f"regexp_extract({c}, '{BOX}', {g})"


CODE_SQL = X.CODE.replace("'", "''")
NAME = lambda c: strip_sql(f"regexp_replace({box_sql(c, 2)}, '{CODE_SQL}', '', 'g')")


@query(f"with {RESULTS}, b as (select ord, concat('\\n<\\C[2]', source, '>', target) as source from r where context = 'rpg_maker_speaker_name') select name, arg_min(content, ord) as content from (select {NAME('source')} as name, {box_sql('source', 2)} as content, ord from b) where name <> '' and regexp_matches(name, '{X.CJK}') group by name")
def namebox_names(spark: SparkSession, d: str) -> DataFrame:
    r = lens.results(spark, d).where("context = 'rpg_maker_speaker_name'")
    return glossary.namebox_names(r.select("ord", F.concat(F.lit("\\n<\\C[2]"), "source", F.lit(">"), "target").alias("source")))


@query(f"""with {RESULTS}, c as (select *, array_to_string(regexp_extract_all({box_sql('source', 2)}, '{CODE_SQL}'), '') as codes, {box_sql('source')} as sb, {box_sql('target')} as tb from r)
select ord, case when sb = '' then target when tb = '' then concat(sb, regexp_replace(target, '^{lens.SQL_SPACE}+', ''))
when codes <> '' and not regexp_matches({box_sql('target', 2)}, '{CODE_SQL}') then concat({box_sql('target', 1)}, '<', codes, {box_sql('target', 2)}, '>', substr(target, length(tb) + 1)) else target end as target from c""")
def namebox_restore(spark: SparkSession, d: str) -> DataFrame:
    return lens.results(spark, d).select("ord", X.restore_box(F.col("source"), F.col("target")).alias("target"))


@query(f"""with {RESULTS}, b as (select ord, concat('\\n<', source, '>', source) as source, concat('\\n<', source, '>', target) as target from r where context = 'rpg_maker_speaker_name'),
n as (select ord, source, target, {NAME('source')} as sn, {NAME('target')} as tn, {box_sql('target')} as tb from b)
select ord, case when target <> source and tb <> '' and sn = tn and regexp_matches(sn, '{X.CJK}') then concat({box_sql('target', 1)}, '<', replace({box_sql('target', 2)}, sn, concat('#', sn)), '>', substr(target, length(tb) + 1)) else target end as target from n""")
def namebox_replace(spark: SparkSession, d: str) -> DataFrame:
    """Speakers' names put into boxes before source and target, then given another name in the box."""
    r = lens.results(spark, d).where("context = 'rpg_maker_speaker_name'")
    box = F.concat(F.lit("\\n<"), F.col("source"), F.lit(">"))
    b = r.select("ord", F.concat(box, "source").alias("source"), F.concat(box, "target").alias("target"))
    return b.select("ord", X.replace_box_name(F.col("source"), F.col("target"), F.concat(F.lit("#"), X.box_name(F.col("source")))).alias("target"))


RULES = [("the", "THE"), ("Yes", "Yep"), ("stone mask", r"\N[1] $mask"), ("coins", ""), ("、", ","), ("HP", "LP")]
CORRECTED = "target"
for _find, _into in RULES:
    CORRECTED = (f"regexp_replace({CORRECTED}, '\\b{_find}\\b', '{_into.replace(chr(92), chr(92) * 2)}', 'g')" if _find.isascii() and _find.isalnum() else f"replace({CORRECTED}, '{_find}', '{_into}')")


@query(f"with {RESULTS} select ord, {CORRECTED} as target from r")
def correction_apply(spark: SparkSession, d: str) -> DataFrame:
    return lens.results(spark, d).select("ord", X.corrected(F.col("target"), RULES).alias("target"))


CONTROL_SQL = X.CONTROL_CODE
APPEND = lambda start, pattern: f"list_reduce(list_prepend({start}, regexp_extract_all(source, '{pattern}')), lambda a, t: case when contains(a, t) then a else concat(a, t) end)"


@query(f"with {RESULTS} select ord, case when {BLANK_T} or target = source then target else {APPEND(APPEND('target', CONTROL_SQL), X.FORMAT)} end as target from r")
def repair_syntax(spark: SparkSession, d: str) -> DataFrame:
    return lens.results(spark, d).select("ord", X.repair_syntax(F.col("source"), F.col("target")).alias("target"))


def quoted_sql(t: str) -> str:
    inner = f"replace(replace({t}, '\\', '\\\\'), chr(10), '\\n')"
    return f"case when contains({t}, '''') and not contains({t}, '\"') then concat('\"', {inner}, '\"') else concat('''', replace({inner}, '''', '\\'''), '''') end"


MISSING = f"list_filter(list_sort(list_distinct(regexp_extract_all(source, '{CONTROL_SQL}'))), lambda t: not contains(target, t))"


@query(f"with {RESULTS}, m as (select ord, array_to_string(list_transform({MISSING}, lambda t: {quoted_sql('t')}), ',') as missing from r) select * from m where missing <> ''")
def missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return results.missing_token_rows(lens.results(spark, d))


# --- warnings and reports ---------------------------------------------------------------------------------------------

LINES = lambda c: f"(length({c}) - length(replace({c}, chr(10), '')))"
_share = f"(length(source) - length(regexp_replace(source, '{X.CJK_RATIO}', '', 'g'))) / greatest(length(source), 1)"
_size = "concat('(', length(source), '→', length(target), ' chars, max '"
WARNED = f"""w0 as (select *, {_share} as share, {box_sql('source')} as sb, {box_sql('target')} as tb from r),
w1 as (select *, case when sb = '' then source else concat({box_sql('source', 1)}, substr(source, length(sb) + 1)) end as body from w0),
w as (select *, case when {BLANK_T} or target = source then [] else list_filter(list_concat(list_concat(list_concat(list_concat(
  [case when {LEAK} then 'target contains CJK characters (possible partial translation)' end],
  list_transform(list_filter(regexp_extract_all(body, '{CODE_SQL}|{X.TAG}'), lambda t: not contains(target, t)), lambda t: concat('missing placeholder ', {quoted_sql('t')}))),
  [case when sb <> '' and tb = '' then 'missing YEP_MessageCore namebox prefix' end]),
  list_transform({MISSING}, lambda t: concat('missing control code ', {quoted_sql('t')}))),
  [case when context = 'rpg_maker_script' and contains(target, chr(10)) then 'script string contains newline' end,
   case when {NAME('source')} <> '' and {NAME('source')} = {NAME('target')} and regexp_matches({NAME('source')}, '{X.CJK}') then 'namebox speaker name was not translated' end,
   case when {LINES('source')} > 0 and {LINES('source')} <> {LINES('target')} then concat('newline count mismatch (', {LINES('source')}, ' vs ', {LINES('target')}, ')') end,
   case when context in ({quote_list(C.SHORT_CONTEXTS)}) then case when length(target) > length(source) * (case when share >= 0.5 then 4 else 2.5 end) and length(source) < 60 then {_size.replace('concat(', "concat('name/UI label too long ', ")}, case when share >= 0.5 then '4' else '2.5' end, 'x for context ''', context, ''')') end
        when context in ({quote_list(C.DESCRIPTION_CONTEXTS)}) then case when length(target) > length(source) * 4 and length(source) < 120 then {_size.replace('concat(', "concat('description too long ', ")}, '4x for context ''', context, ''')') end
        when share >= 0.5 and length(source) <= 6 then null
        when length(target) > length(source) * (case when share >= 0.5 and length(source) <= 10 then 8 else 3 end) and length(source) < 120 then 'translation much longer than source (possible UI overflow)' end]),
  lambda x: x is not null) end as warnings from w1)"""


@query(f"with {RESULTS}, {WARNED} select ord, array_to_string(warnings, '; ') as warnings from w where len(warnings) > 0")
def warnings_per_row(spark: SparkSession, d: str) -> DataFrame:
    r = lens.results(spark, d)
    return r.select("ord", F.array_join(X.warnings(F.col("source"), F.col("target"), F.col("context")), "; ").alias("warnings")).where("warnings <> ''")


@query(f"with {RESULTS}, {WARNED} select {strip_sql(chr(120))} as warning, count(*) as rows from (select string_split(unnest(warnings), '(')[1] as x from w) group by 1")
def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    return results.warning_counts(lens.results(spark, d))


@query(f"""with {RESULTS}, {WARNED} select count(*) as total, count(*) filter ({BLANK_T}) as empty, count(*) filter (target = source and not {BLANK_T}) as fallback,
round(count(*) filter (target = source and not {BLANK_T}) * 100.0 / count(*), 2) as fallback_pct, count(*) filter (len(warnings) > 0) as warned from w""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return results.validation_report(lens.results(spark, d))


STATUS = f"case when {BLANK_T} or target = source then 'fallback' when len(warnings) > 0 then 'warn' else 'done' end"


@query(f"with {RESULTS}, {WARNED} select {STATUS} as status, count(*) as rows from w group by 1")
def progress_counts(spark: SparkSession, d: str) -> DataFrame:
    return results.with_status(lens.results(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query(f"with {RESULTS}, {WARNED} select file, key, ord from w where {STATUS} = 'warn' and {HINT} = 'dialogue' and contains(lower(concat_ws(chr(10), source, target, key, file)), 'map')")
def preview_filter(spark: SparkSession, d: str) -> DataFrame:
    return results.preview_filter(lens.results(spark, d), "warn", "dialogue", "Map").select("file", "key", "ord")


@query(f"""with {RESULTS}, {WARNED}, x as (select file, ord, case when {STATUS} = 'warn' then ord end as k from w)
select file, ord, coalesce(min(k) over (partition by file order by ord rows between 1 following and unbounded following), min(k) over (partition by file)) as next from x""")
def next_warnings(spark: SparkSession, d: str) -> DataFrame:
    return results.next_warning(lens.results(spark, d))


@query(f"""with {RESULTS}, b as (select file, key, max(concat('N', target)) as n from r where ord % 2 = 0 group by 1, 2)
select r.ord, case when b.n is not null and r.ord % 4 <> 0 then b.n else r.target end as target from r left join b on b.file = r.file and b.key = r.key""")
def batch_merge(spark: SparkSession, d: str) -> DataFrame:
    """A batch of new targets merged into the review table, of which every fourth row was edited by hand."""
    r = lens.results(spark, d)
    batch = r.where("ord % 2 = 0").select("file", "key", F.concat(F.lit("N"), "target").alias("target"))
    return results.merge_batch(r.withColumn("manually_edited", F.col("ord") % 4 == 0), batch).select("ord", "target")


@query(f"""with {RESULTS}, b as (select *, ord % 200 as batch_no from r), a as (select batch_no, case when ord % 3 = 0 then concat(file, chr(31), key) end as id, case when ord % 3 = 1 then key end as key, target, ord as n from b where ord % 5 <> 0),
f as (select batch_no, count(distinct file) as files from b group by 1), i as (select batch_no, id, arg_max(target, n) as t from a where id is not null group by 1, 2), k as (select batch_no, key, arg_max(target, n) as t from a where key is not null group by 1, 2)
select b.ord, coalesce(i.t, case when f.files = 1 then k.t end, b.source) as target from b join f using (batch_no) left join i on i.batch_no = b.batch_no and i.id = concat(b.file, chr(31), b.key) left join k on k.batch_no = b.batch_no and k.key = b.key""")
def response_match(spark: SparkSession, d: str) -> DataFrame:
    """Answers by id or by key only, some missing, matched to the rows of their batch."""
    b = lens.results(spark, d).withColumn("batch_no", F.col("ord") % 200)
    a = b.where("ord % 5 <> 0").select("batch_no", F.when(F.col("ord") % 3 == 0, F.concat_ws("\x1f", "file", "key")).alias("id"), F.when(F.col("ord") % 3 == 1, F.col("key")).alias("key"), "target", F.col("ord").alias("n"))
    return provider.match_answers(b.select("batch_no", "file", "key", "source", "ord"), a).select("ord", "target")


@query(f"with {RESULTS} select count(*) as total, count(*) filter (not {BLANK_T} and target <> source) as translated, count(*) filter ({BLANK_T} or target = source) as fallback from r")
def translate_report(spark: SparkSession, d: str) -> DataFrame:
    return results.translate_report(lens.results(spark, d))


@query(f"""with {ENTRIES}, {RESULTS}, {LAST}, j as (select e.source, coalesce(l.target, '') as target from e left join l on l.file = e.file and l.key = e.key)
select count(*) filter (not {BLANK_T} and target <> source) as done, count(*) filter (not {BLANK_T} and target = source) as fallback, count(*) filter ({BLANK_T}) as todo from j""")
def preflight(spark: SparkSession, d: str) -> DataFrame:
    return results.preflight(lens.entries(spark, d), lens.results(spark, d))


NOUNS = f"""n as (select {S} as source, {T} as target, min(ord) as first from r where {T} <> '' and target <> source and context in ({quote_list(C.NAME_CONTEXTS)}) and {S} <> '' and length({S}) <= 80 group by all),
i as (select source, string_agg(target, ' | ' order by first, target) as targets, count(*) as variants from n group by source having count(*) >= 2)"""


@query(f"with {RESULTS}, {NOUNS} select * from i")
def noun_inconsistency(spark: SparkSession, d: str) -> DataFrame:
    return results.noun_inconsistency(lens.results(spark, d))


@query(f"""with {RESULTS}, {NOUNS} select * from (select source, concat('Noun inconsistency: ''', source, ''' translated as: [', targets, ']') as message from i order by source limit 30)
union all select null, concat('...and ', count(*) - 30, ' more noun inconsistencies') from i having count(*) > 30""")
def noun_messages(spark: SparkSession, d: str) -> DataFrame:
    return results.noun_messages(lens.results(spark, d))


# --- comparison of deliveries ----------------------------------------------------------------------------------------

def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The diff of every delivery with the one before it, in order of time."""
    s = table(spark, d, "text_snapshots").where("snapshot_no is not null")
    # one row per delivery: the window without a partition sees only these
    steps = s.groupBy("snapshot_no").agg(F.min("taken_at").alias("t")).select("snapshot_no", F.lead("snapshot_no").over(Window.orderBy("t", "snapshot_no")).alias("next"), F.lag("snapshot_no").over(Window.orderBy("t", "snapshot_no")).alias("last"))
    keys = ["snapshot_no", "file", "key"]
    state = results.dedupe_last(s.select(*keys, X.text(F.col("source")).alias("source"), X.text(F.col("target")).alias("target"), "ord"), keys=keys)
    new = state.join(F.broadcast(steps.where("last is not null").select("snapshot_no")), "snapshot_no")
    old = state.join(F.broadcast(steps.where("next is not null").select("snapshot_no", "next")), "snapshot_no").drop("snapshot_no").withColumnRenamed("next", "snapshot_no")
    return results.diff(old, new, old, keys)


DELIVERIES = f"""o as (select snapshot_no as b, lead(snapshot_no) over (order by t, snapshot_no) as a from (select snapshot_no, min(taken_at) as t from text_snapshots where snapshot_no is not null group by 1)),
s as (select snapshot_no, file, key, arg_max(coalesce(source, ''), ord) as source, arg_max(coalesce(target, ''), ord) as target from text_snapshots where snapshot_no is not null group by all),
new as (select s.* from s join o on o.a = s.snapshot_no), old as (select o.a as snapshot_no, file, key, source, target from s join o on o.b = s.snapshot_no where o.a is not null),
d as (select b.snapshot_no, b.file, b.key, b.source, case when a.source = b.source then a.target else '' end as target,
case when a.source = b.source and {strip_sql('a.target')} <> '' then 'unchanged' when a.source is not null and a.source <> b.source then case when {strip_sql('a.target')} <> '' then concat('changed (was: ', substr(a.target, 1, 80), ')') else 'changed' end else 'new' end as status
from new b left join old a on a.snapshot_no = b.snapshot_no and a.file = b.file and a.key = b.key
union all select a.snapshot_no, a.file, a.key, a.source, a.target, 'removed' from old a where not exists (select 1 from new b where b.snapshot_no = a.snapshot_no and b.file = a.file and b.key = a.key))"""


@query(f"with {DELIVERIES} select * from d", "diff_deliveries")
@query(f"with {DELIVERIES} select * from d")
def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    return _deliveries(spark, d)


@query(f"with {DELIVERIES} select snapshot_no, string_split(status, ' ')[1] as status, count(*) as rows from d group by all", "diff_delivery_counts")
@query(f"with {DELIVERIES} select snapshot_no, string_split(status, ' ')[1] as status, count(*) as rows from d group by all")
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return _deliveries(spark, d).groupBy("snapshot_no", F.substring_index("status", " ", 1).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


# --- glossary ---------------------------------------------------------------------------------------------------------

GLOSSARY = f"""g0 as (select {strip_sql('term')} as term, {strip_sql('translation')} as translation, {strip_sql('category')} as category, line_no from glossary),
g as (select term, arg_min(translation, line_no) as translation, arg_min(category, line_no) as category, min(line_no) as line_no from g0 where term <> '' and translation <> '' group by term)"""


@query(f"with {GLOSSARY} select * from g")
def glossary_load(spark: SparkSession, d: str) -> DataFrame:
    return glossary.load_glossary(table(spark, d, "glossary"))


@query(f"with {GLOSSARY} select category, count(*) as terms from g group by 1")
def glossary_categories(spark: SparkSession, d: str) -> DataFrame:
    return glossary.load_glossary(table(spark, d, "glossary")).groupBy("category").agg(F.count(F.lit(1)).alias("terms"))


@query(f"""with t as (select line_no, coalesce(term, '') as raw, {strip_sql('term')} as term, {strip_sql('translation')} as translation from glossary),
u as (select *, term <> '' and translation <> '' as good, lower(term) as fold from t where term <> '' or translation <> ''),
v as (select *, min(line_no) filter (good) over (partition by term) as first, (min({{'a': line_no, 'b': term}}) filter (good) over (partition by fold)).b as lead from u),
w as (select line_no, unnest([case when raw <> term then concat('Line ', line_no, ': term has leading/trailing whitespace (', {quoted_sql('raw')}, ')') end, case when term = '' then concat('Line ', line_no, ': term is blank') end,
case when term <> '' and translation = '' then concat('Line ', line_no, ': term ', {quoted_sql('term')}, ' has blank translation') end,
case when good and regexp_matches(translation, '[\\n\\r\\t]') then concat('Line ', line_no, ': term ', {quoted_sql('term')}, ' translation contains control chars (will break prompt formatting)') end,
case when good and first <> line_no then concat('Line ', line_no, ': duplicate term ', {quoted_sql('term')}, ' (first seen at line ', first, ', later rows ignored)') end,
case when good and first = line_no and lead <> term then concat('Line ', line_no, ': term ', {quoted_sql('term')}, ' differs only in case from ', {quoted_sql('lead')}, ' — only one will match') end]) as warning from v)
select * from w where warning is not null""")
def glossary_lint(spark: SparkSession, d: str) -> DataFrame:
    return glossary.lint(table(spark, d, "glossary"))


_line = "concat('- \"', term, '\" -> \"', translation, '\"', chr(10))"


@query(f"""with {GLOSSARY}, l as (select line_no, {_line} as line from g), u as (select *, sum(length(line)) over (order by line_no) + {len(glossary.HEADER)} <= 4000 as fits from l)
select concat('{glossary.HEADER.strip()}', chr(10), coalesce(string_agg(line, '' order by line_no) filter (fits), ''), case when count(*) filter (not fits) > 0 then concat('(...', count(*) filter (not fits), ' more terms omitted to keep prompt short)', chr(10)) else '' end) as prompt from u""")
def glossary_prompt(spark: SparkSession, d: str) -> DataFrame:
    return glossary.prompt(glossary.load_glossary(table(spark, d, "glossary")))


@query(f"""with {GLOSSARY}, l as (select category, 1 as k, line_no, {_line} as line from g union all select distinct category, 0, 0, concat('### ', category, chr(10)) from g where category <> ''),
u as (select *, sum(length(line)) over (order by category, k, line_no) + {len(glossary.HEADER)} <= 4000 as fits from l)
select concat('{glossary.HEADER.strip()}', chr(10), coalesce(string_agg(line, '' order by category, k, line_no) filter (fits), ''), case when count(*) filter (not fits) > 0 then concat('(...more terms omitted to keep prompt short)', chr(10)) else '' end) as prompt from u""")
def glossary_prompt_categories(spark: SparkSession, d: str) -> DataFrame:
    return glossary.prompt_by_category(glossary.load_glossary(table(spark, d, "glossary")))


@query(f"""with {RESULTS}, n as (select source as term, arg_min({T}, ord) as translation, min(ord) as o from r where not {BLANK_T} and target <> source and context in ({quote_list(C.AUTO_GLOSSARY_CONTEXTS)}) and length(source) between 1 and 40 group by source)
select term, translation from n order by o limit 80""")
def auto_glossary(spark: SparkSession, d: str) -> DataFrame:
    return glossary.auto_glossary(lens.results(spark, d))


@query(f"""with {RESULTS}, a as (select source, arg_max({T}, ord) as translation, min(ord) as first from r where context = 'rpg_maker_speaker_name' and not {BLANK_T} and target <> source and source <> '' group by source),
s as (select distinct right(source, 2) as alias from a where length(source) > 2 and source >= 'ト'),
h as (select s.alias, a.* from a join s on ends_with(a.source, s.alias)), e2 as (select * from h union all select source, * from a where source not in (select source from h))
select alias as term, arg_min(translation, {{'a': first, 'b': source}}) as translation from e2 group by 1""")
def speaker_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Speakers taken as actors, and the last two signs of some as the names in their boxes."""
    r = lens.results(spark, d).where("context = 'rpg_maker_speaker_name'")
    actors = r.withColumn("context", F.lit("rpg_maker_actors_name"))
    good = r.where(~X.blank(F.col("target")) & (F.col("target") != F.col("source")) & (F.length("source") > 2) & (F.col("source") >= "ト"))
    boxes = good.withColumn("source", F.concat(F.lit("<"), F.right("source", F.lit(2)), F.lit(">"))).withColumn("context", F.lit("rpg_maker_event_text"))
    return glossary.speaker_glossary(actors.unionByName(boxes))


# --- predicates and small functions -----------------------------------------------------------------------------------

@query(f"""with {RESULTS} select ord, {strip_sql('source')} <> '' and not regexp_matches({strip_sql('source')}, '{X.ONLY_CODES}') as is_text,
length({S}) >= 2 and not starts_with({S}, '$') and not starts_with({S}, '@') and not (starts_with({S}, '#') and length({S}) in (4, 7)) and {S} not in ({quote_list(X.UI_LITERALS)}) as is_ui_text,
case when regexp_matches(source, '[\\x{{3040}}-\\x{{30ff}}]') then 'ja' when regexp_matches(source, '[\\x{{ac00}}-\\x{{d7af}}]') then 'ko' when regexp_matches(source, '[\\x{{4e00}}-\\x{{9fff}}]') then 'zh' end as lang from r""")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    return lens.results(spark, d).select("ord", X.is_text(s).alias("is_text"), X.is_ui_text(s).alias("is_ui_text"), X.source_language(s).alias("lang"))


_v, _bare = "v", "regexp_replace(v, '\\s*#[^\\n]+$', '')"


TRANSLATABLE = f"""length(v) >= 2 and not regexp_matches(v, '^#[0-9a-fA-F]{{3,8}}$') and not regexp_matches(v, '^-?\\d+(\\.\\d+)?$') and not regexp_matches(v, '{X.ASSET}')
and regexp_matches(v, '{X.LETTER}') and not regexp_matches({strip_sql(_bare)}, '{X.INTERNAL}') and lower(v) not in ({quote_list(X.ENUM_VALUES)}) and not regexp_matches({strip_sql(_bare)}, '{X.CODE_LIKE}')
and not ((starts_with(v, '[') and ends_with(v, ']')) or (starts_with(v, '{{') and ends_with(v, '}}')) or (starts_with(v, '"') and ends_with(v, '"') and length(v) <= 40))
and not (regexp_matches(v, '^[A-Za-z_][A-Za-z0-9_]*$') and length(v) <= 32 and regexp_matches(v, '[a-z][A-Z]|_'))
and not (regexp_matches(v, '^[A-Za-z_][A-Za-z0-9_]*(/[A-Za-z_][A-Za-z0-9_]*)*$') and length(v) <= 40 and (regexp_matches(v, '[_/]') or not regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')))"""


@query(f"""with w as (select ord, unnest(string_split(coalesce(target, ''), ' ')) as x from results), v as (select ord, x, {strip_sql('x')} as v from w)
select ord, x as word, count(*) as times from v where {TRANSLATABLE} group by all""")
def text_heuristic(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "results").select("ord", F.explode(F.split(X.text(F.col("target")), " ", -1)).alias("word"))
    return words.where(X.looks_translatable(F.col("word"))).groupBy("ord", "word").agg(F.count(F.lit(1)).alias("times"))


MESSAGES = ["HTTP 429 too many requests", "error 524: timed out", "{'retry_after': 7.5}", "I cannot help with that", "answer is not valid JSON", "503 unavailable", "overloaded_error", "finish_reason=length", "returned no choices", "unknown"]


@query(f"""with m as (select event_id, ([{quote_list(MESSAGES)}])[event_id % {len(MESSAGES)} + 1] as msg from events), n as (select *, lower(msg) as low from m),
f as (select *, list_bool_or([{', '.join(f"contains(low, '{r.replace(chr(39), chr(39) * 2)}')" for r in X.REFUSALS)}]) as refusal, regexp_extract(msg, '[''"]retry_after[''"]\\s*:\\s*(\\d+(?:\\.\\d+)?)', 1) as own,
list_bool_or([{', '.join(f"contains(low, '{r}')" for r in X.SPLIT)}]) as split from n),
g as (select *, case when refusal then null when own <> '' then cast(own as double) {' '.join('when ' + ' or '.join(f"contains(low, '{p}')" for p in ps) + f' then cast({s} as double)' for ps, s in X.RETRY_AFTER)} end as d from f)
select event_id, refusal, d is not null as retry, coalesce(d, 0.0) as delay, split from g""")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % len(MESSAGES)).cast("int")
    m = table(spark, d, "events").select("event_id", F.get(F.array(*[F.lit(x) for x in MESSAGES]), n).alias("msg"))
    return m.select("event_id", X.classify_error(F.col("msg")).alias("c")).select("event_id", "c.*")


@query(r"""select ord, array_to_string(regexp_extract_all(coalesce(key, ''), '\.([^.\[]+)|\[\d+\]|\[''[^'']*''\]'), chr(31)) as steps from entries""")
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("ord", F.array_join(games.path_tokens(F.col("key")), "\x1f").alias("steps"))


LANGS = ["English", "german", "vi", "Chinese", "Chinese Traditional", "XX", "auto", "viet", " chinese simplified "]


@query(f"""with l as (select event_id, ([{quote_list(LANGS)}])[event_id % {len(LANGS)} + 1] as name from events)
select event_id, case event_id % {len(LANGS)} when 0 then 'en' when 1 then 'de' when 2 then 'vi' when 3 then 'zh' when 5 then 'xx' when 6 then 'auto' when 7 then 'vi' end as code,
case trim(name) when 'English' then 'en' when 'german' then 'de' when 'Chinese' then 'zh-CN' when 'chinese simplified' then 'zh-CN' when 'Chinese Traditional' then 'zh-TW' else name end as folder from l""")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes (null for the two written forms of Chinese, which are no names of their own there) and folders of languages' names."""
    n = (F.col("event_id") % len(LANGS)).cast("int")
    m = table(spark, d, "events").select("event_id", F.get(F.array(*[F.lit(x) for x in LANGS]), n).alias("name"))
    return m.select("event_id", F.when(~F.lower(F.trim("name")).isin("chinese traditional", "chinese simplified"), C.language_code(F.col("name"))).alias("code"), C.folder_language(F.col("name")).alias("folder"))


LOG = ["Batch failed: x", "Quality warning key.1 bad", "Quality warning", "Saved 3", "Pre-dedup: 4", "Translated 5", "Retrying", "retry_after 3", "Error: x", "Starting up", "Stopped by user", "hello"]


@query(f"""with m as (select event_id, ([{quote_list(LOG)}])[event_id % {len(LOG)} + 1] as m from events)
select event_id, case when starts_with(m, 'Quality warning') then coalesce(string_split(m, ' ')[3], 'validate') when regexp_matches(m, '^(Batch failed|Pre-dedup:|Translated )') then 'pipeline' when starts_with(m, 'Saved ') then 'memory'
when regexp_matches(m, '^(Retrying|retry_after)') then 'llm' when starts_with(m, 'Error') then 'error' when regexp_matches(m, '^(Starting|Finished|Stopped) ') then 'worker' else 'app' end as source from m""")
def log_sources(spark: SparkSession, d: str) -> DataFrame:
    m = F.get(F.array(*[F.lit(x) for x in LOG]), (F.col("event_id") % len(LOG)).cast("int"))
    return table(spark, d, "events").select("event_id", X.log_source(m).alias("source"))


@query(f"""with {RESULTS} select ord, case when length(target) <= 40 then target else concat(substr(target, 1, 39), '…') end as preview, regexp_matches(target, '[{X.VIETNAMESE}]') as vietnamese,
case when contains(file, '/data/') then regexp_extract(file, '.*/data/(.*)$', 1) else regexp_extract(file, '([^/]*)$', 1) end as output from r""")
def previews(spark: SparkSession, d: str) -> DataFrame:
    """A short form of every target, whether it looks Vietnamese, and where its file would be written."""
    return lens.results(spark, d).select("ord", X.shortened(F.col("target"), 40).alias("preview"), X.has_vietnamese(F.col("target")).alias("vietnamese"), games.output_path(F.col("file")).alias("output"))


# --- scans ------------------------------------------------------------------------------------------------------------

@query(f"with {ENTRIES} select context, count(*) as entries from e group by 1")
def scan_contexts(spark: SparkSession, d: str) -> DataFrame:
    return results.scan_contexts(lens.entries(spark, d))


@query(f"with {ENTRIES} select file, count(*) as entries, min(ord) as first_ord from e group by 1 order by 2 desc, 3 limit 10")
def scan_top_files(spark: SparkSession, d: str) -> DataFrame:
    return results.top_files(lens.entries(spark, d))


@query("""with l as (select distinct string_split(file, '/')[1] as game, substr(file, length(string_split(file, '/')[1]) + 2) as path from entries where file is not null),
g as (select game, case min(case when regexp_matches(path, '(?i)^data/[^/]*\\.rvdata2$') then 0 when regexp_matches(path, '^(www/)?data/') then 6 end) when 0 then 'vx-ace' when 6 then 'mv-mz' end as engine from l group by game)
select *, case when engine = 'mv-mz' then 'rpg-maker-mz' else 'rpg-maker-mv' end as type from g""")
def engine_detect(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "entries").where("file is not null").select(F.substring_index("file", "/", 1).alias("game"), F.expr("substring(file, length(substring_index(file, '/', 1)) + 2)").alias("path")).distinct()
    return games.detect_engine(f).withColumn("type", C.game_type(F.col("engine")))


@query(f"""with c as (select line_no, unnest([{{'c': 'term', 'v': {strip_sql('term')}}}, {{'c': 'translation', 'v': {strip_sql('translation')}}}, {{'c': 'note', 'v': {strip_sql('note')}}}]) as x from glossary)
select concat('row:', line_no, ':col:', x.c) as key, x.v as source from c where length(x.v) > 1""")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    return text_pairs.cells(table(spark, d, "glossary"), "line_no", ["term", "translation", "note"])


_split = "string_split_regex(regexp_replace(coalesce(text, ''), '^\\x{feff}', ''), '\\r\\n|\\r|\\n')"


@query(f"""with l as (select cast(doc_id as varchar) as file, unnest({_split}) as line, unnest(range(1, len({_split}) + 1)) as n from documents)
select file, concat('line:', n) as key, {strip_sql('line')} as source from l where length({strip_sql('line')}) > 1""")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return text_pairs.line_entries(text_pairs.lines(docs, "text"))


# --- original=translation ---------------------------------------------------------------------------------------------

_first = "concat(regexp_replace(coalesce(source, ''), '[\\r\\n]+', ' ', 'g'), case when ord % 5 = 0 then '' else '=' end, case when ord % 3 = 0 then '' else regexp_replace(coalesce(target, ''), '[\\r\\n]+', ' ', 'g') end)"
PAIR_LINES = f"p0 as (select file, ord as line_no, case when ord % 11 = 0 then concat('#', {_first}) else {_first} end as line from results where file is not null)"
PAIRS = f"""p1 as (select file, line_no, line, {strip_sql('line')} as bare from {{t}}), p as (select file, line_no, {strip_sql("string_split(line, '=')[1]")} as original, {strip_sql("substr(line, length(string_split(line, '=')[1]) + 2)")} as translation
from p1 where bare <> '' and not starts_with(bare, '#') and not starts_with(bare, 'r:') and not starts_with(bare, 'sr:') and contains(line, '='))"""


def _pair_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines made from results: some without a sign of equality, some without a translation, some comments."""
    one = lambda c: F.regexp_replace(X.text(F.col(c)), r"[\r\n]+", " ")
    line = F.concat(one("source"), F.when(F.col("ord") % 5 == 0, "").otherwise("="), F.when(F.col("ord") % 3 == 0, "").otherwise(one("target")))
    return table(spark, d, "results").where("file is not null").select("file", F.col("ord").alias("line_no"), F.when(F.col("ord") % 11 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("line"))


@query(f"with {PAIR_LINES}, {PAIRS.replace('{t}', 'p0')} select * from p where original <> ''")
def pairs_parse(spark: SparkSession, d: str) -> DataFrame:
    return text_pairs.parse_pairs(_pair_lines(spark, d)).select("file", "line_no", "original", "translation")


@query(f"with {PAIR_LINES}, {PAIRS.replace('{t}', 'p0')} select file, original as key, original as source, 'xunity' as context, min(line_no) as ord from p where original <> '' group by file, original")
def pairs_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return text_pairs.pair_entries(_pair_lines(spark, d))


@query(f"""with {PAIR_LINES}, {PAIRS.replace('{t}', 'p0')}, t as (select file, coalesce(source, '') as original, arg_max(target, ord) as target from results where {strip_sql('target')} <> '' and file is not null group by all),
k as (select p.file, p.line_no, concat(p.original, '=', regexp_replace(t.target, '[\\r\\n]+', '\\\\n', 'g')) as line from p join t on t.file = p.file and t.original = p.original where p.original <> '')
select p0.file, p0.line_no, coalesce(k.line, p0.line) as line from p0 left join k using (file, line_no)""")
def pairs_apply(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").where("file is not null").select("file", X.text(F.col("source")).alias("source"), "target", "ord")
    return text_pairs.apply_pairs(_pair_lines(spark, d), r)


# --- trees ------------------------------------------------------------------------------------------------------------

@query()
def tree_extract(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all game files, by the rules of their kinds."""
    e = json_tree.extract(latest_readable(table(spark, d, "game_files")))
    return e.select("file", "key", "source", "context", F.array_join("sub_keys", "\x1f").alias("sub_keys"), "context_text")


@query(f"with {READABLE} select file, case when coalesce(body, '') = '' then 'empty file' else 'invalid JSON' end as warning from d0 where not json_valid(b)")
def tree_warnings(spark: SparkSession, d: str) -> DataFrame:
    return json_tree.warnings(table(spark, d, "game_files"))


VALUE = strip_sql("value")
UI_TEXT = f"length({VALUE}) >= 2 and not starts_with({VALUE}, '$') and not starts_with({VALUE}, '@') and not (starts_with({VALUE}, '#') and length({VALUE}) in (4, 7)) and {VALUE} not in ({quote_list(X.UI_LITERALS)})"


@query(f"""with recursive {TREE} select file, plain as key, value as source, concat('rpg_maker_generic_', lower(regexp_extract(file, '([^/]+)\\.json$', 1))) as context from n
where kind = 'text' and {UI_TEXT} and not list_has_any(keys, [{quote_list(json_tree.UI_SKIP_KEYS)}])""")
def tree_generic(spark: SparkSession, d: str) -> DataFrame:
    nodes = json_tree.text_nodes(latest_readable(table(spark, d, "game_files")), ["file"])
    return json_tree.generic_entries(nodes, F.regexp_extract("file", r"([^/]+)\.json$", 1), ["file"]).select("file", "key", "source", "context")


@query(f"with recursive {TREE} select file, plain as key, value as source from n where kind = 'text' and name <> '' and length({VALUE}) > 1 and not contains(value, '/') and not contains(value, chr(92))")
def tree_plain(spark: SparkSession, d: str) -> DataFrame:
    return json_tree.plain_entries(json_tree.text_nodes(latest_readable(table(spark, d, "game_files")), ["file"]), ["file"]).select("file", "key", "source")


P0 = strip_sql("p.text")
#: commands of event lists, what their speakers, lines and choices say, and the first parts of each list
CONTEXTS = f"""{TREE}, co as (select coalesce(file, chr(0)) as f, plain, type, text from w),
el as (select f, regexp_extract(plain, '^(.*\\.list)\\[\\d+\\]$', 1) as list_path, cast(regexp_extract(plain, '\\[(\\d+)\\]$', 1) as int) as pos, plain as at from co
where regexp_matches(plain, '\\.list\\[\\d+\\]$') and not regexp_matches(regexp_extract(plain, '^(.*\\.list)\\[\\d+\\]$', 1), '\\.list\\[')),
cm as (select el.*, cast(c.text as bigint) as code from el join co c on c.f = el.f and c.plain = concat(el.at, '.code') and c.type in ('UBIGINT', 'BIGINT')),
sa as (select cm.*, s.text as said from cm left join co s on s.f = cm.f and cm.code = 101 and s.plain = concat(cm.at, '.parameters[4]') and s.type = 'VARCHAR' and s.text <> ''),
sp as (select *, last_value(said ignore nulls) over (partition by f, list_path order by pos rows between unbounded preceding and current row) as speaker from sa),
ch as (select f, regexp_extract(plain, '^(.*)\\.parameters\\[0\\]\\[\\d+\\]$', 1) as at, cast(regexp_extract(plain, '\\[(\\d+)\\]$', 1) as int) as i, text from co where type = 'VARCHAR' and regexp_matches(plain, '\\.parameters\\[0\\]\\[\\d+\\]$')),
pa as (select f, list_path, pos, 0 as i, concat('[', said, ']') as part from sp where said is not null
union all select sp.f, list_path, pos, ch.i, ch.text from sp join ch on ch.f = sp.f and ch.at = sp.at where code = 102 and {strip_sql('ch.text')} <> ''
union all select sp.f, list_path, pos, 0, case when speaker is null then p.text else concat('[', speaker, '] ', p.text) end from sp join co p on p.f = sp.f and p.plain = concat(sp.at, '.parameters[0]') and p.type = 'VARCHAR'
where code in (401, 405) and {P0} <> '' and not regexp_matches({P0}, '{X.ONLY_CODES}')),
pf as (select f, list_path, part, min(pos) as pos, arg_min(i, pos * 100000 + i) as i from pa group by all),
pe as (select *, count(*) over (partition by f, list_path order by pos range between unbounded preceding and 1 preceding) as earlier from pf),
bo as (select f, list_path, string_agg(part, chr(10) order by pos, i) as body from pe where earlier < 16 group by all),
li as (select distinct f, list_path, regexp_replace(list_path, '\\.list$', '') as owner from el)"""


@query(f"""with recursive {CONTEXTS} select nullif(li.f, chr(0)) as file, li.list_path, coalesce(concat_ws(chr(10), case when a.text is not null then concat('Actor ', a.text) end, case when n.text <> '' then concat('[Event: ', n.text, ']') end,
case when o.text <> '' then concat('Note: ', o.text) end, nullif(bo.body, '')), '') as context_text from li left join bo on bo.f = li.f and bo.list_path = li.list_path
left join co a on a.f = li.f and a.plain = concat(li.owner, '.conditions.actorId') and a.type in ('UBIGINT', 'BIGINT') and cast(a.text as bigint) > 0
left join co n on n.f = li.f and n.plain = concat(li.owner, '.name') and n.type = 'VARCHAR' left join co o on o.f = li.f and o.plain = concat(li.owner, '.note') and o.type = 'VARCHAR'""")
def tree_contexts(spark: SparkSession, d: str) -> DataFrame:
    return json_tree.list_contexts(json_tree.commands(latest_readable(table(spark, d, "game_files")), ["file"]), ["file"])


@query(f"""with recursive {TREE}, c as (select coalesce(file, chr(0)) as f, regexp_replace(plain, '\\.code$', '') as at from w where text = '357' and regexp_matches(plain, '\\.list\\[\\d+\\]\\.code$')),
a as (select n.file, n.plain as key, n.value as source, c.at, n.name as field, {strip_sql('n.value')} as v from n join c on c.f = coalesce(n.file, chr(0)) and n.plain = concat(c.at, '.parameters[3].', n.name) where n.name <> '' and lower(n.name) not in ({quote_list(json_tree.PLUGIN_SKIP_FIELDS)}))
select a.file, a.key, a.source, concat_ws('_', 'rpg_maker_mz_plugin', coalesce(x.value, ''), coalesce(y.value, ''), a.field) as context from a left join n x on x.file is not distinct from a.file and x.plain = concat(a.at, '.parameters[0]')
left join n y on y.file is not distinct from a.file and y.plain = concat(a.at, '.parameters[1]') where {TRANSLATABLE}""")
def tree_plugin_arguments(spark: SparkSession, d: str) -> DataFrame:
    return json_tree.plugin_argument_entries(json_tree.commands(latest_readable(table(spark, d, "game_files")), ["file"]), ["file"]).select("file", "key", "source", "context")


@query()
def tree_patch(spark: SparkSession, d: str) -> DataFrame:
    """Every text of every file in capitals, put back into the files."""
    files = latest_readable(table(spark, d, "game_files"))
    made = json_tree.extract(files).select("file", "key", F.upper("source").alias("target"), "sub_keys", F.xxhash64("file", "key").alias("ord"))
    return games.patch(files, made).select("file", "applied", "stale", F.md5("body").alias("digest"))


# --- the run ----------------------------------------------------------------------------------------------------------

@query(f"""with {ENTRIES}, d as (select file, key, arg_max(source, ord) as source, arg_max(context, ord) as context from e group by file, key),
o as (select file, key, arg_max(target, ord) as target from r group by file, key), {RESULTS}, {MEMORY},
x as (select d.*, o.target as done from d left join o on o.file is not distinct from d.file and o.key is not distinct from d.key),
y as (select x.*, coalesce(a.target, b.target) as remembered from x left join m a on a.source = x.source and a.context = x.context left join m b on b.source = x.source and b.context = '')
select file, key, case when done is not null and {strip_sql('done')} <> '' then 'done' when remembered is not null then 'memory' else 'provider' end as origin, case when done is not null and {strip_sql('done')} <> '' then done when remembered is not null then remembered end as target from y"""
       .replace("o as (select file, key, arg_max(target, ord) as target from r group by file, key), " + RESULTS, RESULTS + ", o as (select file, key, arg_max(target, ord) as target from r group by file, key)"))
def pipeline_origins(spark: SparkSession, d: str) -> DataFrame:
    """Where the target of every entry comes from, and the target unless a provider made it."""
    out = _run(spark, d)
    return out.select("file", "key", "origin", F.when(F.col("origin") != "provider", F.col("target")).alias("target"))


def _run(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entries").withColumn("context", C.context_name(F.col("context")))
    r = table(spark, d, "results").withColumn("context", C.context_name(F.col("context")))
    options = pipeline.Options("vi", "ja", corrections=RULES, wait=0.0)
    return pipeline.run(e, options, r, table(spark, d, "memory"), pipeline.translate_names(e, options))


@query()
def pipeline_offline(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).select("file", "key", "source", "target", "context", "origin")


@query(f"""with recursive {ENTRIES}, {BATCHES}, i as (select b.file, b.block, b.batch_no, b.ord, concat('{{"id":', to_json(concat_ws(chr(31), e.file, e.key)), case when e.key is null then '' else concat(',"key":', to_json(e.key)) end,
',"source":', to_json(e.source), ',"hint":', to_json({HINT.replace('context', 'e.context')}), '}}') as item from b join e on e.ord = b.ord)
select file, block, batch_no, concat('[', string_agg(item, ',' order by ord), ']') as payload from i group by all""")
def prompt_payload(spark: SparkSession, d: str) -> DataFrame:
    e = lens.entries(spark, d)
    b = batching.char_batches(e).select("ord", "block", "batch_no")
    return provider.payload(e.join(b, "ord"), ["file", "block", "batch_no"])
