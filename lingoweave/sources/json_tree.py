"""Text entries from JSON trees of games: database, system, map, event and interface files.

Trees are read with the structural index of ``operators.nested``; every rule works on flat rows of nodes or commands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_text, is_ui_text, looks_translatable, strip, text
from ..operators.nested import _ARRAY, _OBJECT, _SCALAR_K, _STRING, Index, _pieces
from ..runtime import store

# Text fields of the database files, texts, arrays and terms of the system file.
DATABASE_FIELDS = {
    "Actors": ["name", "nickname", "profile", "note"],
    "Classes": ["name", "note"],
    "Skills": ["name", "description", "message1", "message2", "note"],
    "Items": ["name", "description", "note"],
    "Weapons": ["name", "description", "note"],
    "Armors": ["name", "description", "note"],
    "Enemies": ["name", "note"],
    "States": ["name", "description", "message1", "message2", "message3", "message4", "note"],
    "Animations": ["name"],
    "Tilesets": ["name", "note"],
}
SYSTEM_TEXTS = ["gameTitle", "currencyUnit"]
SYSTEM_ARRAYS = ["armorTypes", "elements", "equipTypes", "skillTypes", "weaponTypes", "switches", "variables"]
TERM_GROUPS = ["basic", "commands", "params", "messages"]
# Members of interface files that hold text, and those below which nothing is text.
UI_KEYS = ["text", "label", "title", "description", "placeholder", "tooltip"]
UI_SKIP_KEYS = [
    "type", "id", "folderName", "imageName", "faceName", "faceIndex", "fillColor", "strokeColor", "textColor", "borderColor", "shadow", "outline", "font", "alignment",
    "verticalCentered", "multiline", "fontSize", "corners", "strokeWidth", "fillAlpha", "borderThickness", "borderOpacity", "backgroundType", "itemsPadding", "maxCols",
    "onPurchaseSE", "onMessageAddedSE", "messageBaseHeight", "messageExtraLineHeightAdd", "playScaleAnimation", "initialScale", "finalScale", "scaleChangeStep",
    "clickAnimation", "showAppContentDelayMS", "scrollVerticalStep", "nextMessageWaitTimeInSeconds",
]
# Arguments of plugin commands that hold no text, by lower-case name.
PLUGIN_SKIP_FIELDS = [
    "filename", "file", "picture", "image", "icon", "bitmap", "se", "bgm", "bgs", "me", "audio", "color", "colour", "tint", "x", "y", "z", "width", "height", "opacity",
    "blend", "duration", "speed", "volume", "pitch", "pan", "id", "code", "indent", "type", "switch", "variable", "actor", "enemy", "troop", "skill", "item", "weapon",
    "armor", "animation", "balloon", "direction", "pattern", "condition", "trigger", "through", "hitboxtype", "hitboxtypetype", "subjecthitboxtype", "targethitboxtype",
    "customhitboxtag", "targetcustomhitboxtag", "enabled", "enableordisable", "showorhide", "wait", "statustype", "hpgauge", "arpgmode", "characterspecification",
    "subjectcharacterspecification", "targetcharacterspecification", "eventspecification", "isskillspecification", "skillobjectposition", "skillspecification",
    "istargetspecification", "rotationdirection", "filterid", "filtertype", "graphic", "layer", "layergraphics", "eventtags", "value", "arg1", "arg2", "arg3", "mode",
    "blendtype", "visible", "hitboxlist", "hitbox", "position", "textsettings", "windowsettings", "backgroundtype", "align", "textpadding", "fontsize", "backopacity",
    "padding", "srceventidorname", "target", "leftuporcenter", "whenfixed", "whenbyvariables", "subject", "targetside", "targetcondition", "targetfiltertype",
    "subjectcondition", "conditiontype", "conditionswitch", "switchno", "switchno2", "variableid", "variablevalue", "targettype", "subjecttype", "forcetype", "shopname",
    "shopid", "stockid", "itemid", "itemid2", "windowbgimage", "buttonbgimage", "buttonfocusimage", "templateid", "positiontype", "darkness", "placeholder", "inputtype",
    "defaultvalue", "tag", "category", "key", "nameid", "animationid", "animationtype", "effecttype", "switchid", "variablenumber", "canceltype", "iniposition",
    "maxcols", "windowwidth", "itemheightadjust", "buttonimageadjustx", "buttonimageadjusty", "iconindex",
]
# Plugins that never show text, and for some commands of others the arguments that do; other arguments of these commands don't.
PLUGINS_WITHOUT_TEXT = ["DirectivityShake", "FilterControllerMZ", "AnimationByPoint", "ITB_DisableKeyInputs", "PictureAnimation"]
PLUGIN_FIELDS = {
    ("NRP_BattleEventEXMZ", "forceSubject"): ["message"],
    ("NRP_BattleEventEXMZ", "setConditionSwitch"): [],
    ("NRP_BattleEventEXMZ", "forceTargetFilter"): [],
    ("NRP_BattleEventEXMZ", "forceAction"): [],
    ("NRP_BattleEventEXMZ", "clearForce"): [],
    ("NRP_BattleEventEXMZ", "setBattleEventEX"): [],
    ("TorigoyaMZ_NotifyMessage", "notify"): ["message"],
    ("LL_GalgeChoiceWindow", "showChoice"): ["choices"],
    ("MNKR_SupponShopStockMZ", "addItem"): [],
    ("MNKR_SupponShopStockMZ", "openShop"): [],
    ("MNKR_SupponShopStockMZ", "closeShop"): [],
    ("MNKR_SupponShopStockMZ", "deleteShop"): [],
    ("MNKR_SupponShopStockMZ", "makeShop"): [],
    ("MPP_MapLight", "setDarkness"): [],
    ("NovelGameUI", "addBackLog"): ["logTexts"],
    ("111_InputForm", "show"): [],
    ("PANDA_ExNumberInput", "SETUP_NUMBER_INPUT_WINDOW"): [],
    ("DTextPicture", "dText"): ["text"],
}

NODE_FIELDS = "path string, parent_path string, name string, holder string, place int, depth int, keys array<string>, value string, event_name boolean, event_note boolean"
COMMAND_FIELDS = "list_path string, pos int, code int, params int, p0 string, p1 string, p4 string, choices array<string>, strings array<string>, args map<string,string>, owner_id boolean, owner_name string, owner_note string, actor_id int"


def text_nodes(df: DataFrame, ids: list[str], body: str = "body") -> DataFrame:
    """(*ids, path, parent_path, name, holder, place, depth, keys, value, event_name, event_note) of every non-blank text.

    ``name`` is the member name ('' in an array), ``holder`` the name of the container, ``keys`` all member names from the root. ``event_name`` and ``event_note``: the
    text stands in an object whose name, or note, is that of an event.
    """
    chosen = df.select(*ids, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _pieces(batches, body):
            index = Index(texts)
            paths = index.chained("$", ".{}".format, "[{}]".format)
            keys = index.chained("", "{}\0".format, lambda _: "")
            at, values = index.written()
            up = index.parent[at]
            numbered = index.having("id", {_SCALAR_K}, r"-?(?:0|[1-9][0-9]*)|true|false")
            listed = index.having("list", {_ARRAY})
            placed = np.any([index.having(n, {_STRING, _SCALAR_K, _OBJECT, _ARRAY}) for n in ("x", "y", "list")], axis=0)
            event = numbered & index.having("pages", {_ARRAY}) & placed
            noted = event | index.having("events", {_STRING, _SCALAR_K, _OBJECT, _ARRAY}) | index.having("data", {_STRING, _SCALAR_K, _OBJECT, _ARRAY})
            above = lambda flags: pa.array(np.where(up >= 0, flags[np.maximum(up, 0)], False) if len(flags) else np.zeros(0, bool))
            split = pc.split_pattern(keys.take(pa.array(at)), "\0")
            parent = pc.if_else(pa.array(up >= 0), paths.take(pa.array(np.maximum(up, 0))), "$") if len(paths) else paths
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c).take(pa.array(index.doc[at], pa.int64())) for c in ids], paths.take(pa.array(at)), parent, index.member_names(at), index.member_names(up),
                 pa.array(index.place[at], pa.int32()), pa.array(index.level[at], pa.int32()), split.cast(pa.list_(pa.string())), values, above(numbered & (event | listed)), above(noted)],
                names=[*ids, *[f.split()[0] for f in NODE_FIELDS.split(", ")]])

    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in ids)
    # each name ends in a mark, so that the last piece is empty
    return chosen.mapInArrow(run, f"{schema}, {NODE_FIELDS}").withColumn("keys", F.slice("keys", F.lit(1), F.greatest(F.size("keys") - 1, F.lit(0))))


def commands(df: DataFrame, ids: list[str], body: str = "body") -> DataFrame:
    """One row per element of every array called ``list``, in order; elements that are no objects have a null code.

    ``strings`` are the string parameters by place (null for others), ``choices`` the strings of a first parameter that is a list, ``args`` those of a fourth that is an object;
    ``owner_*`` describe the object that holds the list.
    """
    chosen = df.select(*ids, body)
    names = [f.split()[0] for f in COMMAND_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _pieces(batches, body):
            out: list[tuple] = []
            good = Index(texts).valid
            for doc, raw in enumerate(texts):
                if good[doc] and b'"list"' in raw:
                    out += [(doc, *x) for x in _lists(json.loads(raw.decode("utf-8", "replace").strip("﻿ \t\r\n")), "$")]
            cols = list(zip(*out)) if out else [[]] * (len(names) + 1)
            s, i, b, a = pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string())
            kinds = [s, i, i, i, s, s, s, a, a, pa.map_(s, s), b, s, s, i]
            yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(cols[0], pa.int64())) for c in ids], *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]], names=[*ids, *names])

    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in ids)
    return chosen.mapInArrow(run, f"{schema}, {COMMAND_FIELDS}")


def _lists(root: object, path: str) -> Iterator[tuple]:
    """Rows of the lists below a value; a stack instead of recursion, for trees of any depth."""
    def s(x: object) -> str | None:
        return x.encode("utf-8", "replace").decode() if isinstance(x, str) else None

    stack = [(root, path)]
    while stack:
        value, at = stack.pop()
        if isinstance(value, dict):
            for k, child in value.items():
                if k == "list" and isinstance(child, list):
                    cond = value.get("conditions")
                    actor = cond.get("actorId") if isinstance(cond, dict) else None
                    owner = (isinstance(value.get("id"), int), s(value.get("name")), s(value.get("note")), actor if isinstance(actor, int) and 0 < actor < 1 << 31 else None)
                    for pos, cmd in enumerate(child):
                        code = cmd.get("code") if isinstance(cmd, dict) else None
                        p = cmd.get("parameters") if isinstance(cmd, dict) else None
                        p = p if isinstance(p, list) else None
                        strings = [s(x) for x in p] if p is not None else None
                        get = lambda n: strings[n] if strings and n < len(strings) else None  # noqa: E731, B023
                        choices = [s(x) for x in p[0]] if p and isinstance(p[0], list) else None
                        args = [(s(a), s(b)) for a, b in p[3].items() if isinstance(b, str)] if p and len(p) > 3 and isinstance(p[3], dict) else None
                        yield (f"{at}.list", pos, code if isinstance(code, int) and abs(code) < 1 << 31 else None, len(p) if p is not None else None, get(0), get(1), get(4), choices, strings, args, *owner)
                else:
                    stack.append((child, f"{at}.{k}"))
        elif isinstance(value, list):
            stack += [(child, f"{at}[{i}]") for i, child in enumerate(value)]


def _entry(key: Column, source: Column, context: Column | str, sub_keys: Column | None = None) -> list[Column]:
    return [key.alias("key"), source.alias("source"), (F.lit(context) if isinstance(context, str) else context).alias("context"),
            (sub_keys if sub_keys is not None else F.array().cast("array<string>")).alias("sub_keys")]


def _below_no_text() -> Column:
    """No member on the way down is one of those below which nothing is text."""
    return ~F.arrays_overlap("keys", F.array(*[F.lit(k) for k in UI_SKIP_KEYS]))


def generic_text() -> Column:
    """Whether a text of an unknown file counts: one that an interface could show, but below members that never hold text."""
    return _below_no_text() & is_ui_text(F.col("value"))


def interface_context(folder: Column) -> Column:
    """Context of a text of a plugin's interface file, null for what is none: members with a text name and texts in a list called ``text`` by their folder, texts in other
    lists as ``custom``. Nothing below the other elements of a list called ``text`` counts."""
    in_text_list = (F.col("name") == "") & (F.col("holder") == "text")
    member = F.col("name").isin(UI_KEYS)
    below = F.col("path").rlike(r"\.text\[\d+\][.\[]")
    return F.when(_below_no_text() & ~below & is_ui_text(F.col("value")),
                  F.when(member | in_text_list, F.concat(F.lit("rpg_maker_plugin_ui_"), folder)).when(F.col("name") == "", "rpg_maker_plugin_ui_custom"))


def generic_entries(nodes: DataFrame, stem: Column, ids: list[str]) -> DataFrame:
    """Every text of an unknown file that could be read in an interface, but below keys that never hold text."""
    return nodes.where(generic_text()).select(*ids, *_entry(F.col("path"), F.col("value"), F.concat(F.lit("rpg_maker_generic_"), F.lower(stem))))


def interface_entries(nodes: DataFrame, folder: Column, ids: list[str]) -> DataFrame:
    """Texts of plugin interfaces."""
    return nodes.withColumn("_c", interface_context(folder)).where("_c is not null").select(*ids, *_entry(F.col("path"), F.col("value"), F.col("_c")))


def plain_entries(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Members (not elements of arrays) with texts of more than one sign and without slashes, as in other games' files."""
    hit = (F.col("name") != "") & (F.length(strip(F.col("value"))) > 1) & ~F.col("value").rlike(r"[/\\]")
    return nodes.where(hit).select(*ids, *_entry(F.col("path"), F.col("value"), "unity_json"))


# --- events -----------------------------------------------------------------------------------------------------------

def _runs(c: DataFrame, ids: list[str]) -> DataFrame:
    """The commands with their text, and ``island``: the number of the block of dialogue, comment or script they belong to.

    A dialogue block is a speaker row and the text rows right behind it, up to the first row that is none; comments and scripts run over rows of their own kind, blank ones in between
    don't end them.
    """
    w = Window.partitionBy(*ids, "list_path").orderBy("pos")
    kind = (F.when((F.col("code") == 101) & F.col("params").isNotNull(), "start").when(F.col("code").isin(401, 405), "line").when(F.col("code").isin(108, 408), "comment").when(F.col("code").isin(355, 655), "script"))
    c = c.where("code is not null").withColumn("kind", kind).withColumn("txt", F.when(is_text(F.col("p0")), F.col("p0")))
    before = F.lag("kind").over(w)
    c = c.withColumn("before", before).withColumn("line_ok", (F.col("kind") == "line") & F.col("txt").isNotNull())
    breaks = F.when(F.col("kind") == "start", 1).when(F.col("line_ok"), 0).when(F.col("kind").isin("comment", "script") & (F.col("before") == F.col("kind")), 0).otherwise(1)
    c = c.withColumn("breaks", breaks)
    c = c.withColumn("island", F.sum("breaks").over(w))
    # what opens the island decides what a line in it is
    opener = F.first("kind").over(Window.partitionBy(*ids, "list_path", "island").orderBy("pos"))
    return c.withColumn("opener", opener)


def dialogue_entries(cmds: DataFrame, ids: list[str]) -> DataFrame:
    """Entries of event commands: speakers, dialogue blocks, lone lines, comments, scripts, choices, plugin commands and changes of actors.

    A block of several rows is one entry with the key of its first row and all keys in ``sub_keys``. Blocks are as long as what people wrote between two speakers, so their rows are gathered.
    """
    c = _runs(cmds, ids)
    at = F.concat(F.col("list_path"), F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    key = F.concat(at, F.lit(".parameters[0]"))
    grouped = c.where((F.col("line_ok") & (F.col("opener") == "start")) | (F.col("kind").isin("comment", "script") & F.col("txt").isNotNull()))
    rows = F.array_sort(F.collect_list(F.struct("pos", "txt", key.alias("k"))))
    blocks = grouped.groupBy(*ids, "list_path", "island", "opener").agg(rows.alias("r"))
    context = F.when(F.col("opener") == "start", "rpg_maker_event_text").when(F.col("opener") == "comment", "rpg_maker_comment").otherwise("rpg_maker_script")
    out = blocks.select(*ids, *_entry(F.col("r")[0]["k"], F.array_join(F.transform("r", lambda x: x.txt), "\n"), context, F.when(F.size("r") > 1, F.transform("r", lambda x: x.k)).otherwise(F.array().cast("array<string>"))))
    # everything that comes from one command by itself
    def one(test: Column, k: Column, v: Column, ctx: Column | str) -> Column:
        return F.when(test, F.struct(k.alias("k"), v.alias("v"), (F.lit(ctx) if isinstance(ctx, str) else ctx).alias("c")))

    def many(test: Column, values: Column, place: str, ctx: str) -> Column:
        found = F.transform(values, lambda v, i: one(is_text(v), F.concat(at, F.lit(place), i.cast("string"), F.lit("]")), v, ctx))
        return F.when(test & values.isNotNull(), found)

    changes = F.when(F.col("code") == 320, "rpg_maker_actors_name").when(F.col("code") == 324, "rpg_maker_actors_nickname").otherwise("rpg_maker_actors_profile")
    singles = F.array(
        one(F.col("line_ok") & (F.col("opener") != "start"), key, F.col("txt"), "rpg_maker_event_text"),
        one((F.col("kind") == "start") & (F.col("params") >= 5) & is_text(F.col("p4")), F.concat(at, F.lit(".parameters[4]")), F.col("p4"), "rpg_maker_speaker_name"),
        one((F.col("code") == 356) & F.col("txt").isNotNull(), key, F.col("txt"), "rpg_maker_plugin_command"),
        one(F.col("code").isin(320, 324, 325) & is_text(F.col("p1")), F.concat(at, F.lit(".parameters[1]")), F.col("p1"), changes))
    lists = F.coalesce(many(F.col("code") == 357, F.col("strings"), ".parameters[", "rpg_maker_plugin_command"), many(F.col("code") == 102, F.col("choices"), ".parameters[0][", "rpg_maker_choice"))
    every = F.filter(F.when(lists.isNull(), singles).otherwise(F.concat(singles, lists)), lambda x: x.isNotNull())
    rowwise = c.select(*ids, F.explode(every).alias("x"))
    return out.unionByName(rowwise.select(*ids, *_entry(F.col("x.k"), F.col("x.v"), F.col("x.c"))))


def plugin_argument_entries(cmds: DataFrame, ids: list[str]) -> DataFrame:
    """Arguments of plugin commands that read like text (the other reading of command 357, by field).

    Some plugins never show text, of some commands only certain arguments do; arguments of certain names never do.
    """
    at = F.concat(F.col("list_path"), F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    each = cmds.where("code = 357 and args is not null").select(*ids, at.alias("at"), text(F.col("p0")).alias("plugin"), text(F.col("p1")).alias("command"), F.explode("args").alias("field", "v"))
    shown = F.create_map(*[x for (p, c), f in PLUGIN_FIELDS.items() for x in (F.lit(f"{p}\x1f{c}"), F.array(*map(F.lit, f)).cast("array<string>"))])
    only = F.try_element_at(shown, F.concat_ws("\x1f", "plugin", "command"))
    keep = ~F.col("plugin").isin(PLUGINS_WITHOUT_TEXT) & ~F.lower("field").isin(PLUGIN_SKIP_FIELDS) & (only.isNull() | F.array_contains(only, F.col("field")))
    return each.where(keep & looks_translatable(F.col("v"))).select(
        *ids, *_entry(F.concat(F.col("at"), F.lit(".parameters[3]."), F.col("field")), F.col("v"), F.concat_ws("_", F.lit("rpg_maker_mz_plugin"), "plugin", "command", "field")))


def list_contexts(cmds: DataFrame, ids: list[str], most: int = 16) -> DataFrame:
    """(*ids, list_path, context_text): event, note, actor and the first distinct parts of each list: speakers, choices and lines with the speaker who is talking."""
    w = Window.partitionBy(*ids, "list_path").orderBy("pos")
    said = F.when((F.col("code") == 101) & (F.col("params") >= 5) & (text(F.col("p4")) != ""), F.col("p4"))
    c = cmds.where("code is not null").withColumn("speaker", F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.when(F.col("code").isin(401, 405) & is_text(F.col("p0")), F.when(F.col("speaker").isNotNull(), F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.col("p0"))).otherwise(F.col("p0")))
    parts = (F.when(said.isNotNull(), F.array(F.concat(F.lit("["), said, F.lit("]")))).when((F.col("code") == 102) & F.col("choices").isNotNull(), F.filter("choices", lambda x: x.isNotNull() & (strip(x) != "")))
             .when(line.isNotNull(), F.array(line)))
    each = c.select(*ids, "list_path", "pos", F.posexplode(parts).alias("i", "part")).groupBy(*ids, "list_path", "part").agg(F.min(F.struct("pos", "i")).alias("o"))
    # A part counts if fewer than the limit came with earlier commands: a list of choices may go beyond it as a whole.
    by = Window.partitionBy(*ids, "list_path")
    each = each.withColumn("earlier", F.count(F.lit(1)).over(by.orderBy(F.col("o.pos")).rangeBetween(Window.unboundedPreceding, -1)))
    body = each.where(F.col("earlier") < most).groupBy(*ids, "list_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "part"))), lambda x: x.part), "\n").alias("body"))
    head = cmds.groupBy(*ids, "list_path").agg(F.first("owner_name").alias("n"), F.first("owner_note").alias("t"), F.first("actor_id").alias("a"))
    j = head.join(body, [*ids, "list_path"], "left")
    lines = F.filter(F.array(F.when(F.col("a").isNotNull(), F.concat(F.lit("Actor "), F.col("a").cast("string"))), F.when(text(F.col("n")) != "", F.concat(F.lit("[Event: "), F.col("n"), F.lit("]"))),
                             F.when(text(F.col("t")) != "", F.concat(F.lit("Note: "), F.col("t"))), F.when(text(F.col("body")) != "", F.col("body"))), lambda x: x.isNotNull())
    return j.select(*ids, "list_path", F.array_join(lines, "\n").alias("context_text"))


def extract(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """(file, key, source, context, sub_keys, context_text) of all texts of JSON files, by the rule of each file's name; a number behind the name does not count.

    Files right below the data folder: database, system, map and event files by their rules, all others every text that could be shown. Files in folders below it: the rules of interfaces,
    those named like database or event files give nothing. Unreadable files give nothing; see ``warnings``. Plugin lists are read by ``sources.games.plugin_parameters``.
    """
    ids = [file]
    known = [*DATABASE_FIELDS, "System", "CommonEvents", "Troops"]
    below = F.col(file).rlike(r"(?:^|[/\\])data[/\\][^/\\]+[/\\].*\.json$")
    whole = F.regexp_extract(F.col(file), r"([^/\\]*)\.json$", 1)
    stem = F.regexp_extract(whole, r"^(.*?)\d*$", 1)
    folder = F.regexp_extract(F.col(file), r"([^/\\]+)[/\\][^/\\]+$", 1)
    # one pass over the nodes: the first rule that holds names the context
    n = text_nodes(files, ids, body).withColumn("_stem", stem)
    up, name, value, s = F.col("parent_path"), F.col("name"), F.col("value"), F.col("_stem")
    fields = F.try_element_at(F.create_map(*[x for f, names in DATABASE_FIELDS.items() for x in (F.lit(f), F.array(*map(F.lit, names)))]), s)
    element = up.rlike(r"^\$\[\d+\]$")
    prefix = F.lit("rpg_maker_")
    is_event = (s.startswith("Map") & (s != "MapInfos")) | s.isin("CommonEvents", "Troops")
    shown = is_text(value)
    outside = ~F.col("path").rlike(r"\.list\[")  # commands have rules of their own
    context = (
        F.when(below, F.when(~(s.isin(known) | s.startswith("Map")), interface_context(folder)))
        .when(s.isin(list(DATABASE_FIELDS)), F.when(shown & F.array_contains(fields, name) & (element | (up == "$")), F.concat(prefix, F.lower(s), F.lit("_"), name)))
        .when(s == "System", F.when(shown & (up == "$") & name.isin(SYSTEM_TEXTS), F.concat(prefix, F.lit("system_"), name))
              .when(shown & (name == "") & (F.size("keys") == 1) & F.col("holder").isin(SYSTEM_ARRAYS) & (F.col("depth") == 2), F.concat(prefix, F.lit("system_"), F.col("holder")))
              .when(shown & (F.get("keys", F.lit(0)) == "terms") & F.get("keys", F.lit(1)).isin(TERM_GROUPS), F.concat(prefix, F.array_join("keys", "_"))))
        .when(s == "MapInfos", F.when(shown & (name == "name") & element, "rpg_maker_map_name"))
        .when(is_event, F.when(shown & outside, F.when(name == "displayName", "rpg_maker_map_display_name").when((name == "name") & F.col("event_name"), "rpg_maker_event_name")
              .when((name == "note") & F.col("event_note"), "rpg_maker_note").when((s == "Troops") & (name == "name") & element, "rpg_maker_troops_name")))
        .when(generic_text(), F.concat(F.lit("rpg_maker_generic_"), F.lower(whole))))
    out = n.withColumn("_c", context).where("_c is not null").select(*ids, *_entry(F.col("path"), value, F.col("_c"))).withColumn("context_text", F.lit(""))
    cmds = store(commands(files.withColumn("_stem", stem).where(~below & is_event), ids, body), "commands")
    events = dialogue_entries(cmds, ids)
    contexts = list_contexts(cmds, ids)
    events = events.withColumn("list_path", F.regexp_extract("key", r"^(.*\.list)\[\d+\]\.parameters", 1)).join(contexts, [*ids, "list_path"], "left")
    return out.unionByName(events.select(*ids, "key", "source", "context", "sub_keys", text(F.col("context_text")).alias("context_text")))


def warnings(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """(file, warning) of files whose body is no JSON."""
    from ..operators.nested import mark_readable

    return mark_readable(files.select(file, body), body).where("not readable").select(file, F.when(text(F.col(body)) == "", "empty file").otherwise("invalid JSON").alias("warning"))
