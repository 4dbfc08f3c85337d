"""Text functions as column expressions: predicates, control codes, repairs, warnings.

All regular expressions live here. Blank means: only white space in the sense of ``SPACE``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contexts import DESCRIPTION_CONTEXTS, SHORT_CONTEXTS

# Patterns of the texts' syntax.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}]"
CJK_RATIO = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}]"
CODE = r"\\F[A-Za-z]*\[[^\]]*\]|\\OC\[\d+\]|\\OO\[\d+\]|\\FS\[\d+\]|\\[A-Za-z]+\[[^\]]*\]|\\[A-Za-z]+|\\[{}.$!><^_\\]|%\d+|%[sdfox]|\{[^{}]{1,80}\}|\[[A-Za-z0-9_]+\]|\$[A-Za-z0-9_]+"
TAG = r"<[^<>]{1,120}>"
NAMEBOX = r"^((?:\\[A-Za-z]+\[[^\]]*\]|\\[A-Za-z]+|\\[{}.$!><^_\\]|\s)*)<((?:\\[A-Za-z]+\[[^\]]*\]|\\[A-Za-z]+|\\[{}.$!><^_\\]|[^<>]){1,80})>"
CONTROL_CODE = r"\\[A-Za-z]+\[[^\]]+\]|\\[{}.$!><^_]|\|\*"
ONLY_CODES = r"^(?:[\s\\]*(?:\\F[A-Za-z]*\[[^\]]*\]|\\OC\[\d+\]|\\OO\[\d+\]|\\FS\[\d+\]|\\[A-Za-z]+\[[^\]]*\]|\\[{}.$!><^_\\]|%\d+))*[\s\\]*$"
FORMAT = r"%[sdfox]"
SPACED_TOKENS = [(r"\\(\w+)\s*\[\s*(.*?)\s*\]", r"\\$1[$2]"), (r"\\(\w+)\s*<\s*(.*?)\s*>", r"\\$1<$2>"), (r"%\s*(\d+)", "%$1"), (r"\\\s*([{}$!><^_\\])", r"\\$1")]
UI_LITERALS = ["true", "false", "center", "left", "right", "top", "bottom"]
ENUM_VALUES = ["true", "false", "hp", "mp", "tp", "attack", "damage", "custom", "normal", "left", "right", "up", "down", "center", "none", "auto", "on", "off",
               "all", "self", "target", "subject", "opponents", "opponentsunit", "actors", "actorsunit", "friend", "friendunit"]
ASSET = r"(?i)\.(png|jpg|jpeg|gif|bmp|ogg|mp3|wav|m4a|flac|json|js|csv|txt|xml|html)$"
LETTER = r"[A-Za-z\x{3040}-\x{9fff}\x{ac00}-\x{d7ff}]"
INTERNAL = r"(?i)^(?:subject|opponents|self|target|friend|actors|none|auto|normal|custom|left|right|up|down|center|all)(?:\s*#.*)?$"
CODE_LIKE = (r"\$game[A-Z]|a\.|b\.|this\.|Math\.|JSON\.|console\.|function\s*\(|=>|\.isState|\.isActor|\.isEnemy|\.index\(\)|\.hp\s|\.mp\s|\.tp\s|\.value\(\)|\.gainHp|\.gainMp|\.addItem|"
             r"\.removeItem|DataManager|SceneManager|BattleManager|Game_|AudioManager|isNaN\(|typeof\s|instanceof\s|\.length\s*[<>=]|===|!==")


def text(c: Column) -> Column:
    """Null as ''."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    return strip(c) == ""


def is_text(c: Column) -> Column:
    """Something besides white space, control codes and backslashes."""
    return ~blank(c) & ~strip(c).rlike(ONLY_CODES)


def has_cjk(c: Column) -> Column:
    return text(c).rlike(CJK)


def needs_retry(source: Column, target: Column) -> Column:
    """Blank, the same as the source, or with signs of Chinese, Japanese or Korean left."""
    return blank(target) | (text(target) == text(source)) | has_cjk(target)


def is_ui_text(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) >= 2) & ~t.startswith("$") & ~t.startswith("@") & ~(t.startswith("#") & F.length(t).isin(4, 7)) & ~t.isin(UI_LITERALS)


def looks_translatable(c: Column) -> Column:
    """Whether a plugin's value reads like text for people: no number, colour, file, constant, code or identifier."""
    v = strip(c)
    bare = strip(F.regexp_replace(v, r"\s*#[^\n]+$", ""))
    name = v.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & (F.length(v) <= 32) & v.rlike(r"[a-z][A-Z]|_")
    path = v.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(/[A-Za-z_][A-Za-z0-9_]*)*$") & (F.length(v) <= 40) & (v.rlike("[_/]") | ~v.rlike("[A-Z]") & v.rlike("[a-z]"))
    wrapped = (v.startswith("[") & v.endswith("]")) | (v.startswith("{") & v.endswith("}")) | (v.startswith('"') & v.endswith('"') & (F.length(v) <= 40))
    return ((F.length(v) >= 2) & ~v.rlike("^#[0-9a-fA-F]{3,8}$") & ~v.rlike(r"^-?\d+(\.\d+)?$") & ~v.rlike(ASSET) & v.rlike(LETTER) & ~bare.rlike(INTERNAL)
            & ~F.lower(v).isin(ENUM_VALUES) & ~bare.rlike(CODE_LIKE) & ~wrapped & ~name & ~path)


def source_language(c: Column) -> Column:
    """ja, ko or zh by the first script found, in this order; null for other texts."""
    return F.when(text(c).rlike(r"[\x{3040}-\x{30ff}]"), "ja").when(text(c).rlike(r"[\x{ac00}-\x{d7af}]"), "ko").when(text(c).rlike(r"[\x{4e00}-\x{9fff}]"), "zh")


def shortened(c: Column, most: int) -> Column:
    """At most ``most`` signs, the last of them an ellipsis where something was cut."""
    return F.when(F.length(text(c)) <= most, text(c)).otherwise(F.concat(F.substring(text(c), 1, most - 1), F.lit("…")))


#: letters that of the languages at hand only Vietnamese has, or shares with few
VIETNAMESE = "đĐưƯơƠêÊôÔăĂâÂàÀáÁảẢãÃạẠèÈéÉẻẺẽẼẹẸìÌíÍỉỈĩĨịỊòÒóÓỏỎõÕọỌùÙúÚủỦũŨụỤýÝỷỶỹỸỵỴ"


def has_vietnamese(c: Column) -> Column:
    return text(c).rlike(f"[{VIETNAMESE}]")


def log_source(message: Column) -> Column:
    """Which part of the program a log line comes from, by how it begins."""
    m = text(message)
    third = F.get(F.split(m, " "), F.lit(2))
    return (F.when(m.startswith("Quality warning"), F.coalesce(third, F.lit("validate"))).when(m.rlike("^(Batch failed|Pre-dedup:|Translated )"), "pipeline").when(m.startswith("Saved "), "memory")
            .when(m.rlike("^(Retrying|retry_after)"), "llm").when(m.startswith("Error"), "error").when(m.rlike("^(Starting|Finished|Stopped) "), "worker").otherwise("app"))


# --- protected tokens -------------------------------------------------------------------------------------------------

def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def _number(i: Column) -> Column:
    return F.concat(F.lit("ZXQ"), F.lpad(i.cast("string"), 4, "0"), F.lit("QXZ"))


def _masked(c: Column, pattern: str, first: Column) -> tuple[Column, Column]:
    """The text with the k-th match replaced by token number first + k, and the matches."""
    found, between = _all(c, pattern), F.split(c, pattern, -1)
    joined = F.array_join(F.transform(between, lambda x, i: F.when(i < F.size(found), F.concat(x, _number(first + i))).otherwise(x)), "")
    return joined, found


def mask(c: Column) -> Column:
    """STRUCT<masked, tokens>: control codes and tags replaced by numbered tokens; the name in a name box stays visible."""
    c = text(c)
    box = F.regexp_extract(c, NAMEBOX, 0)
    rest = F.substring(c, F.length(box) + 1, F.length(c))
    zero = F.lit(0)
    head, t1 = _masked(box, CODE, zero)
    body, t2 = _masked(rest, CODE, F.size(t1))
    body, t3 = _masked(body, TAG, F.size(t1) + F.size(t2))
    return F.struct(F.concat(head, body).alias("masked"), F.concat(t1, t2, t3).alias("tokens"))


def unmask(masked: Column, tokens: Column) -> Column:
    """The tokens' originals put back, also where a token came back in lower case.

    Last token first, since a tag may hold tokens itself.
    """
    at = F.sequence(F.size(tokens), F.lit(1), F.lit(-1))
    steps = F.when(F.size(tokens) > 0, F.transform(at, lambda k: F.struct(_number(k - 1).alias("n"), F.element_at(tokens, k).alias("t")))).otherwise(F.array().cast("array<struct<n:string,t:string>>"))
    return F.aggregate(steps, masked, lambda a, s: F.replace(F.replace(a, s.n, s.t), F.lower(s.n), s.t))


def fix_token_spacing(c: Column) -> Column:
    """Blanks inside control codes removed, as in ``\\N [1]`` or ``% 1``."""
    c = text(c)
    for pattern, into in SPACED_TOKENS:
        c = F.regexp_replace(c, f"(?U){pattern}", into)
    return c


# --- name boxes -------------------------------------------------------------------------------------------------------

def box(c: Column, group: int = 0) -> Column:
    return F.regexp_extract(text(c), NAMEBOX, group)


def box_name(c: Column) -> Column:
    """The name in the box without codes, '' without a box."""
    return strip(F.regexp_replace(box(c, 2), CODE, ""))


def restore_box(source: Column, target: Column) -> Column:
    """The source's box put before a target that lost it; codes lost from inside the target's box put back before the name."""
    source, target = text(source), text(target)
    codes = F.array_join(_all(box(source, 2), CODE), "")
    lost = (codes != "") & ~box(target, 2).rlike(CODE)
    rebuilt = F.concat(box(target, 1), F.lit("<"), codes, box(target, 2), F.lit(">"), F.substring(target, F.length(box(target)) + 1, F.length(target)))
    return (F.when(box(source) == "", target).when(box(target) == "", F.concat(box(source), F.regexp_replace(target, f"^{SPACE}+", "")))
            .when(lost, rebuilt).otherwise(target))


def replace_box_name(source: Column, target: Column, translation: Column) -> Column:
    """The translated name put into a target that still has the source's name; rows that fell back to the source stay as they are."""
    source, target = text(source), text(target)
    name = box_name(source)
    same = (target != source) & (box(target) != "") & (box_name(target) == name) & has_cjk(name) & (text(translation) != "")
    swapped = F.concat(box(target, 1), F.lit("<"), F.replace(box(target, 2), name, text(translation)), F.lit(">"), F.substring(target, F.length(box(target)) + 1, F.length(target)))
    return F.when(same, swapped).otherwise(target)


def postprocess(source: Column, target: Column) -> Column:
    return restore_box(source, fix_token_spacing(target))


# --- repairs ----------------------------------------------------------------------------------------------------------

def _append_missing(start: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, start, lambda a, t: F.when(F.contains(a, t), a).otherwise(F.concat(a, t)))


def repair_syntax(source: Column, target: Column) -> Column:
    """Control codes and format marks of the source that the target lacks, appended; blank and untranslated targets stay."""
    s, t = text(source), text(target)
    return F.when(blank(t) | (t == s), t).otherwise(_append_missing(_append_missing(t, _all(s, CONTROL_CODE)), _all(s, FORMAT)))


def corrected(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements; a rule of ASCII letters and digits needs a word's borders. The replacement is literal, also where it has ``\\`` or ``$``."""
    c = text(c)
    for find, into in rules:
        if find.isascii() and find.isalnum():
            c = F.regexp_replace(c, rf"(?<![A-Za-z0-9_])\Q{find}\E(?![A-Za-z0-9_])", into.replace("\\", "\\\\").replace("$", "\\$"))
        elif find:
            c = F.replace(c, F.lit(find), F.lit(into))
    return c


def replaced(c: Column, find: str, into: str, ignore_case: bool = False) -> Column:
    """Literal search and replace."""
    if not find:
        return text(c)
    if not ignore_case:
        return F.replace(text(c), F.lit(find), F.lit(into))
    return F.regexp_replace(text(c), "(?iu)" + re.escape(find), into.replace("\\", "\\\\").replace("$", "\\$"))


def repair_latin1(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; anything that is no such text stays."""
    raw = F.encode(F.when(text(c).rlike(r"^[\x00-\xff]*$"), text(c)).otherwise(F.lit("")), "ISO-8859-1")
    garbled = text(c).rlike(r"[\xc2-\xf4][\x80-\xbf]") & F.is_valid_utf8(raw.cast("string"))
    return F.when(garbled, raw.cast("string")).otherwise(text(c))


def repair_escapes(c: Column) -> Column:
    """Backslashes that start no JSON escape doubled."""
    return F.regexp_replace(text(c), r'\\(?!["\\/bfnrtu])', r"\\\\")


def strip_fence(c: Column) -> Column:
    """A code fence and its language tag removed."""
    t = strip(c)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z0-9_-]*", ""), r"```$", ""))).otherwise(t)


# --- warnings ---------------------------------------------------------------------------------------------------------

def quoted(token: Column) -> Column:
    """A token in quotes as a literal: single quotes, backslashes doubled, line breaks as \\n."""
    inner = F.replace(F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = F.contains(token, F.lit("'")) & ~F.contains(token, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))


def missing_codes(source: Column, target: Column) -> Column:
    """Distinct control codes of the source, sorted, that the target lacks."""
    return F.filter(F.array_sort(F.array_distinct(_all(text(source), CONTROL_CODE))), lambda t: ~F.contains(text(target), t))


def cjk_share(c: Column) -> Column:
    n = F.length(F.regexp_replace(text(c), CJK_RATIO[:1] + "^" + CJK_RATIO[1:], ""))
    return n / F.greatest(F.length(text(c)), F.lit(1))


def warnings(source: Column, target: Column, context: Column) -> Column:
    """ARRAY of warnings about a translation, in a fixed order; none for blank and untranslated targets."""
    s, t = text(source), text(target)
    n, m = F.length(s), F.length(t)
    share = cjk_share(s)
    rest = F.concat(box(s, 1), F.substring(s, F.length(box(s)) + 1, n))  # the box itself is no placeholder
    lacking = F.filter(_all(F.when(box(s) == "", s).otherwise(rest), f"{CODE}|{TAG}"), lambda x: ~F.contains(t, x))
    lines = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    lines_t = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    short_limit = F.when(share >= 0.5, 4.0).otherwise(2.5)
    body_limit = F.when((share >= 0.5) & (n <= 10), 8.0).otherwise(3.0)
    size = F.concat(F.lit("("), n.cast("string"), F.lit("→"), m.cast("string"), F.lit(" chars, max "))
    length = (
        F.when(context.isin(SHORT_CONTEXTS), F.when((m > n * short_limit) & (n < 60), F.concat(F.lit("name/UI label too long "), size, F.when(share >= 0.5, "4").otherwise("2.5"), F.lit("x for context '"), context, F.lit("')"))))
        .when(context.isin(DESCRIPTION_CONTEXTS), F.when((m > n * 4) & (n < 120), F.concat(F.lit("description too long "), size, F.lit("4x for context '"), context, F.lit("')"))))
        .when((share >= 0.5) & (n <= 6), F.lit(None))
        .otherwise(F.when((m > n * body_limit) & (n < 120), F.lit("translation much longer than source (possible UI overflow)"))))
    parts = F.flatten(F.array(
        F.array(F.when(has_cjk(t), "target contains CJK characters (possible partial translation)")),
        F.transform(lacking, lambda x: F.concat(F.lit("missing placeholder "), quoted(x))),
        F.array(F.when((box(s) != "") & (box(t) == ""), "missing YEP_MessageCore namebox prefix")),
        F.transform(missing_codes(s, t), lambda x: F.concat(F.lit("missing control code "), quoted(x))),
        F.array(F.when((context == "rpg_maker_script") & F.contains(t, F.lit("\n")), "script string contains newline"),
                F.when((box_name(s) != "") & (box_name(s) == box_name(t)) & has_cjk(box_name(s)), "namebox speaker name was not translated"),
                F.when((lines > 0) & (lines != lines_t), F.concat(F.lit("newline count mismatch ("), lines.cast("string"), F.lit(" vs "), lines_t.cast("string"), F.lit(")"))),
                length)))
    none = F.array().cast("array<string>")
    return F.when(blank(t) | (t == s), none).otherwise(F.filter(parts, lambda x: x.isNotNull()))


# --- provider errors --------------------------------------------------------------------------------------------------

# What providers' messages contain.
REFUSALS = ["我无法", "我不能", "无法给", "i cannot", "i'm unable", "i am unable", "i can't", "i apologize", "content policy", "violates", "against my", "as an ai", "as a language model",
            "thinking about your request", "processing your request", "let me think", "let me process"]
RETRY_AFTER = [(["524"], 60.0), (["429"], 10.0), (["503", "502", "500"], 5.0), (["timeout", "timed out", "connection", "truncated"], 15.0), (["not valid json", "expecting value"], 5.0),
               (["returned no choices", "returned empty", "returned no message"], 5.0), (["overloaded"], 30.0)]
OWN_DELAY = r"['\"]retry_after['\"]\s*:\s*(\d+(?:\.\d+)?)"
SPLIT = ["524", "truncated", "max_tokens", "not valid json", "expecting value", "finish_reason=length"]


def _any(c: Column, parts: list[str]) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | F.contains(c, F.lit(p))
    return test


def classify_error(message: Column) -> Column:
    """STRUCT<refusal, retry, delay, split> of a provider's error message."""
    low = F.lower(text(message))
    refusal = _any(low, REFUSALS)
    own = F.regexp_extract(text(message), OWN_DELAY, 1)
    delay = F.when(refusal, F.lit(None)).when(own != "", own.cast("double"))
    for parts, seconds in RETRY_AFTER:
        delay = delay.when(_any(low, parts), seconds)
    return F.struct(refusal.alias("refusal"), delay.isNotNull().alias("retry"), F.coalesce(delay, F.lit(0.0)).alias("delay"), _any(low, SPLIT).alias("split"))
