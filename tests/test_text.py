import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingoweave.functions import contexts as C
from lingoweave.functions import text as X


def one(spark, columns, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(columns({n: F.col(n) for n in names}).alias("x")).first().x


@pytest.mark.parametrize("text", ["", r"\C[2]Hello\C[0] %1", r"\n<フォル>こんにちは <area> \V[3]", r"<b>x</b>", r"<item \V[1]> ok", "{name} [tag] $x", None])
def test_mask_round_trip(spark, text):
    m = one(spark, lambda c: X.mask(c["t"]), t=text)
    assert "\\C[" not in m.masked and one(spark, lambda c: X.unmask(X.mask(c["t"]).masked, X.mask(c["t"]).tokens), t=text) == (text or "")


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from(list(r"\CVn[]<>{}%12ab $希")), max_size=16), min_size=300, max_size=300))
def test_mask_round_trip_of_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.mask(F.col("t")).alias("m"))
    assert df.where(X.unmask(F.col("m.masked"), F.col("m.tokens")) != F.col("t")).count() == 0


def test_mask_keeps_the_name_and_lower_case_tokens_come_back(spark):
    m = one(spark, lambda c: X.mask(c["t"]), t=r"\n<\C[22]フォル>やあ \V[1]")
    assert m.masked == "ZXQ0000QXZ<ZXQ0001QXZフォル>やあ ZXQ0002QXZ" and m.tokens == [r"\n", r"\C[22]", r"\V[1]"]
    assert one(spark, lambda c: X.unmask(c["t"], F.array(F.lit("%1"))), t="x zxq0000qxz") == "x %1"


def test_boxes(spark):
    box = lambda s, t: one(spark, lambda c: X.restore_box(c["s"], c["t"]), s=s, t=t)
    assert box(r"\n<フォル>やあ", "  Hi") == r"\n<フォル>Hi"
    assert box(r"\n<\C[2]フォル>やあ", r"\n<Fol>Hi") == r"\n<\C[2]Fol>Hi"
    assert box("やあ", "Hi") == "Hi"
    name = lambda s, t, n: one(spark, lambda c: X.replace_box_name(c["s"], c["t"], c["n"]), s=s, t=t, n=n)
    assert name(r"\n<フォル>やあ", r"\n<フォル>Hi", "Fol") == r"\n<Fol>Hi"
    assert name(r"\n<フォル>やあ", r"\n<フォル>やあ", "Fol") == r"\n<フォル>やあ"
    assert name(r"\n<Bob>やあ", r"\n<Bob>Hi", "Rob") == r"\n<Bob>Hi"


def test_repairs(spark):
    fix = lambda t: one(spark, lambda c: X.fix_token_spacing(c["t"]), t=t)
    assert fix(r"\N [ 1 ] \n < x > % 1 \ !") == r"\N[1] \n<x> %1 \!"
    assert one(spark, lambda c: X.repair_syntax(c["s"], c["t"]), s=r"\C[1]a %d", t="b") == r"b\C[1]%d"
    assert one(spark, lambda c: X.repair_syntax(c["s"], c["t"]), s=r"\C[1]a", t=" ") == " "
    assert one(spark, lambda c: X.corrected(c["t"], [("HP", r"\N[1]$"), ("、", "")]), t="HP HPs、HP_ 攻HP") == r"\N[1]$ HPsHP_ 攻" + r"\N[1]$"
    assert one(spark, lambda c: X.replaced(c["t"], "a.B", "$1", True), t="xA.bx") == "x$1x"
    assert one(spark, lambda c: X.repair_latin1(c["t"]), t="fÃ¼r") == "für" and one(spark, lambda c: X.repair_latin1(c["t"]), t="für") == "für"
    assert one(spark, lambda c: X.repair_escapes(c["t"]), t=r'"\C[1]\n"') == r'"\\C[1]\n"'
    assert one(spark, lambda c: X.strip_fence(c["t"]), t="```json\n[1]\n```") == "[1]"


def test_warnings(spark):
    w = lambda s, t, c="": one(spark, lambda k: X.warnings(k["s"], k["t"], k["c"]), s=s, t=t, c=c)
    assert w("a", "") == [] and w("a", "a") == []
    assert w("a", "b字") == ["target contains CJK characters (possible partial translation)"]
    assert w(r"\V[1] a", "b b b") == ["missing placeholder '\\\\V[1]'", "missing control code '\\\\V[1]'"]
    assert w("a\nb", "a b") == ["newline count mismatch (1 vs 0)"]
    assert w("HP", "Lebenspunkte", "rpg_maker_terms_basic")[0].startswith("name/UI label too long (2→12 chars, max 2.5x")
    assert "script string contains newline" in w("abcdef", "ab\ncd", "rpg_maker_script")


def test_predicates(spark):
    text = lambda t: one(spark, lambda c: X.is_text(c["t"]), t=t)
    assert text("a") and not text(r" \C[1] %1 ") and not text("　") and not text(None)
    good = lambda t: one(spark, lambda c: X.looks_translatable(c["t"]), t=t)
    assert good("Open the door") and good("勇者") and not good("#ff00aa") and not good("12.5") and not good("img/a.png") and not good("someValue") and not good("true") and not good("$gameParty.x") and not good("")
    ui = lambda t: one(spark, lambda c: X.is_ui_text(c["t"]), t=t)
    assert ui("ok!") and not ui("x") and not ui("$a") and not ui("#fff") and not ui("center")


def test_errors(spark):
    e = lambda t: tuple(one(spark, lambda c: X.classify_error(c["t"]), t=t))
    assert e("I cannot do that") == (True, False, 0.0, False) and e("{'retry_after': 3}") == (False, True, 3.0, False)
    assert e("error 524") == (False, True, 60.0, True) and e("what") == (False, False, 0.0, False) and e(None) == (False, False, 0.0, False)


def test_contexts(spark):
    cat = lambda t: one(spark, lambda c: C.dedup_category(c["t"]), t=t)
    assert cat("rpg_maker_choice") == "choice" and cat("rpg_maker_plugin_ui_X") == "plugin_ui" and cat("other") == "other"
    hint = lambda t: one(spark, lambda c: C.context_hint(c["t"]), t=t)
    assert hint("rpg_maker_items_name") == "item name" and hint("rpg_maker_plugin_ui_A") == "plugin UI text" and hint("x_plugin_y") == "plugin text" and hint("x") == "x"


def test_language_names(spark):
    import pytest

    from lingoweave.functions import contexts as C

    rows = spark.createDataFrame([(x,) for x in ("auto", "Viet", " German ", "zh", "xx", "", None)], "n string")
    assert [r.c for r in rows.select(C.language_code(F.col("n")).alias("c")).collect()] == ["auto", "vi", "de", "zh", "xx", "auto", "auto"]
    with pytest.raises(Exception, match="unknown language"):
        spark.createDataFrame([("Klingon",)], "n string").select(C.language_code(F.col("n"))).collect()
    rows = spark.createDataFrame([(x,) for x in ("Chinese Simplified", "chinese traditional", "Chinese", "zh", "zh-TW", " French ")], "n string")
    assert [r.c for r in rows.select(C.folder_language(F.col("n")).alias("c")).collect()] == ["zh-CN", "zh-TW", "zh-CN", "zh", "zh-TW", "fr"]
