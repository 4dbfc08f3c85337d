import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lingoweave.llm.encoding import CHAINS, EncodingModel, garble, garbled_texts, train_encoding_model, ungarble

CLEAN = ["Die Königin wartet im großen Wald.", "Où est la clé de l'église brûlée ?", "¿Dónde está la pequeña señora?", "Não há nada além da poção mágica.", "Cảm ơn bạn đã đến thư viện bị lãng quên.",
         "ありがとう、君がいなければ、私たちはすべてを失っていた。", "鍛冶屋によると、湖の大蛇は昼間に眠っているそうだ。", "이 문은 은빛 등불을 지니고 있을 때만 열립니다.", "铁匠说湖中巨蛇白天都在睡觉。", "Hello there, “friend” — it's 20° ♪", "Æmino, Øfimi & Ñuvi", "Der König hört die Glöckchen überall."]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    words = [w for t in CLEAN for w in t.split()]
    extra = [" ".join(rng.choice(words, 6)) for _ in range(300)]
    return EncodingModel(CLEAN * 3 + extra)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(CLEAN), st.sampled_from(sorted(CHAINS)))
def test_chain_inverts_or_says_so(text, chain):
    g = garble(text, chain)
    if g and "�" not in g and (back := ungarble(g, chain)) is not None:
        assert garble(back, chain) == g


def test_clean_texts_stay_and_garbled_ones_are_found(model):
    assert [t for t in CLEAN if model.rise(t)[0] >= 9] == []
    for chain in ("utf8>cp1252", "utf8>latin1", "utf8>mac_roman", "utf8>cp1252>cp1252", "cp932>cp1252", "utf8>gbk"):
        for t in CLEAN[5:9]:
            g = garble(t, chain)
            if g:
                assert model.rise(g)[0] >= 9, (chain, t)


def test_restoration_of_whole_and_part(model):
    for t in CLEAN[4:9]:
        assert model.restore(garble(t, "utf8>cp1252"))[0] == t
    mixed = "鍛冶屋によると、" + garble("湖の大蛇は昼間に眠っているそうだ。", "utf8>cp1252")
    assert model.restore(mixed)[0] == "鍛冶屋によると、湖の大蛇は昼間に眠っているそうだ。"


def test_many_at_once_equal_one_by_one(model):
    texts = [*CLEAN, "", "a", garble(CLEAN[5], "utf8>latin1"), "x" * 50_000]
    assert np.allclose(model.rises([t.encode() for t in texts]), [model.rise(t)[0] for t in texts])


def test_rows(spark, model):
    bad = garble(CLEAN[5], "utf8>cp1252")
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "plain", 1.0), (4, bad, 1.0), (4, bad, 1.0), (5, CLEAN[0], None), (6, bad * 400, 1.0)], "ord bigint, text string, score double")
    got = garbled_texts(df, model)
    assert {(r.ord, r.restored) for r in got.collect()} == {(4, CLEAN[5]), (6, CLEAN[5] * 400)} and got.count() == 3
    assert garbled_texts(df.limit(0), model).count() == 0
    assert train_encoding_model(df.limit(0)).rise("x")[0] <= 9


def test_single_byte_text_read_with_another_single_byte_encoding(spark, model):
    bad = [(1, CLEAN[0], "cp1252>cp437"), (2, CLEAN[1], "cp1252>cp437"), (3, CLEAN[2], "cp1252>cp850"), (4, CLEAN[3], "cp1252>cp437"), (5, CLEAN[2], "mac_roman>cp1252"), (6, CLEAN[11], "cp1252>mac_roman"), (7, CLEAN[2], "cp437>cp1252")]
    clean = [*CLEAN, "“Yes…”", "Ja… —", "Là một trợ lý ngôn ngữ", "Équipement", "20°C", "Ænomo……"]
    df = spark.createDataFrame([(i, garble(t, c)) for i, t, c in bad] + [(100 + i, t) for i, t in enumerate(clean)], "ord bigint, text string")
    got = {r.ord: r.restored for r in garbled_texts(df, model).collect()}
    assert got == {i: t for i, t, _ in bad}


def test_many_texts_are_garbled_at_once():
    from lingoweave.llm.encoding import CHAINS, garble, garble_all

    texts = ["Où est la forêt ?", "estará «aquí»…", "女王は古い森で待っている。", "여왕은 숲에서", "plain", "Wölfin ist stärker\nals Bären", "Nữ hoàng", "x" * 50 + "é"]
    for chain in CHAINS:
        assert garble_all(texts, chain) == [g for t in texts if (g := garble(t, chain))], chain
    assert garble_all([], "utf8>cp1252") == []
