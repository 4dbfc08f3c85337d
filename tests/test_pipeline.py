import pytest

from lingoweave.plans import pipeline, provider
from lingoweave.plans.provider import PROVIDERS, Provider, call, make_provider, parse_answers

E = "file string, key string, source string, context string, context_text string, sub_keys array<string>, ord bigint"


class Script(Provider):
    """Fails as told, then answers in capitals."""

    def __init__(self, *errors):
        self.errors, self.calls = list(errors), []

    def translate(self, texts, target_lang, source_lang):
        self.calls.append(len(texts))
        if self.errors and self.errors[0]:
            raise RuntimeError(self.errors.pop(0))
        if "bad" in texts and len(texts) > 1:
            raise RuntimeError("response truncated")
        return [t.upper() for t in texts]


def test_retry_split_refuse():
    s = Script("HTTP 503", "HTTP 503")
    assert call(s, ["a"], "vi", "ja", wait=0) == ["A"] and s.calls == [1, 1, 1]
    assert call(Script("I cannot help"), ["a", "b"], "vi", "ja", wait=0) == [None, None]
    s = Script()
    assert call(s, ["a", "bad", "c", "d"], "vi", "ja", wait=0) == ["A", "BAD", "C", "D"] and max(s.calls) == 4
    with pytest.raises(ValueError):
        make_provider("nobody")


def test_delay_named_by_the_provider():
    assert provider.judge("quota, 'retry_after': 42") == (True, 42.0, False) and provider.judge("I cannot, 'retry_after': 42") == (False, 0.0, False)


def test_parse_answers():
    good, skipped = parse_answers('```json\n[{"id": "1", "target": "x"}, {"key": "k"}, 3, {"key": "k", "target": ""}]\n```')
    assert len(good) == 2 and skipped == 2
    assert parse_answers(r'[{"id":"1","target":"\C[1]"}]')[0][0]["target"] == r"\C[1]"
    with pytest.raises(ValueError):
        parse_answers('{"a": 1}')


def test_parse_names_and_segments():
    assert provider.parse_names('```json\n{"ディオン": " Dion ", "Al": "Al", "健太": "健太", "other": "x"}\n```', {"ディオン", "Al", "健太"}) == {"ディオン": "Dion", "Al": "Al"}
    assert provider.parse_names('[{"name": "Al", "target": "El"}, 3, {"original": "x"}]', {"Al", "x"}) == {"Al": "El"} and provider.parse_names("no", {"a"}) == {}
    assert provider.parse_segments([[["a", 1], ["b"], [None], 3]]) == "ab" and provider.parse_segments([]) == "" and provider.parse_segments({}) == ""


def test_names_are_asked_once(spark):
    class Latin(Provider):
        def translate(self, texts, target_lang, source_lang):
            return [{"フォル": "Fol"}.get(t, t) for t in texts]

    PROVIDERS["latin"] = Latin
    rows = [("f", str(i), rf"\n<\C[2]{n}>やあ", "rpg_maker_event_text", None, None, i) for i, n in enumerate(["フォル", "フォル", "健太", "知", "Bob"])]
    known = spark.createDataFrame([("知", "Tomo")], "original string, translation string")
    got = pipeline.translate_names(spark.createDataFrame(rows, E), pipeline.Options("de", provider="latin", wait=0), known)
    assert {tuple(r) for r in got.collect()} == {("フォル", "Fol"), ("知", "Tomo")}
    del PROVIDERS["latin"]


def test_match_answers(spark):
    batch = spark.createDataFrame([(1, "f", "k", "s"), (1, "g", "k", "s"), (2, "f", "k", "s"), (2, "f", "m", "s")], "batch_no int, file string, key string, source string")
    answers = spark.createDataFrame([(1, "f\x1fk", "k", "one", 0), (1, None, "k", "two", 1), (2, None, "k", "three", 0)], "batch_no int, id string, key string, target string, n int")
    got = {(r.batch_no, r.file, r.key): r.target for r in provider.match_answers(batch, answers).collect()}
    assert got == {(1, "f", "k"): "one", (1, "g", "k"): "s", (2, "f", "k"): "three", (2, "f", "m"): "s"}


def test_run(spark):
    from datetime import datetime

    e = spark.createDataFrame([("f", "1", r"\C[1]hi", "rpg_maker_choice", None, None, 1), ("f", "2", r"\C[1]hi", "rpg_maker_choice", None, [], 2), ("g", "3", "done", "c", None, None, 3), ("g", "4", "known", "c", None, None, 4), ("g", "4", "known", "c", None, None, 5), (None, "5", None, None, None, None, 6)], E)
    r = spark.createDataFrame([("g", "3", "done", "fertig", "c", None, 1), ("x", "9", "s", "t", "c", None, 2)], "file string, key string, source string, target string, context string, sub_keys array<string>, ord bigint")
    m = spark.createDataFrame([("known", "bekannt", "auto", "de", "p", "", datetime(2025, 1, 1))], "source string, target string, source_lang string, target_lang string, provider string, context string, updated_at timestamp")
    out = {(x.file, x.key): (x.target, x.origin) for x in pipeline.run(e, pipeline.Options("de", corrections=[("HI", "HO")], wait=0), r, m).collect()}
    assert out == {("f", "1"): (r"\C[1]HO", "provider"), ("f", "2"): (r"\C[1]HO", "provider"), ("g", "3"): ("fertig", "done"), ("g", "4"): ("bekannt", "memory"), (None, "5"): ("", "provider")}


def test_failed_texts_fall_back(spark):
    class Never(Provider):
        def translate(self, texts, target_lang, source_lang):
            raise RuntimeError("I cannot")

    PROVIDERS["never"] = Never
    e = spark.createDataFrame([("f", "1", "hi", "c", None, None, 1)], E)
    assert pipeline.run(e, pipeline.Options("de", provider="never", wait=0)).first().target == "hi"
    del PROVIDERS["never"]


def test_registered_run_has_names_and_corrections(spark, monkeypatch):
    from lingoweave.plans import catalogue

    seen = []
    monkeypatch.setattr(catalogue.pipeline, "run", lambda e, options, results, memory, names=None: seen.append((options.corrections, names)) or e)
    catalogue._run(spark, catalogue_data())
    assert seen[0][0] == catalogue.RULES and seen[0][1].columns == ["original", "translation"]


def catalogue_data():
    import os

    return os.environ.get("LINGOWEAVE_DATA", "/root/testdata/sf0.001")


def test_one_run_with_names_glossary_and_extra(spark):
    """A provider that speaks JSON sees hints, names and the glossary; earlier results keep their further columns."""
    import json as j

    asked = spark.sparkContext.accumulator(0)

    class Chat(provider.ChatProvider):
        def complete(self, system, user):
            items = j.loads(user)["items"]
            asked.add(len(items))
            known = {"フォル": "Fol"}
            return j.dumps([{"id": x["id"], "target": known.get(x["source"], f"{x['hint']}|{'Lampe' in system}|{x['source'].upper()}")} for x in items])

    PROVIDERS["chat"] = Chat
    e = spark.createDataFrame([("f", "1", "lamp", "rpg_maker_items_name", None, None, 1), ("f", "2", "<フォル>hi", "rpg_maker_event_text", None, None, 2), ("f", "3", "done", "c", None, None, 3)], E)
    old = spark.createDataFrame([("f", "3", "done", "fertig", {"by": "Anna"}, "rpg_maker_items_name", 1)], "file string, key string, source string, target string, extra map<string,string>, context string, ord bigint")
    terms = spark.createDataFrame([("lamp", "Lampe", "", "", 1)], "term string, translation string, note string, category string, line_no bigint")
    out = {r.key: (r.target, r.extra) for r in pipeline.run(e, pipeline.Options("de", provider="chat", wait=0, auto_glossary=True), old, None, None, terms).collect()}
    del PROVIDERS["chat"]
    assert out["1"] == ("item name|True|LAMP", {}) and out["3"] == ("fertig", {"by": "Anna"}) and out["2"][0].startswith("<Fol>") and asked.value == 3


def test_json_and_plain_provider_agree(spark):
    e = spark.createDataFrame([("f", str(i), t, "c", None, None, i) for i, t in enumerate(["a \"b\"", r"\C[1]x", "line\nline", "", "ß"])], E)
    a, b = (sorted(map(tuple, pipeline.run(e, pipeline.Options("de", provider=p, wait=0)).select("key", "target").collect())) for p in ("upper", "upper-json"))
    assert a == b


def test_one_text_at_a_time():
    class Slow(provider.TextProvider):
        pause = 0

        def translate_text(self, text, target_lang, source_lang):
            return text[::-1]

    assert call(Slow(), ["ab", "cd"], "de", "en") == ["ba", "dc"]
