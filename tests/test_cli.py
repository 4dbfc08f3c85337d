import json

from lingoweave import cli


def test_from_game_to_patched_game(spark, tmp_path, capsys):
    data = tmp_path / "game" / "data"
    data.mkdir(parents=True)
    (data / "Actors.json").write_text(json.dumps([None, {"id": 1, "name": "Al", "profile": "Tall \\C[1]man"}]), encoding="utf-8")
    (data / "Broken.json").write_text("{", encoding="utf-8")
    game, texts, out, patched = (str(tmp_path / x) for x in ("game", "texts", "out", "patched"))
    assert cli.main(["scan", game]) == 0 and json.loads(capsys.readouterr().out)["entries"] == 2
    assert cli.main(["extract", game, texts]) == 0 and "invalid JSON" in capsys.readouterr().err
    assert cli.main(["translate", texts, out, "--target", "de"]) == 0
    assert cli.main(["validate", out]) == 0 and json.loads(capsys.readouterr().out)["total"] == 2
    assert cli.main(["apply", game, out, patched]) == 0
    assert json.loads((tmp_path / "patched" / "Actors.json").read_text(encoding="utf-8"))[1] == {"id": 1, "name": "AL", "profile": "TALL \\C[1]MAN"}
    assert cli.main(["retry", out, str(tmp_path / "again"), "--filter", "all"]) == 0
    assert cli.main(["diff", texts, texts, str(tmp_path / "diff"), "--translations", out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"unchanged": 2}


def test_auto_with_plugins_glossary_and_strict(spark, tmp_path, capsys):
    game = tmp_path / "game"
    (game / "data").mkdir(parents=True)
    (game / "js").mkdir()
    (game / "data" / "System.json").write_text(json.dumps({"gameTitle": "Lamp"}), encoding="utf-8")
    (game / "js" / "plugins.js").write_text('var $plugins =\n[{"name":"A","status":true,"parameters":{"Title":"Hello you"}}];\n', encoding="utf-8")
    terms = tmp_path / "terms.csv"
    terms.write_text("term,translation\nLamp,Lampe\n", encoding="utf-8")
    out = tmp_path / "out"
    assert cli.main(["auto", str(game), str(out), "--target", "de", "--provider", "upper-json", "--glossary", str(terms)]) == 0
    assert json.loads((out / "patched" / "System.json").read_text(encoding="utf-8")) == {"gameTitle": "LAMP"}
    assert '"Title": "HELLO YOU"' in (out / "patched" / "plugins.js").read_text(encoding="utf-8")
    assert cli.main(["validate", str(out / "results"), "--strict"]) == 0
    same = tmp_path / "same.csv"
    same.write_text("file,key,source,target\na.json,$.x,word,word\n", encoding="utf-8")
    assert cli.main(["validate", str(same)]) == 0 and cli.main(["validate", str(same), "--strict"]) == 2
    (game / "js" / "data").mkdir()
    (game / "js" / "data" / "System.json").write_text(json.dumps({"gameTitle": "Lamp"}), encoding="utf-8")
    import pytest

    assert cli.main(["pipeline", str(game), str(tmp_path / "p"), "--target", "de"]) == 0
    with pytest.raises(SystemExit, match="several files"):
        cli.main(["apply", str(game), str(tmp_path / "p" / "results"), str(tmp_path / "q")])
