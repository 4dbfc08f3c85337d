import json
import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from lingoweave.operators.nested import Index, flatten_json, latest_readable, mark_readable

NAME = re.compile("[A-Za-z0-9_]+")


def brute(root):
    out = set()

    def walk(o, path, par):
        if isinstance(o, dict):
            if path != "$":
                out.add((par, path, "object", None))
            for k, v in o.items():
                walk(v, path + (f".{k}" if NAME.fullmatch(k) else f"['{k}']"), path)
        elif isinstance(o, list):
            for i, v in enumerate(o):
                walk(v, f"{path}[{i}]", par)
        elif isinstance(o, str) and o and not o.isspace():
            out.add((par, path, "text", o))

    walk(root, "$", "$")
    return out


TEXT = st.text(st.characters(codec="utf-8"), max_size=12)
TREE = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | TEXT, lambda x: st.lists(x, max_size=4) | st.dictionaries(TEXT, x, max_size=4), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(TREE, min_size=1, max_size=4), st.sampled_from([None, 1, 2]), st.booleans())
def test_index_equals_a_parser(trees, indent, ascii_only):
    index = Index([json.dumps(t, indent=indent, ensure_ascii=ascii_only).encode() for t in trees])
    assert index.valid.all()
    n = index.nodes()
    for i, t in enumerate(trees):
        got = {(p, a, k, v) for d, p, a, k, v in zip(n["doc"], n["parent_path"], n["path"], n["kind"], n["value"]) if d == i}
        assert got == brute(t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from('{}[]:,"\\ ntu0129.-e\nab'), max_size=14), TREE, st.integers(0, 60))
def test_validity_equals_a_parser(noise, tree, at):
    whole = json.dumps(tree)
    for text in (noise, whole[:at] + noise + whole[at:], whole[:at]):
        try:
            json.loads(text)
            good = bool(text.strip(" \t\r\n"))
        except ValueError:
            good = False
        neighbours = Index([b"[1]", text.encode(), b'{"a": "x"}'])
        assert list(neighbours.valid) == [True, good, True], text


def test_duplicate_names_and_surrogates():
    n = Index([b'{"a": {"x": "1"}, "a": {"y": "2"}}', rb'["\ud83d\ude00", "\ud800"]']).nodes()
    assert [(p, v) for p, v in zip(n["path"], n["value"])] == [("$.a", None), ("$.a.y", "2"), ("$[0]", "😀"), ("$[1]", "�")]


def test_deep_tree(spark):
    body = '{"a":' * 300 + '"x"' + "}" * 300
    got = flatten_json(spark.createDataFrame([("f", body)], "path string, body string").withColumnRenamed("path", "file"), "body", ["file"]).collect()
    assert len(got) == 300 and max(r.depth for r in got) == 300


def test_latest_readable(spark):
    t = [datetime(2025, 1, i) for i in range(1, 5)]
    df = spark.createDataFrame([
        (1, "f", t[0], '\ufeff {"a": "old"} '), (2, "f", t[1], '{"a": "new"}'), (3, "f", t[2], '{"a": '), (4, "f", t[3], None), (5, "g", t[0], ""), (6, "h", t[0], "[1]"), (7, "h", t[0], "[2]"), (8, None, t[0], "[3]"),
    ], "delivery_no bigint, file string, loaded_at timestamp, body string")
    assert {(r.file, r.body) for r in latest_readable(df).collect()} == {("f", '{"a": "new"}'), ("h", "[2]"), (None, "[3]")}
    assert mark_readable(df, "body").where("readable").count() == 5
    assert latest_readable(df.limit(0)).count() == 0
