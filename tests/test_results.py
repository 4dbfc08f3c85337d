from pyspark.sql import functions as F

from lingoweave.operators import batching, glossary, results

R = "file string, key string, source string, target string, context string, ord bigint"


def table(spark, rows, schema=R):
    return spark.createDataFrame(rows, schema)


def test_dedupe_last_value_first_place(spark):
    df = table(spark, [("a", "k", "s", "one", None, 1), ("a", "k", "s", "two", "c", 3), ("b", "k", "s", None, "c", 2), (None, "k", "s", "x", "c", 4)])
    assert {(r.file, r.target, r.ord, r.first_ord) for r in results.dedupe_last(df).collect()} == {("a", "two", 3, 1), ("b", None, 2, 2), (None, "x", 4, 4)}


def test_pending_wanted_cleared(spark):
    e = table(spark, [("a", "1", "s", None, "c", 1), ("a", "2", "s", None, "c", 2), ("a", "3", "s", None, "c", 3)])
    r = table(spark, [("a", "1", "s", "s", "c", 1), ("a", "2", "s", " ", "c", 2), ("z", "9", "s", "字", "c", 3)])
    assert [x.key for x in results.pending(e, r).orderBy("key").collect()] == ["2", "3"]
    assert results.wanted(r, e).count() == 2 and results.pending(e, r.limit(0)).count() == 3
    assert {x.target for x in results.cleared(r, "cjk-leak").collect()} == {"s", " ", ""}


def test_memory(spark):
    from datetime import datetime

    m = spark.createDataFrame([("s", "old", "ja", "vi", "p", "", datetime(2025, 1, 1)), ("s", "new", "JA ", "VI", "p", "", datetime(2025, 1, 2)), ("s", "ctx", None, None, "p", "c", datetime(2025, 1, 1)),
                               ("s", "other", "ja", "de", "p", "d", datetime(2025, 1, 3)), ("t", " ", "ja", "vi", "p", "", datetime(2025, 1, 1)), (None, "x", "ja", "vi", "p", "", None)],
                              "source string, target string, source_lang string, target_lang string, provider string, context string, updated_at timestamp")
    eff = results.effective_memory(m, "vi", "ja")
    assert {tuple(r) for r in eff.collect()} == {("", "s", "new"), ("c", "s", "ctx")}
    e = table(spark, [("a", "1", "s", None, "c", 1), ("a", "2", "s", None, "x", 2), ("a", "3", "u", None, "c", 3), ("a", "4", None, None, None, 4)])
    assert {(r.key, r.remembered) for r in results.lookup_memory(e, eff).collect()} == {("1", "ctx"), ("2", "new"), ("3", None), ("4", None)}
    fresh = table(spark, [("a", "1", "s", "newest", "", 1), ("a", "2", "q", "q", "", 2), ("a", "3", "n", "N", None, 3)])
    up = results.upsert_memory(m, fresh, "vi", "ja", "p")
    assert {(r.source, r.target) for r in up.where("context = '' and lower(target_lang) = 'vi' and lower(source_lang) like 'ja%'").collect()} >= {("n", "N"), ("s", "newest")}


def test_groups_and_fan_out_with_a_hot_source(spark):
    e = spark.range(3000).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, "Yes").otherwise(F.col("id").cast("string")).alias("source"),
                                 F.when(F.col("id") % 2 == 0, "rpg_maker_actors_name").otherwise("rpg_maker_items_name").alias("context"), F.col("id").alias("ord"))
    g = results.source_groups(e)
    assert g.count() == 2001 and g.where("source = 'Yes'").first().members == 1000
    assert results.fan_out(e, g.select("source", "category", F.col("source").alias("target"))).count() == 3000


def test_diff(spark):
    old = table(spark, [("a", k, s, None, None, 0) for k, s in (("1", "s"), ("2", "s"), ("3", "s"), ("4", "s"))])
    new = table(spark, [("a", k, s, None, None, 0) for k, s in (("1", "s"), ("2", "S"), ("3", "s"), ("5", "s"))])
    tr = table(spark, [("a", "1", "s", "t", None, 0), ("a", "2", "s", "t" * 90, None, 0), ("a", "3", "s", " ", None, 0), ("a", "4", "s", "t", None, 0)])
    got = {(r.key, r.status) for r in results.diff(old, new, tr).collect()}
    assert got == {("1", "unchanged"), ("2", f"changed (was: {'t' * 80})"), ("3", "new"), ("5", "new"), ("4", "removed")}


def test_nouns_and_reports(spark):
    n = "rpg_maker_actors_name"
    r = table(spark, [("a", "1", "勇者", "Hero", n, 2), ("a", "2", "勇者 ", "Brave", n, 1), ("a", "3", "x", "y", n, 3), ("a", "4", "勇者", "Foo", "other", 4), ("a", "5", "q", None, n, 5), ("a", "6", "q", "q", n, 6)])
    assert [tuple(x) for x in results.noun_inconsistency(r).collect()] == [("勇者", "Brave | Hero", 2)]
    assert tuple(results.translate_report(r).first()) == (6, 4, 2)
    v = results.validation_report(r).first()
    assert (v.total, v.empty, v.fallback, v.fallback_pct) == (6, 1, 1, 16.67) and results.validation_report(r.limit(0)).first().total == 0


def test_batches_follow_the_greedy_rule(spark):
    e = spark.createDataFrame([("f", i, "x" * n, None) for i, n in enumerate([5, 5, 30, 1, 1, 1, 1])], "file string, ord bigint, source string, context_text string")
    got = [(r.ord, r.batch_no) for r in batching.char_batches(e, 3, 10).orderBy("ord").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3)]
    assert batching.auto_batch_size(e.limit(0)).first().batch_size == 30 and batching.char_batches(e.limit(0)).count() == 0


def test_glossary(spark):
    g = spark.createDataFrame([(" a ", "x", None, None, 2), ("a", "y", None, "c", 3), ("A", "z", None, "c", 4), ("", "q", None, None, 5), ("b", " ", None, None, 6), ("t", "u\nv", None, "", 7), (None, None, None, None, 8)],
                              "term string, translation string, note string, category string, line_no bigint")
    assert {(r.term, r.translation) for r in glossary.load_glossary(g).collect()} == {("a", "x"), ("A", "z"), ("t", "u\nv")}
    lint = sorted((r.line_no, r.warning.split(": ", 1)[1]) for r in glossary.lint(g).collect())
    assert lint == [(2, "term has leading/trailing whitespace (' a ')"), (3, "duplicate term 'a' (first seen at line 2, later rows ignored)"), (4, "term 'A' differs only in case from 'a' — only one will match"),
                    (5, "term is blank"), (6, "term 'b' has blank translation"), (7, "term 't' translation contains control chars (will break prompt formatting)")]
    assert glossary.prompt(glossary.load_glossary(g.limit(0))).first().prompt == ""
    short = glossary.prompt(glossary.load_glossary(g), len(glossary.HEADER) + 15).first().prompt
    assert short.endswith("(...2 more terms omitted to keep prompt short)\n")


def test_manual_edits_win(spark):
    review = spark.createDataFrame([("a", "1", "mine", True), ("a", "2", "old", None), ("a", "3", "old", False)], "file string, key string, target string, manually_edited boolean")
    batch = spark.createDataFrame([("a", "1", "n"), ("a", "2", "n")], "file string, key string, target string")
    assert {(r.key, r.target) for r in results.merge_batch(review, batch).collect()} == {("1", "mine"), ("2", "n"), ("3", "old")}


def test_next_warning_over_blocks(spark):
    rows = [("f", str(i), "a\nb", "x" if i in (3, 250, 251) else "x\ny", "", i) for i in range(0, 400)] + [("g", "1", "a", "b", "", 7), (None, "1", "a\nb", "x", "", 8)]
    df = spark.createDataFrame(rows, "file string, key string, source string, target string, context string, ord bigint")
    got = {(r.file, r.ord): r.next for r in results.next_warning(df, block=50).collect()}
    warned = [3, 250, 251]
    assert len(got) == 402 and got[("g", 7)] is None and got[(None, 8)] == 8
    assert all(got[("f", i)] == min((w for w in warned if w > i), default=3) for i in range(400))


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from lingoweave.runtime import shared_dir

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_dir(Session()) == "hdfs://x/y"
