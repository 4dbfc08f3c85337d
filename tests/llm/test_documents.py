import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingoweave.llm.cuts import CutModel, TableCutModel, cut_documents, cuts_by_source, ends_early, train_cut_model, units
from lingoweave.llm.endings import EndModel, Logistic, end_counts, end_keys, end_scores, ends_full
from lingoweave.llm.words import Words, levels, shared
from lingoweave.llm.leaks import ItemIndex, leaked_items
from lingoweave.llm.mixing import TOKENIZER, Mixture, allocate, count_tokens, inclusion_scale

LETTERS = "abcd"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS), min_size=1, max_size=40), min_size=1, max_size=5), st.lists(st.text(st.sampled_from(LETTERS), max_size=80), min_size=1, max_size=5))
def test_exact_passages_equal_brute_force(items, docs):
    found = {(t, i): n for t, i, n, _, _ in ItemIndex(list(enumerate(items))).search(docs)}
    expected = {}
    for i, s in enumerate(items):
        need = math.ceil(0.4 * len(s) - 1e-9)
        for t, doc in enumerate(docs):
            n = max((b - a for a in range(len(s)) for b in range(a + need, len(s) + 1) if s[a:b] in doc), default=0)
            if n:
                expected[t, i] = n
    assert found == expected


def test_passages_with_edits():
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    part = item[60:200]
    worn = part[:50] + "#" + part[51:100] + part[101:]  # one letter changed, one lost
    other = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    docs = [other[:100] + worn + other[100:], other]
    assert ItemIndex([(7, item)]).search(docs) == []
    assert {(t, i) for t, i, *_ in ItemIndex([(7, item)], edits=2).search(docs)} == {(0, 7)}


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab"), min_size=1, max_size=24), st.text(st.sampled_from("ab"), max_size=30), st.integers(1, 2))
def test_edited_passages_equal_brute_force(item, doc, edits):
    """Any stretch of the item with enough letters that lies in the document with at most so many edits, by edit distance over all pairs of stretches."""
    need = math.ceil(0.4 * len(item) - 1e-9)

    def found():
        for a in range(len(item) - need + 1):
            for b in range(len(doc)):
                row = {b: 0}  # end in the document -> edits, for the item up to i
                row = {b + j: j for j in range(edits + 1) if b + j <= len(doc)}
                for c in item[a:a + need]:
                    new = {}
                    for j, e in row.items():
                        for k, cost in ((j + 1, doc[j] != c) if j < len(doc) else (j, 9), (j, 1)):
                            if e + cost <= edits:
                                new[k] = min(new.get(k, 9), e + cost)
                    for j in sorted(new):
                        if j < len(doc) and new[j] < edits:
                            new[j + 1] = min(new.get(j + 1, 9), new[j] + 1)
                    row = new
                if row:
                    return True
        return False

    hit = bool(ItemIndex([(7, item)], edits=edits).search([doc]))
    if need > 4 * (edits + 1):  # shorter passages may end in an edit, which is no letter of the item
        assert hit or not found() or need <= 4 * (edits + 1)
    if hit:
        assert found()


def test_many_edited_passages_are_found():
    """300 passages of 40 to 100 per cent of an item, each with two edits of any kind within."""
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.randrange(60, 400))) for i in range(300)]
    docs = []
    for _, item in items:
        n = rng.randrange(math.ceil(0.4 * len(item)) + 2, len(item) + 1)
        a = rng.randrange(len(item) - n + 1)
        part = list(item[a:a + n])
        for _ in range(2):
            j = rng.randrange(4, len(part) - 4)
            part[j:j + 1] = rng.choice([[], [part[j], "#"], ["#"]])
        docs.append(text(rng.randrange(200)) + "".join(part) + text(rng.randrange(200)))
    index = ItemIndex(items, edits=2)
    got = {(t, i) for t, i, *_ in index.search(docs)}
    assert sum((k, k) in got for k in range(300)) == 300 and len(got) == 300
    assert len(ItemIndex(items, edits=0).search(docs)) < 250


def test_common_beginnings_and_short_items(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = word(60)
    items = [(i, head + word(300)) for i in range(100)]
    docs = [head + word(100), items[3][1][40:260], word(50) + items[7][1]]
    for edits in (0, 1):
        index = ItemIndex(items, edits=edits)
        assert {(t, i) for t, i, *_ in index.search(docs)} == {(1, 3), (2, 7)}
        assert max(count.max() for _, _, _, count, *_ in index.tables) <= 32  # the common beginning is left out
    same = [(i, head) for i in range(100)]
    assert len(ItemIndex(same, edits=1).search([head])) == 100  # but not where there is nothing else
    d = spark.createDataFrame([(1, "The other people come here below")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "hello"), (2, "abcde"), (3, "below")], "item_id bigint, text string")
    assert [r.item_id for r in leaked_items(d, i, edits=0).collect()] == [3]


def test_leak_rows(spark):
    d = spark.createDataFrame([(1, "Intro. The QUICK, brown fox! jumps over it", 5), (2, None, 5), (3, "", 5), (4, "unrelated words", 5), (1, "Intro. The QUICK, brown fox! jumps over it", 5), (5, "x" * 200_000 + "thequickbrownfox", 5)], "doc_id bigint, text string, item_id bigint")
    i = spark.createDataFrame([(9, "the quick brown fox jumps over the lazy dog"), (8, None), (7, "…")], "item_id bigint, text string")
    assert {tuple(r) for r in leaked_items(d, i).select("doc_id", "item_id").collect()} == {(1, 9), (5, 9)}
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


NAMES = ["lamp", "mask", "sword", "map", "bell", "crown", "letter", "shield"]


def story(rng, n=12):
    return " ".join(rng.choice([f"Take the {rng.choice(NAMES)} and bring it to the old {rng.choice(['queen', 'scholar', 'captain'])} of hall {rng.randrange(900)}.", f"Nobody has returned with the {rng.choice(NAMES)} since winter {rng.randrange(900)}.",
                                    f"We have waited {rng.randrange(900)} days for the {rng.choice(NAMES)}."]) for _ in range(n))


@pytest.fixture(scope="module")
def stories():
    rng = random.Random(5)
    return [story(rng) for _ in range(300)]


def test_alignment():
    long = "One two three four five six seven eight nine ten. " * 2 + "Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    assert ends_early(long[:-16], long) and ends_early(long[:-4], long)
    assert not ends_early(long, long) and not ends_early("One two three", long)
    assert not ends_early(long, long + " End here.")  # ends with a unit of its partner
    assert shared(Words([long[:57]]).hash, Words([long]).hash) == 1 and ends_early(long.upper()[:-16], long) and ends_early(long[:58], long)
    assert not ends_early(long[:-16].replace("three", "drei").replace("seven", "sieben").replace("nine", "neun"), long)


def test_held_out_cuts(stories):
    m = CutModel(stories[:200])
    rng = random.Random(9)
    cut = [t[:t.rindex(" ", 0, len(t) - 12)][:-1] for t in stories[200:]]
    assert sum(m.probability(t) >= 0.5 for t in cut) >= 90 and sum(m.probability(t) >= 0.5 for t in stories[200:]) == 0
    assert m.probability(stories[0] + "\n— Anna") == 0 and m.probability(None) == 0 and m.probability("…") == 0 and CutModel([]).probability("x") == 0
    assert rng


def test_cut_documents(spark, stories):
    m = CutModel(stories)
    whole = stories[0]
    at = whole.rindex(".", 0, -1) + 12
    rows = [(1, whole, "a", 0.1), (2, whole[:at], "a", 0.1), (3, whole[:at], "b", 0.1), (4, None, "b", 0.1), (5, "", None, 0.1), (6, stories[1], None, 0.1)] + [(10 + i, stories[2], "c", 0.1) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, p double")
    got = {(r.doc_id, r.by, r.partner) for r in cut_documents(d, m).collect()}
    assert got == {(2, "alignment", 1), (3, "alignment", 1)}
    shares = {r.source: (r.documents, r.cut) for r in cuts_by_source(d, cut_documents(d, m)).collect()}
    assert shares == {"a": (2, 1), "b": (2, 1), None: (2, 0), "c": (200, 0)}
    assert cut_documents(d.limit(0), m).count() == 0


def test_endings_are_counted_over_every_text(spark):
    """More texts than any sample had: the counts of the table are those of all its texts, and repeated texts count once."""
    texts = [f"The gate {i} is open. Go to tower number {i} now." for i in range(4500)] + [f"Gate {i}.\nno dot" for i in range(3)] + [f"Gate {i}.\nonly once" for i in range(2)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    keys, valid = end_keys(["The gate 7 is open.", "Go to tower number 8 now.", "no dot", "only once", "is op"])
    uses = spark.createDataFrame([(int(k), 1) for k in np.unique(keys[valid])], "key bigint, uses bigint")
    got = {r.key: (r.a, r.b) for r in TableCutModel._counts(table, uses, 3).collect()}
    whole = [u for t in texts for u in units(t) if ends_full(u) or u == "no dot"]
    want = {k: (a, b) for k, a, b in zip(*(x.tolist() for x in end_counts(whole)))}
    asked = set(keys[valid].tolist())
    assert {k: v for k, v in got.items() if k in asked} == {k: v for k, v in want.items() if k in asked}
    assert got[int(keys[0, 0])] == (4500, 0)  # 'open' ends a unit in each of them
    a, b = (np.array([[got.get(int(k), (0, 0))[i] if v else 0 for k, v in zip(*x)] for x in zip(keys, valid)], float) for i in (0, 1))
    assert np.allclose(end_scores(a, b, valid), EndModel(whole).scores(["The gate 7 is open.", "Go to tower number 8 now.", "no dot", "only once", "is op"]))


def test_logistic_of_a_table_is_that_of_its_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)).round(1)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    table = spark.createDataFrame([(r.tolist(), int(1 - v), int(v)) for r, v in zip(x, y)], "x array<double>, n0 bigint, n1 bigint").repartition(3)
    assert np.allclose(Logistic.of_table(table).probability(x), Logistic(x, y.astype(float)).probability(x), atol=1e-6)
    assert Logistic.of_table(table.where("n1 = 0")) is None and Logistic.of_table(table.limit(0)) is None


def test_model_of_a_table_finds_cuts(spark, stories):
    cut = {1000 + i: t[:t.rindex(" ", 0, len(t) - 12)][:-1] for i, t in enumerate(stories[200:])}
    d = spark.createDataFrame([(i, t, "a") for i, t in enumerate(stories[:200])] + [(i, t, "a") for i, t in cut.items()] + [(5000 + i, t, "a") for i, t in cut.items()] + [(9000, None, "a"), (9001, "", "a")], "doc_id bigint, text string, source string")
    got = {r.doc_id for r in cut_documents(d, train_cut_model(d)).collect()}
    assert not [i for i in got if i < 1000] and len(got) >= 1.8 * len(cut) and {i for i in got if i < 5000} == {i - 5000 for i in got if i >= 5000}
    assert cut_documents(d.limit(0), train_cut_model(d.limit(0))).count() == 0


def test_copies_cut_anywhere_are_found_by_alignment(spark):
    """120 copies, each cut inside a word at 95 to 10 per cent, some with a word changed; the model of endings is empty, so that only alignment can find them."""
    rng = random.Random(21)
    rows, cut = [], {}
    for i in range(120):
        text = story(rng, rng.randrange(6, 30))
        rows.append((i, text))
        for k, share in enumerate((0.95, 0.85, 0.7, 0.5, 0.3, 0.1)):
            at = int(len(text) * share)
            while not (text[at - 2:at + 1].isalpha()):
                at -= 1
            part = text[:at].split(" ")
            if i % 3 == 0 and len(part) > 30:
                part[rng.randrange(len(part) - 1)] = "perhaps"
            cut[1000 * (k + 1) + i] = share
            rows.append((1000 * (k + 1) + i, " ".join(part)))
    d = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id bigint, text string, source string")
    got = {r.doc_id for r in cut_documents(d, CutModel([])).where("by = 'alignment'").collect()}
    assert got <= set(cut)
    for share in sorted(set(cut.values())):
        want = {i for i, s in cut.items() if s == share}
        assert len(got & want) >= 0.95 * len(want), (share, len(got & want), len(want))


def test_words_and_levels():
    texts = ["", "One two-THREE 4", "今日はABC", "두토 말", "…"]
    w = Words(texts)
    assert w.count.tolist() == [0, 4, 4, 2, 0] and levels(13).tolist() == [5, 6, 8, 10, 12]
    assert w.hash[0] == Words(["x ONE"]).hash[1] and len(set(w.hash.tolist())) == 10
    text, level, keys = Words(["a b c d e f g h"] * 2 + ["a b c d"]).keys()
    assert text.tolist() == [0, 0, 0, 1, 1, 1] and level.tolist() == [0, 1, 2] * 2 and (keys[:3] == keys[3:]).all()
    again = Words(["a b c d e f x y z"]).keys()[2]
    assert (again[:2] == keys[:2]).all() and not (again[2] == keys[2]).all()


def test_partner_behind_longer_members_of_its_buckets(spark):
    rng = random.Random(8)
    head, tails = story(rng, 25), [story(rng, 2) for _ in range(30)]
    cut = head + " Take the silver lamp and bring"
    rows = [(1, cut + " it to the old queen.", "a"), (2, cut, "a")]
    rows += [(10 + i, f"{cut}. {t}", "a") for i, t in enumerate(tails)]  # longer than the partner, but there the cut is an end
    rows += [(100, story(rng, 9), "a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.by, r.partner) for r in cut_documents(d, CutModel([])).collect()} == {(2, "alignment", 1)}


def test_allocation():
    got = allocate({"a": 1000, "b": 10, "x": 5}, {"a": 0.5, "b": 0.3, "gone": 0.2}, {"a": 2, "b": 3, "gone": 9}, 1010)
    assert got["b"] == 30 and abs(got["a"] - 980) < 1e-6 and got["gone"] == 0
    assert allocate({}, {}, {}, 0) == {}
    c = inclusion_scale([(2.0, 10, 100), (4.0, 5, 100)], 60)
    assert abs(min(1, 2 * c) * 100 + min(1, 4 * c) * 100 - 60) < 1e-6


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer file")
def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b"]) if i % 50 else "tiny", story(rng, 1 + i % 7), "t") for i in range(1500)] + [(5000, "none", "words here", "t"), (5001, None, "words", "t"), (5002, "a", None, "t"), (5003, "a", "", "t")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    t = spark.createDataFrame([("a", 0.4, 2), ("b", 0.5, 3), ("tiny", 0.05, 2), ("absent", 0.05, 4), (None, 1.0, 1), ("neg", -1.0, 1)], "source string, weight double, max_repeats bigint")
    m = Mixture(d, t)
    shares = {r.source: r for r in m.shares.collect()}
    assert abs(shares["a"].share - shares["a"].planned) < 0.01 and abs(shares["b"].share - shares["b"].planned) < 0.01
    assert shares["tiny"].most_copies <= 2 and shares["absent"].used == 0 and shares["none"].used == 0 and shares[None].used == 0
    chosen = m.chosen
    assert chosen.count() == chosen.select("doc_id").distinct().count() and chosen.where("copies > 3 or source = 'none'").count() == 0
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in Mixture(d, t).chosen.collect()}
    assert Mixture(d.limit(0), t).chosen.count() == 0 and Mixture(d, t.limit(0)).chosen.count() == 0 and Mixture(d.limit(0), t).shares.count() == 4
    n = count_tokens(d.select("doc_id", "text")).agg(F.sum("tokens")).first()[0]
    assert n > 1500
