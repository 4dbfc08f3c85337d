import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingoweave.llm.copies import Copies, canonical_digest, entry_copies, filter_bits
from lingoweave.llm.filters import SentFilter
from lingoweave.llm.packing import fill_requests, fill_summary, hilbert, pack

E = "ord bigint, source string, context string, digest string"


def groups(spark, rows):
    c = entry_copies(spark.createDataFrame(rows, E))
    members = {tuple(r) for r in c.members.collect()}
    records = {tuple(r) for r in c.records.collect()}
    return members, records


def test_formatting_does_not_matter_but_letters_do(spark):
    m, r = groups(spark, [(3, "Hello, World!", "a|map:1", None), (1, "hello world", "MAP 1; a", "x"), (2, "hello worlds", "a|map:1", None), (4, "hello world", "a|map:2", None), (5, "HELLO  WORLD", "a,,map:1/", None),
                          (6, None, "a", None), (7, "…", "a", None), (8, "x", None, None), (9, "x", "||", None), (10, "Straße", "a", None), (11, "STRASSE", "a", None)])
    assert m == {(1, 1), (1, 3), (1, 5), (10, 10), (10, 11)}
    assert r == {(1, 3), (2, 1), (4, 1), (10, 2)}


def test_empty_table_and_full_filter(spark):
    assert groups(spark, []) == (set(), set())
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    df = rows.select(F.col("id").alias("ord"), canonical_digest(F.col("t"), F.lit("c")).alias("digest"))
    for bits in (1, 16):  # a filter that is far too small only moves more rows
        c = Copies(df, bits)
        assert c.members.count() == 1000 and c.members.where("first_ord <> 0").count() == 0
        assert c.records.count() == 2001 and c.records.agg(F.sum("copies")).first()[0] == 3000
    assert filter_bits(0) == filter_bits(5) and filter_bits(10 ** 15) == 1 << 31


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=200), st.integers(1, 120))
def test_pack_keeps_all_and_cuts_only_what_is_too_long(sizes, capacity):
    pieces, n = pack(sizes, capacity)
    load = [0] * n
    seen = {}
    for item, part, size, box in pieces:
        load[box] += size
        seen.setdefault(item, []).append((part, size))
    assert all(x <= capacity for x in load) and sorted(seen) == list(range(len(sizes)))
    for i, s in enumerate(sizes):
        assert sum(x for _, x in seen[i]) == s and len(seen[i]) == max(1, -(-s // capacity)) and [p for p, _ in sorted(seen[i])] == list(range(len(seen[i])))
    if n > 140:
        assert n <= sum(sizes) / capacity * 1.7 + 65


def test_hilbert_curve_is_one_to_one_and_its_steps_are_neighbours():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_requests(spark):
    e = spark.createDataFrame([(1, None, None, "p"), (2, "x" * 25, "yyy", "p"), (3, "", "z", "p"), (4, "ab", None, "p"), (5, "ab", None, "p")], "ord bigint, source string, context_text string, provider string")
    limits = spark.createDataFrame([("a", 10), ("b", 1000), ("bad", 0), (None, 5)], "provider string, max_chars bigint")
    r = fill_requests(e, limits)
    rows = r.collect()
    assert {x.ord for x in rows if x.provider == "a"} == {1, 2, 3, 4, 5} and sum(x.chars for x in rows if x.provider == "a") == 33
    assert [(x.from_char, x.chars, x.parts) for x in sorted(rows, key=lambda x: x.part_no) if x.provider == "a" and x.ord == 2] == [(0, 10, 3), (10, 10, 3), (20, 8, 3)]
    assert {x.provider for x in rows} == {"a", "b", None}
    assert fill_summary(r.where("provider is not null"), limits).where("fill <= 1").count() == 2
    assert fill_requests(e.limit(0), limits).count() == 0 and fill_requests(e, limits.limit(0)).count() == 0


def test_requests_are_full_and_a_hot_text_spreads(spark):
    e = spark.range(20_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "Yes").otherwise(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("source"), F.lit(None).cast("string").alias("context_text"))
    limits = spark.createDataFrame([("a", 500)], "provider string, max_chars bigint")
    r = fill_requests(e, limits)
    assert r.count() == 20_000 and fill_summary(r, limits).first().fill > 0.97
    assert r.join(e, "ord").where("source = 'Yes'").select((F.col("request_no") / (1 << 32)).cast("int").alias("p")).distinct().count() > 1


def test_filters_by_range(spark):
    """Many small filters, one after the other, find the same groups as one."""
    import hashlib
    from collections import Counter

    rows = [(i, hashlib.md5(str(i % 700 if i % 3 else i).encode()).digest()) for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "ord bigint, digest binary")
    n = Counter(d for _, d in rows if d)
    expected = sorted((min(o for o, x in rows if x == d), k) for d, k in n.items())
    for most in (1 << 18, 12_000):
        c = Copies(df, most_bits=most)
        assert sorted(map(tuple, c.records.collect())) == expected
        assert c.members.count() == sum(k for k in n.values() if k > 1)


def test_packer_as_a_stream():
    import random

    from lingoweave.llm.packing import Packer, pack

    rng = random.Random(6)
    sizes = [rng.randrange(0, 40) if i % 50 else rng.randrange(100, 400) for i in range(5000)]
    whole, boxes = pack(sizes, 100)
    p, out, most = Packer(100), [], 0
    for i in range(0, 5000, 37):
        out += p.add(sizes[i:i + 37])
        most = max(most, p.items - p.waiting_from)
    assert [*out, *p.finish()] == whole and p.boxes == boxes and most < 2000


def test_filter_in_pieces_holds_what_one_bitmap_holds(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    whole, parts = SentFilter(keys, 40_000), SentFilter(keys, 40_000, piece=1 << 18)
    assert len(whole.sent) == 1 and len(parts.sent) == 4 and all(len(x.value) * 8 == 1 << 18 for x in parts.sent)  # no more than a piece comes to the driver
    own = np.array([r.h for r in keys.collect()])
    other = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 50_000)
    assert parts.holds(own).all() and (parts.holds(other) == whole.holds(other)).all() and parts.holds(other).mean() < 0.01
    parts.destroy()
