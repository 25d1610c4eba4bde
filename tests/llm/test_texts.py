import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gitsift.llm.leaks import SizeClass, Tolerance, holds, leaked_items, shingles, size_classes
from gitsift.llm.mixture import TOKENIZER, balance, mix, shares, sums_before, token_counts
from gitsift.llm.spans import Anchors, Lengths, class_members, deep_nodes, shared_places, shared_portion, sharing_pairs

WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "ul", "an", "ör")]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# ---- spans

def pairs_by_hand(docs, length):
    at = {}
    for i, t in docs:
        for k in range(len(t or "") - length + 1):
            at.setdefault(t[k : k + length], set()).add(i)
    return {(a, b) for s in at.values() for a in s for b in s if a < b}, at


def portion_by_hand(docs, at, length):
    out = {}
    for i, t in docs:
        seen = set()
        for k in range(len(t or "") - length + 1):
            if len(at[t[k : k + length]]) > 1:
                seen.update(range(k, k + length))
        out[i] = len(seen)
    return out


def planted(seed, length, n=60):
    r = random.Random(seed)
    docs = [text(r, r.randrange(5, 40)) for _ in range(n)]
    for _ in range(50):  # spans around the limit, in any place, some inside one another
        a, b = r.randrange(n), r.randrange(n)
        size = length + r.choice([-2, -1, 0, 1, 7, 60])
        at = r.randrange(max(1, len(docs[a]) - size))
        piece, where = docs[a][at : at + size], r.randrange(len(docs[b]) + 1)
        docs[b] = docs[b][:where] + piece + docs[b][where:]
    docs += [docs[3], docs[3], "ab" * 70, "ab" * 90, "🔧é" * 60, "x🔧é" * 60, "a" * 150, "a" * 99, "", None, "short", "a" * (length - 1)]
    return list(enumerate(docs))


@pytest.mark.parametrize("length,max_group", [(60, 4000), (60, 2), (60, 10), (25, 4000), (8, 5), (2, 4000)])
def test_spans_equal_brute_force(spark, length, max_group):
    docs = planted(length, length)
    if length == 2:
        docs = docs[:12] + docs[-12:]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs] + [(None, "x" * 500, 1, "c")], "doc long, body string, start int, class string").repartition(3)
    places = shared_places(df, "doc", "body", length, max_group).cache()
    want, at = pairs_by_hand(docs, length)
    got = [tuple(r) for r in sharing_pairs(places).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    by_hand = portion_by_hand(docs, at, length)
    assert {r.doc: r.shared_chars for r in shared_portion(df.where("doc is not null"), "doc", "body", places).collect()} == by_hand


def test_frequent_footer_is_split(spark, monkeypatch):
    """One footer in most texts, longer than the span on the right or reached only from the left: over-full at first, parts afterwards."""
    import gitsift.llm.spans as spans

    monkeypatch.setattr(spans, "LEAVES", 3)
    r = random.Random(7)
    footer = text(r, 30)
    docs = [(i, text(r, r.randrange(3, 20)) + footer[: r.choice([55, 70, 90, 200])] + text(r, r.randrange(0, 9))) for i in range(60)]
    docs += [(100 + i, text(r, 4) + footer[20:75] + text(r, 9)) for i in range(8)]
    df = spark.createDataFrame(docs, "doc long, body string").repartition(3)
    want, at = pairs_by_hand(docs, 60)
    for most in (4000, 12, 1):
        places = shared_places(df, "doc", "body", 60, most).cache()
        assert {tuple(x) for x in sharing_pairs(places).collect()} == want
        cover = {x.doc: x.shared_chars for x in shared_portion(df, "doc", "body", places).collect()}
        assert cover == portion_by_hand(docs, at, 60)
        stretches = {(x.id, x.start, x.end) for x in places.select("id", "start", "end").collect()}
        lines = dict(docs)
        assert all(e - s >= 60 and len(at[lines[i][s : s + 60]]) > 1 and len(at[lines[i][e - 60 : e]]) > 1 for i, s, e in stretches)
        sizes = [tuple(x) for x in class_members(places).groupBy("class").agg(F.count("id"), F.max("n"), F.min("n")).collect()]
        assert sizes and all(a == b == c for _, a, b, c in sizes)


def test_very_long_text(spark, monkeypatch):
    import gitsift.llm.spans as spans

    monkeypatch.setattr(spans, "CHUNK", 1000)
    r = random.Random(1)
    big = text(r, 4000)
    a = Anchors(Lengths(100))
    codes = spans._codes(big)
    whole, _ = a.of(codes[:1200])
    assert len(whole) and (np.diff(whole) <= 50).all()
    rows = next(spans._anchor_rows(100)(iter([__import__("pyarrow").RecordBatch.from_pydict({"id": [1], "text": [big]})])))
    pos = np.unique(rows.column(2).to_numpy())
    assert (np.diff(pos) <= 50).all() and pos[0] < 50 and pos[-1] > len(big) - 200


def test_empty_table_and_single_record(spark):
    schema = "doc long, body string"
    none = spark.createDataFrame([], schema)
    assert sharing_pairs(shared_places(none, "doc", "body", 10)).count() == 0
    one = spark.createDataFrame([(1, "abcdefghij" * 9)], schema)
    assert shared_places(one, "doc", "body", 10).count() == 0


def test_deep_nodes():
    got = {(d, a, b) for d, a, b in deep_nodes(["aab", "aabc", "aabc", "ab", "b"])}
    assert got == {(3, 0, 3), (4, 1, 3), (1, 0, 4), (0, 0, 5)}


# ---- leaks

def test_alignment_is_exact():
    r = random.Random(3)
    tol = Tolerance(6, 3)

    def by_hand(item, doc):
        n = len(item)
        for i in range(n):
            for j in range(i + min(n, tol.least), n + 1):
                part = item[i:j]
                row = [0] * (len(doc) + 1)
                for x in part:
                    new = [row[0] + 1]
                    for k, y in enumerate(doc, 1):
                        new.append(min(new[-1] + 1, row[k] + 1, row[k - 1] + (x != y)))
                    row = new
                if min(row) <= tol.edits(len(part)):
                    return True
        return False

    for _ in range(300):
        item = [r.randrange(6) for _ in range(r.randrange(1, 12))]
        doc = [r.randrange(6) for _ in range(r.randrange(0, 14))]
        assert holds(np.array(item), np.array(doc, dtype=int), tol) == by_hand(item, doc)


def test_least_shared_shingles():
    assert [Tolerance().shared(n) for n in (5, 9, 10, 19, 20, 40)] == [1, 5, 1, 10, 6, 6]


def leak_tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item int").repartition(3)
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc int")


def leaks(spark, docs, items, **kw):
    d, t = leak_tables(spark, docs, items)
    rows = [(r.doc, r.item) for r in leaked_items(d, "doc_id", "text", t, "item_id", "text", **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_leaks_found_and_decoys_left(spark):
    r = random.Random(8)
    item = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(25)]
    fill = lambda n: text(r, n)
    j = " ".join
    edited = item[5:25]
    edited[6], edited[13] = "zz", "yy"
    over = list(edited)
    over[17] = "xx"
    missing = item[:9] + item[10:19] + item[20:22]
    added = item[3:10] + ["q1"] + item[10:16] + ["q2"] + item[16:23]
    docs = {
        1: fill(50) + " " + j(item) + " " + fill(50),
        2: fill(300) + " " + j(item[10:30]) + " " + fill(300),
        3: j(item[10:27]) + " " + fill(80),
        4: fill(33) + " " + j(edited) + " " + fill(9),
        5: fill(33) + " " + j(over) + " " + fill(9),
        6: fill(21) + " " + j(missing) + " " + fill(60),
        7: fill(21) + " " + j(added) + " " + fill(60),
        8: "<p class='x'>" + "<br/>\r\n ".join(w.upper() + "," for w in item) + "&nbsp;</p>",
        9: fill(40) + " " + j(item[:10]) + " " + fill(20) + " " + j(item[30:]),
        10: fill(10) + j([""] + other + [""]) + fill(2000) + " " + j(item[20:]),
        11: j(sorted(item, key=lambda _: r.random())),
        12: None, 13: "", 14: "w1",
        15: "_".join(item),
        16: "if a < w1 and " + j(item) + " > 3",
        17: fill(5) + " one two three " + fill(5), 18: "one two", 19: "three one two THREE!",
    }
    items = [(100, j(item)), (200, j(other)), (300, "one two three"), (400, None), (500, ""), (None, j(item)), (600, "..."), (700, "w3 w4 w5 w6 w7 w8 w9")]
    want = {(d, 100) for d in (1, 2, 4, 6, 7, 8, 15, 16, 10)} | {(10, 200), (17, 300), (19, 300)} | {(d, 700) for d in (1, 7, 8, 9, 15, 16)}  # 6 lacks w9
    assert leaks(spark, docs.items(), items) == want
    assert leaks(spark, docs.items(), items, most_bits=64) == want  # a bitmap that is full


def test_leak_recall_at_the_edge(spark):
    r = random.Random(5)
    items = [(k, " ".join(f"i{k}x{n}" for n in range(r.randrange(34, 42)))) for k in range(60)]
    docs, want = [], set()
    for d in range(400):
        k, words = items[d % 60]
        w = words.split()
        at = r.randrange(len(w) - 20)
        part = w[at : at + 20]
        part[6], part[13] = "changed", "words"
        docs.append((d, text(r, r.randrange(0, 200)) + " " + " ".join(part) + " " + text(r, r.randrange(0, 200))))
        want.add((d, k))
    got = leaks(spark, docs, items)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_leaks_without_rows(spark):
    assert leaks(spark, [], [(1, "a b c d e f")]) == set() and leaks(spark, [(1, "a b c d e f")], []) == set()


def test_passages_beyond_the_shortest(spark):
    """More edits than a passage of the least length may have, and items much longer than a window."""
    r = random.Random(11)
    items = [(k, [f"i{k}x{n}" for n in range(size)]) for k, size in enumerate([39, 39, 60, 300, 300, 19, 12, 9, 25])]
    docs, want = [], set()

    def add(words, k, true):
        docs.append((len(docs), text(r, r.randrange(90)) + " " + " ".join(words) + " " + text(r, r.randrange(90))))
        if true:
            want.add((len(docs) - 1, k))

    for k in (0, 1):  # 30 words with three edits in the middle: no 20 of them have only two
        for at in (0, 4, 9):
            w = items[k][1][at : at + 30]
            for e in (11, 14, 17):
                w[e] = "zz"
            add(w, k, True)
            w[13] = "zz"
            add(w, k, False)
    for k in (3, 4):
        for at in (0, 17, 100, 280):
            add(items[k][1][at : at + 20], k, True)
            add(items[k][1][at : at + 17], k, False)
    add(items[2][1], 2, True)
    w = list(items[5][1])
    w[9] = "zz"
    add(w, 5, True)
    add(w[:9] + ["yy"] + w[9:], 5, False)
    add(items[6][1][:5] + items[6][1][6:], 6, True)
    add(items[7][1], 7, True)
    add(items[7][1][:4] + ["zz"] + items[7][1][5:], 7, False)
    assert leaks(spark, docs, [(k, " ".join(w)) for k, w in items]) == want


def test_no_edits_allowed(spark):
    item = [f"w{i}" for i in range(33)]
    docs = [(1, " ".join(item[4:24])), (2, " ".join(item[4:23])), (3, " ".join(item[:10] + ["x"] + item[10:29])), (4, "x " + " ".join(item[13:]) + " y"), (5, "a b c d"), (6, "a b x c d")]
    assert leaks(spark, docs, [(1, " ".join(item)), (2, "a b c d")], tol=Tolerance(20, 0)) == {(1, 1), (4, 1), (5, 2)}


def test_repeated_words_and_rows(spark):
    items = [(1, "la " * 30), (2, "a b " * 15), (1, "la " * 30)]
    docs = [(1, "la " * 25), (2, "la " * 10 + "x " * 9), (3, "a b " * 40), (3, "a b " * 40), (4, "b a " * 11)]
    assert leaks(spark, docs, items) == {(1, 1), (3, 2), (4, 2)}


def test_size_classes():
    classes = size_classes(Tolerance(), 0.99)
    lows = [c.low for c in classes]
    assert lows == [1, 2, 3, 4, 5, 7, 9, 12, 16, 20] and [c.size for c in classes] == [1, 2, 3, 4, 5, 5, 5, 5, 5, 5]
    assert classes[-1].need == 6 and classes[-1].block == 18 and all(c.n_hashes > 1 for c in classes)
    assert len(shingles(np.arange(4, dtype=np.uint64), 5)) == 0 and SizeClass(20, None, Tolerance(), 0.999).n_hashes > classes[-1].n_hashes
    first, past = classes[-1].item_sets(200)
    assert first[0] == 0 and past[-1] == 200 and (first[1:] < past[:-1]).all()


# ---- mixture

def counts_of(spark, sizes):
    rows = [(k, s, n, 1) for k, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    return spark.createDataFrame(rows, "id long, source string, n_tokens long, rate int").repartition(3)


def targets_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    r = random.Random(2)
    sizes = {"big": [r.randrange(1, 400) for _ in range(1500)], "mid": [r.randrange(1, 900) for _ in range(200)], "small": [r.randrange(10, 90) for _ in range(60)], "equal": [50] * 400, "other": [10] * 50, None: [10] * 50}
    counts = counts_of(spark, sizes)
    targets = targets_of(spark, [("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("equal", 0.2, 2), ("absent", 0.1, 5)])
    mixed = mix(counts, targets, rows_a_group=40).cache()
    rows = mixed.collect()
    assert {x.source for x in rows} == {"big", "mid", "small", "equal"} and len({x.id for x in rows}) == len(rows)
    cap = {"big": 1, "mid": 2, "small": 3, "equal": 2}
    assert all(0 <= x.copies <= cap[x.source] and abs(x.copies - x.rate) < 1 for x in rows)
    tokens = Counter()
    for x in rows:
        tokens[x.source] += x.copies * x.n_tokens
    total = sum(tokens.values())
    for s, share in (("big", 0.3), ("mid", 0.3), ("small", 0.1), ("equal", 0.2)):
        assert abs(tokens[s] - share / 0.9 * total) <= 2 * max(sizes[s])
    assert tokens["small"] == 3 * sum(sizes["small"])  # the source that bounds the total is used to its limit
    report = {x.source: x for x in shares(mixed, targets).collect()}
    assert (report["absent"].copies, report["absent"].actual_share) == (0, 0) and report["small"].most_copies == 3
    assert sum(x.actual_share for x in report.values()) == pytest.approx(1)
    # rates are exponentially tilted: equal logarithmic slope wherever no cap applies
    slopes = [np.log(x.rate) / x.n_tokens for x in rows if x.source == "mid" and x.rate < 2 and x.n_tokens > 5]
    assert np.allclose(slopes, slopes[0])


def test_smaller_total(spark):
    sizes = {"a": list(range(1, 200)), "b": list(range(1, 300))}
    mixed = mix(counts_of(spark, sizes), targets_of(spark, [("a", 0.5, 3), ("b", 0.5, 3)]), total_tokens=10_000)
    got = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert abs(got["a"] - 5000) <= 200 and abs(got["b"] - 5000) <= 300


def test_unsettled_multipliers_are_an_error(spark):
    cells = spark.createDataFrame([("a", n, 3) for n in range(1, 90)] + [("b", 7, 5)], "source string, n_tokens long, n long")
    targets = targets_of(spark, [("a", 0.5, 4), ("b", 0.5, 4)])
    assert balance(cells, targets, None)["a"].done
    with pytest.raises(RuntimeError, match="1 steps"):
        balance(cells, targets, None, max_steps=1)


def test_sums_before(spark):
    r = random.Random(4)
    cells = sorted({(r.choice("xy"), r.randrange(4), r.randrange(3), r.randrange(3)) for _ in range(60)})
    df = spark.createDataFrame([(*c, k) for k, c in enumerate(cells)], "s string, a int, b int, c int, v long").repartition(3)
    got = {(x.s, x.a, x.b, x.c): x.before for x in sums_before(df, ["s"], ["a", "b", "c"], "v").collect()}
    assert got == {c: sum(k for k, d in enumerate(cells) if d[0] == c[0] and d < c) for c in cells}


def test_one_length_in_slices(spark):
    sizes = {"a": [40] * 900, "b": [40] * 600 + list(range(1, 60))}
    counts, targets = counts_of(spark, sizes), targets_of(spark, [("a", 0.3, 2), ("b", 0.7, 2)])
    for kw in ({}, {"rows_a_group": 50}, {"rows_a_group": 50, "most_cut": 5}):
        got = {x.source: (x.t, x.n, x.most) for x in mix(counts, targets, **kw).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).collect()}
        total = 2 * sum(sizes["b"]) / 0.7
        assert abs(got["a"][0] - 0.3 * total) <= 40 and got["b"][0] == 2 * sum(sizes["b"]) and (got["a"][1], got["b"][1]) == (900, 659)


def test_nothing_to_mix(spark):
    none = counts_of(spark, {})
    t = targets_of(spark, [("a", 1.0, 1)])
    assert mix(none, t).count() == 0 and mix(counts_of(spark, {"a": [0, 0], "b": [5]}), t).count() == 0
    assert mix(counts_of(spark, {"a": [5]}), targets_of(spark, [("a", None, 1), (None, 0.5, 1)])).count() == 0
    assert shares(mix(none, t), t).first().actual_share in (0, None)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "s", "hello world"), (2, None, None), (3, "s", ""), (4, "s", "<|endoftext|>"), (5, "s", "a" * 200_000)], "doc_id long, source string, text string")
    got = {r.id: r.n_tokens for r in token_counts(df, "doc_id", "source", "text", TOKENIZER).collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] > 1 and got[5] > 1000
