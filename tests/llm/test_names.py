import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gitsift.llm.names import BKTree, Decorations, any_order_faults, faults_allowed, map_names
from gitsift.llm.queries_names import PACKAGES


def damerau(a, b):
    """Distance with swaps, edits between the swapped letters included: shortest path over strings is too slow, so the usual table."""
    last, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            cost = a[i - 1] != b[j - 1]
            if not cost:
                at = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@pytest.mark.parametrize("length", [(1, 8), (5, 12), (60, 80)])
def test_tree_returns_every_entry_within_reach(length):
    r = random.Random(length[0])
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(*length)))
    entries = sorted({word() for _ in range(80)})
    asked = [word() for _ in range(60)] + [e[:2] + e[3:] for e in entries[:20]] + ["", "zzz"]
    tree = BKTree(entries)
    got = {(q, tree.words[w]): f for q, w, f in tree.within(asked)}
    want = {(q, e): damerau(a, e) for q, a in enumerate(asked) for e in entries if damerau(a, e) <= faults_allowed(len(e))}
    assert got == want


def test_words_in_any_order_equal_brute_force():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    for _ in range(400):
        words, lead = [word() for _ in range(r.randrange(1, 6))], r.choice(["", "a/"])
        typed = list(lead + "".join(r.sample(words, len(words))))
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(typed) + 1)
            typed[at : at + r.randrange(2)] = r.choice(["", "a", "b"])
        typed = "".join(typed)
        least = min(damerau(lead + "".join(p), typed) for p in set(permutations(words)))
        for most in (0, 1, 2):
            assert any_order_faults(typed, lead, words, most) == (least if least <= most else None)


def test_many_equal_words_end():
    assert any_order_faults("ab" * 30, "", ["a", "b"] * 30, 2) == 0 and any_order_faults("b" * 31 + "a" * 28, "", ["a", "b"] * 30, 2) == 2


def test_letters_tree_returns_every_entry_within_reach():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))
    entries, asked = sorted({word() for _ in range(80)}), [word() for _ in range(60)] + ["", "zzz"]
    tree = BKTree(entries, letters=True)
    q, w = tree.near(*tree.encode(asked), 1)
    far = lambda a, b: max(sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values()))
    assert sorted(zip(q.tolist(), (tree.words[x] for x in w))) == sorted((i, e) for i, a in enumerate(asked) for e in entries if far(a, e) <= faults_allowed(len(e)))


def test_long_list_in_shards(spark):
    """10^5 entries of one namespace, in shards: every typed name comes back to the entry it was made from, or to one nearer by the ranking."""
    r = random.Random(6)
    entries = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(100_000)})
    some = r.sample(entries, 60)
    names = [("s", e[:5] + "z" + e[6:]) for e in some[:30]] + [("s", e[:3] + e[4] + e[3] + e[5:]) for e in some[30:]]
    got = mapped(spark, names, [("s", e) for e in entries], decorations={}, shard_entries=20_000)
    near = lambda n, e: damerau(n, e) <= 1
    assert all(got[n] == e or near(n[1], got[n]) for n, e in zip(names, some))


def test_empty_tree():
    assert BKTree([]).within(["a"]) == [] and BKTree(["a"]).within([]) == []


def frames(spark, names, entries):
    typed = spark.createDataFrame([(s, n, "clash") for s, n in names], "space string, name string, entry string")
    return typed, spark.createDataFrame([(s, n, 1) for s, n in entries], "space string, name string, faults int")


def mapped(spark, names, entries, decorations=PACKAGES, **kw):
    kw["decorations"] = decorations
    return {(r.space, r.name): r.entry for r in map_names(*frames(spark, names, entries), **kw).collect()}


ENTRIES = [("npm", "left-pad-core"), ("npm", "@org/thing"), ("npm", "router"), ("npm", "router-stream"), ("pypi", "requests_html"), ("go", "codeforge.example/a/box-go"), ("rubygems", "abcdefgh"), ("npm", "alpha-beta-gamma-delta"), ("npm", "alpha-beta-gamma-delta-omega")]


CASES = [
    ("npm", "left-pad-core", "left-pad-core"),
    ("npm", "LEFT_PAD.CORE", "left-pad-core"),
    ("npm", "leftpadcore", "left-pad-core"),
    ("npm", "core-left-pad", "left-pad-core"),
    ("npm", "lfet-pad-coer", "left-pad-core"),
    ("npm", "left-pad-core@1.2.3", "left-pad-core"),
    ("npm", " left-pad-core v2.1\t", "left-pad-core"),
    ("npm", "left-pad-core[cli]", "left-pad-core"),
    ("npm", "left-pad-core.git", "left-pad-core"),
    ("npm", "lеft-pad-cоre", "left-pad-core"),
    ("npm", "left​-pad-core", "left-pad-core"),
    ("npm", "node-left-pad-core", "left-pad-core"),
    ("npm", "left-pad-core-js", "left-pad-core"),
    ("npm", "@org/thinh", "@org/thing"),
    ("npm", "router-streem", "router-stream"),
    ("npm", "routerr", "router"),
    ("npm", "router-cache", None),
    ("npm", "left-pad", None),
    ("npm", "requests_html", None),
    ("pypi", "python-requests-html==2", "requests_html"),
    ("go", "githarbor.example/a/box-golang", "codeforge.example/a/box-go"),
    ("go", "codeforge.example/b/box", "codeforge.example/a/box-go"),
    ("rubygems", "abcxdefyghz", None),
    ("cargo", "router", None),
    ("npm", "delta-gamma-beta-alphx", "alpha-beta-gamma-delta"),
    ("npm", "xlpha-beta-gamma-omega-delta", "alpha-beta-gamma-delta-omega"),
    ("npm", "omegadeltagamma.betta_alpa", "alpha-beta-gamma-delta-omega"),
    ("npm", "omega-delta-gama-beta-lpha-js", "alpha-beta-gamma-delta-omega"),
    ("npm", "xlphx-bexa-gamma-omega-delta", None),
    ("go", "githarbor.example/a/go-box", "codeforge.example/a/box-go"),
    ("npm", "", None),
    ("npm", "---", None),
    ("npm", "x" * 5000, None),
]


def test_names(spark):
    got = mapped(spark, [c[:2] for c in CASES] * 2, ENTRIES)
    assert got == {c[:2]: c[2] for c in CASES}


def test_nulls_and_empty_tables(spark):
    assert mapped(spark, [(None, "a"), ("npm", None), ("npm", "router")], [*ENTRIES, ("npm", None), (None, "x")]) == {("npm", "router"): "router"}
    assert mapped(spark, [("npm", "router")], []) == {("npm", "router"): None}
    assert mapped(spark, [], ENTRIES) == {}


def test_shards_and_blocks_give_the_same(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(6, 10)))
    entries = [("s", word()) for _ in range(60)]
    names = [("s", e[:3] + r.choice("abcdef") + e[4:]) for _, e in entries] + [("s", word()) for _ in range(40)]
    deco = {"s": Decorations()}
    whole = mapped(spark, names, entries, decorations=deco)
    assert whole == mapped(spark, names, entries, decorations=deco, shard_entries=7, names_a_group=9) == mapped(spark, names, entries, decorations=deco, shard_entries=7, names_a_group=3, most_groups=10)
    for (_, n), e in whole.items():
        near = sorted((damerau(n, x), x) for _, x in set(entries) if damerau(n, x) <= faults_allowed(len(x)))
        assert e == (near[0][1] if near else None)


def test_ties_go_to_fewest_faults_then_first_name(spark):
    assert mapped(spark, [("s", "abcdex")], [("s", "abcdey"), ("s", "abcdez")], decorations={}) == {("s", "abcdex"): "abcdey"}
