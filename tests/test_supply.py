import random
from itertools import permutations

from pyspark.sql import functions as F

from gitsift.operators import supply


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_join_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab-") for _ in range(r.randrange(1, 6)))
    names, popular = sorted({word() for _ in range(150)}), sorted({word() for _ in range(40)})
    got = {x.name: x.match for x in supply.typosquats(spark.createDataFrame([("npm", n, 1) for n in names], "ecosystem string, name string, x int"), spark.createDataFrame([("npm", p) for p in popular], "ecosystem string, name string")).collect()}
    want = {}
    for n in names:
        if n not in popular:
            hit = [p for p in popular if any(osa(n, "-".join(f)) <= 1 for f in permutations(p.split("-")))]
            if hit:
                want[n] = min(hit)
    assert got == want


def test_forms_and_kinds_of_edit(spark):
    popular = spark.createDataFrame([("npm", "left-pad"), ("npm", "requests"), ("go", "github.com/a/golang-x"), ("npm", None)], "ecosystem string, name string")
    names = ["pad-left", "lef-pad", "leftt-pad", "lfet-pad", "left-pat", "left-pad", "requestsss", "left_pad"]
    df = spark.createDataFrame([("npm", n) for n in names] + [("npm", None), (None, "left-pa"), ("go", "gitlab.com/a/golang-x"), ("go", "github.com/a/go-x"), ("pypi", "lef-pad")], "ecosystem string, name string")
    got = {(r.ecosystem, r.name) for r in supply.typosquats(df, popular).collect()}
    assert got == {("npm", n) for n in ("pad-left", "lef-pad", "leftt-pad", "lfet-pad", "left-pat", "left_pad")} | {("go", "gitlab.com/a/golang-x"), ("go", "github.com/a/go-x")}


def test_many_words_in_any_order(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta", "theta", "iota"]
    entry = "-".join(words)
    r = random.Random(1)
    mixed = lambda: r.sample(words, 10)
    near = ["-".join(mixed()) for _ in range(4)]
    near += [x.replace("gamma", "gama") for x in near[:2]] + [near[0].replace("-", "", 1), near[1].replace("-", "x", 1), "-".join(mixed()).replace("theta", "the-ta"), "-".join(mixed()).replace("kappa", "ka-pa")]
    m = mixed()
    near.append("-".join([m[0] + m[1][0], m[1][1:], *m[2:]]))
    far = ["-".join(["alpah", "btea", *words[2:][::-1]]), "-".join(words[:9]), "th-" + "-".join(w for w in words if w != "theta") + "-eta"]
    df = spark.createDataFrame([("npm", x) for x in near + far], "ecosystem string, name string")
    got = {x.name for x in supply.typosquats(df, spark.createDataFrame([("npm", entry)], "ecosystem string, name string")).collect()}
    assert got == set(near)


def test_forms_of_go_names(spark):
    names = spark.createDataFrame([("go", "github.com/a/go-x"), ("npm", "go-x"), ("go", "ago-golangs-b")], "ecosystem string, name string")
    got = {(x.name, x.form) for x in supply.popular_forms(names).collect()}
    assert got == {
        ("github.com/a/go-x", f) for f in ("github.com/a/go-x", "gitlab.com/a/go-x", "github.com/a/golang-x", "gitlab.com/a/go-x", "x")
    } | {("go-x", "go-x")} | {("ago-golangs-b", f) for f in ("ago-golangs-b", "agolang-golangs-b", "golangs-b", "ago-gos-b", "ago-b")}


def test_empty_lists(spark):
    none = spark.createDataFrame([], "ecosystem string, name string")
    some = spark.createDataFrame([("npm", "x")], "ecosystem string, name string")
    assert supply.typosquats(some, none).count() == 0 and supply.typosquats(none, some).count() == 0


def test_direct_url_order(spark):
    new, changed = "array<struct<ecosystem:string,name:string,spec:string>>", "array<struct<ecosystem:string,name:string,old_spec:string,new_spec:string>>"
    rows = [
        ([("npm", "a", "https://x")], [("npm", "b", "1", "git+ssh://x"), ("npm", "c", "1", "http://y")]),
        ([("npm", "z", "1"), ("npm", "a", "https://x")], [("npm", "b", "http://q", "git+ssh://x")]),
        ([], []),
        (None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, f"new_deps {new}, changed_deps {changed}").select(supply.direct_url_change()).collect()]
    assert (got[0].kind, got[0].name, got[1].kind, got[1].name) == ("changed", "b", "new", "a") and got[2:] == [None, None]


def test_a_url_in_another_spelling_is_no_switch(spark):
    changed = "array<struct<ecosystem:string,name:string,old_spec:string,new_spec:string>>"
    rows = [([("npm", "a", " HTTPS://x", "https://x")],), ([("npm", "a", "1", " Git+https://x")],)]
    df = spark.createDataFrame(rows, f"changed_deps {changed}").withColumn("new_deps", F.expr("cast(null as array<struct<ecosystem:string,name:string,spec:string>>)"))
    got = [r[0] for r in df.select(supply.direct_url_change()).collect()]
    assert got[0] is None and (got[1].kind, got[1].spec) == ("changed", " Git+https://x")


def test_domain_age(spark):
    row = spark.range(1).select(supply.domain_age_days(F.lit("2024-01-01 12:00:00").cast("timestamp"), F.lit("2024-03-31 11:00:00").cast("timestamp")), supply.domain_age_days(F.lit(None).cast("timestamp"), F.current_timestamp())).first()
    assert tuple(row) == (89, None)
