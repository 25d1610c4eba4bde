import re

import pytest
from pyspark.sql import functions as F

from gitsift.functions import commits as C
from gitsift.operators import extract

RAW = "seq long, sha string, repo string, parents array<string>, author_email string, committer_email string, authored_epoch long, committed_epoch long, message string, signature string"
CH = "seq long, file_ord int, a_path string, b_path string, is_new boolean, is_deleted boolean, patch string, header binary"


def col(spark, xs, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def test_paths(spark):
    xs = ["a/b.tar.gz", ".bashrc", "Makefile", "x.d/none", "X.PY"]
    assert col(spark, xs, C.file_extension) == [".gz", ".bashrc", None, None, ".PY"]
    assert col(spark, xs, C.top_dir) == ["a", "(root)", "(root)", "x.d", "(root)"]


def test_words_split_on_single_spaces(spark):
    xs = ["", "a b", "a  b", "a\nb c", " a "]
    assert col(spark, xs, C.message_words) == [len(x.split(" ")) for x in xs]


def test_email(spark):
    assert col(spark, [None, "", "a@b", "https://x/y", "a:b@c"], C.clean_email) == ["unknown", "unknown", "a@b", "httpsx/y", "a:b@c"]
    assert col(spark, ["A@B.C", "x@y@Z", "none"], C.email_domain) == ["b.c", "z", ""]


def test_generic_message(spark):
    xs = ["Fix", "fix.", "fix..", "fixing", "wip\nlong text", "  Update  ", "small fix", ""]
    assert col(spark, xs, C.is_generic_message) == [True, True, False, False, True, True, True, False]


def test_direct_url(spark):
    xs = ["https://x", "git+ssh://a", "owner/repo#main", "^1.2.3", "see https://x", None]
    assert col(spark, xs, C.is_direct_url) == [True, True, True, False, False, False]


def test_direct_url_in_any_case_and_indented(spark):
    reference = re.compile(r"^\s*(https?://|git\+|git://|ssh://|[\w.-]+/[\w.-]+#)", re.IGNORECASE)
    yes = ["HTTPS://x", "Http://x", "Git+https://x", "GIT://x", "Ssh://x", " https://x", "\t\n git+ssh://a", "\u00a0\u3000https://x", "\x1c\x85ssh://x", "  Owner/Repo#main", "besitzer/größe²#1", "httpſ://x"]
    no = ["", " ", " ^1.2.3", "see HTTPS://x", "FTP://x", "a b/c#d", "\u200bhttps://x", "o\u0301/x#1"]
    assert [bool(reference.match(x)) for x in yes + no] == [True] * len(yes) + [False] * len(no)
    assert col(spark, yes + no, C.is_direct_url) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    "base,line,want",
    [
        ("package.json", ' "left-pad": "^1.0",', ("npm", "left-pad", "^1.0")),
        ("package.json", '"version": "1.0"', None),
        ("package.json", '"_id": "x"', None),
        ("package.json", '"scripts": {', None),
        ("go.mod", "\trequire.example/x/y v1.2.3", ("go", "require.example/x/y", "v1.2.3")),
        ("go.mod", "module x", None),
        ("Gemfile", "gem 'rails', '~> 7'", ("rubygems", "rails", "~> 7")),
        ("Gemfile", 'gem "rake"', ("rubygems", "rake", "")),
        ("requirements.txt", "Flask>=2 # web", ("pypi", "flask", ">=2")),
        ("requirements.txt", "# Flask", None),
        ("requirements.txt", "-r other.txt", None),
        ("requirements.txt", "", None),
        ("setup.cfg", "Flask>=2", None),
    ],
)
def test_dependency_lines(spark, base, line, want):
    got = spark.range(1).select(C.dependency(F.lit(base), F.lit(line)).alias("d")).first().d
    assert (tuple(got) if got else None) == want


def test_gap_ignores_merges_and_follows_walk_order(spark):
    rows = [
        (1, "a", "r", ["p"], "x@y", "x@y", 1000, 1010, "one", None),
        (2, "b", "r", ["p", "q"], "x@y", "x@y", 5000, 5000, "merge", None),
        (3, "c", "r", ["p"], "x@y", "X@Y", 400, 300, "two  words\n", "sig"),
        (3, "c", "r", ["p"], "x@y", "X@Y", 400, 300, "two  words\n", "sig"),
        (4, "d", "r", [], "x@y", None, 1, 1, None, None),
        (5, "e", "s", ["p"], "x@y", None, 90, 95, None, None),
    ]
    got = {r.sha: r for r in extract.single_parent(spark.createDataFrame(rows, RAW)).collect()}
    assert set(got) == {"a", "c", "e"}
    assert (got["a"].gap_seconds, got["c"].gap_seconds, got["e"].gap_seconds) == (None, 600, None)
    assert (got["a"].commit_delay_seconds, got["c"].commit_delay_seconds) == (10, 0)
    assert (got["c"].author_committer_mismatch, got["e"].author_committer_mismatch) == (False, True)
    assert (got["c"].commit_msg_words, got["c"].message, got["e"].commit_msg_words, got["c"].gpg_signed) == (3, "two  words", 1, True)


def test_extract(spark):
    raw = [(1, "a", "r", ["p"], "x@y", "x@y", 0, 0, "m", None), (2, "b", "r", ["p"], "x@y", "x@y", 0, 0, "m", None)]
    manifest = '+++ b/package.json\n-"keep": "1"\n-"go": "1"\n+"keep": "1"\n+"go": "git+https://x"\n+"new": "2"\n+"new": "3"\n++plus\n context'
    changes = [
        (1, 0, "w/package.json", "w/package.json", False, False, manifest, None),
        (1, 1, None, "img/logo.png", True, False, "+x", b"\x7fELF"),
        (1, 2, None, "lib/a.so", True, False, None, b"\x7fELF"),
        (1, 3, "old", None, False, True, "---gone\n-b", None),
    ]
    got = {r.seq: r for r in extract.extract_commits(spark.createDataFrame(raw, RAW), spark.createDataFrame(changes, CH)).collect()}
    a, b = got[1], got[2]
    assert (a.loc_added, a.loc_removed, a.total_loc, a.files_changed, a.files_added, a.files_removed) == (6, 3, 9, 4, 2, 1)
    assert a.filetypes == [".json", ".png", ".so"] and a.top_dirs == ["w", "img", "lib", "(root)"]
    assert [tuple(d) for d in a.new_deps] == [("npm", "new", "3")]
    assert [tuple(d) for d in a.changed_deps] == [("npm", "go", "1", "git+https://x")]
    assert [tuple(f) for f in a.new_binary_files] == [("img/logo.png", "ELF (Linux)")]
    assert (b.total_loc, b.churn_ratio, b.filetypes) == (0, 0.0, None)


def test_signatures(spark):
    df = spark.createDataFrame([("x", b"MZ\x90"), ("x.exe", b"MZ"), ("x.EXE", b"MZ"), ("x", b"\xcf\xfa\xed\xfe"), ("x", b"M"), ("x", None), ("x", b"text")], "p string, h binary")
    assert [r[0] for r in df.select(C.binary_kind(F.col("p"), F.col("h"))).collect()] == ["PE/EXE (Windows)", None, None, "Mach-O 64-bit (byte-swapped)", None, None, None]


def test_rule_hits_of_added_lines(spark):
    from gitsift.rules.engine import Rule, Text

    rules = [Rule("one", ["any"], {"s": Text("X")}), Rule("two", ["any"], {"s": Text("Y\nX")})]
    changes = [(1, 1, "a", "a", False, False, "+Y\n+X\n-X", None), (1, 0, None, "b", True, False, "+X", None), (2, 0, "c", None, False, True, "+X", None), (3, 0, "d", "d", False, False, "-X\n X", None), (4, 0, "e", "e", False, False, None, None)]
    got = {r.seq: [(h.path, h.rule_id) for h in r.yara_hits] for r in extract.rule_hits(spark.createDataFrame(changes, CH), rules).collect()}
    assert got == {1: [("b", "one"), ("a", "one"), ("a", "two")]}


def test_gaps_over_blocks(spark):
    import random

    r = random.Random(6)
    rows = [(f"s{i}", r.choice(["r", "r", None]), r.choice(["hot", "hot", "hot", "b"]), i * 3, r.choice([None, r.randrange(9999), r.randrange(9999)])) for i in range(200)]
    df = spark.createDataFrame(rows, "sha string, repo string, email string, seq long, authored_epoch long").repartition(3)
    want, last = {}, {}
    for sha, repo, email, _, t in rows:
        want[sha] = last.get((repo, email))
        last[repo, email] = t
    for block in (1, 7, 50, 10**6):
        assert {x.sha: x.before for x in extract.gaps(df, ("repo",), block).collect()} == want
