import pytest

from gitsift.rules.engine import scan
from gitsift.rules.textfiles import read_rules

HELPER = """
// helper, listed under its own name
rule helper { strings: $a = "curl " nocase condition: any of them }
private rule quiet { strings: $q = /qu[i\\/]et/ condition: $q }
"""
RULES = r"""
include "helper.meta"
/* block
   comment */
rule first : tag1 tag2 {
  meta:
    description = "a \"quoted\" one"
    severity = "high"
    max_hits = 3
    path_include = "*.py, setup.cfg"
  strings:
    $t1 = "one\tTab"
    $t2 = "Two" nocase
    $r1 = /thr[e]{2}\b/i nocase
    $h = { 66 6f [2-4] 62 ?? 72 }
  condition:
    (2 of ($t*) or $r1 or #h >= 1) and not quiet
}
rule counts {
  strings:
    $a = /"\+"/
    $b = "bb"
    $c = "cc"
  condition:
    #a > #b + #c or (#b >= 2 and #c == 3) or all of ($b, $zz*)
    // trailing
}
"""


def found(spark, folder, files):
    df = spark.createDataFrame(files, "path string, text string").coalesce(1)
    return [[h.rule_id for h in r.yara_hits] for r in scan(df, read_rules(str(folder))).collect()]


def test_files(spark, tmp_path):
    (tmp_path / "helper.meta").write_text(HELPER)
    (tmp_path / "a.yar").write_text(RULES.replace(" or all of ($b, $zz*)", ""))
    (tmp_path / "b.yar").write_text('include "helper.meta"\nrule last { condition: helper and quiet }')
    rules = read_rules(str(tmp_path))
    assert [r.id for r in rules] == ["helper", "quiet", "first", "counts", "last"]
    assert (rules[2].description, rules[2].severity, rules[2].include, rules[1].private) == ('a "quoted" one', "high", ("*.py", "setup.cfg"), True)
    texts = [
        ("x.py", "one\tTab and tWO", ["first"]), ("x.py", "one\tTab", []), ("x.py", "THREE", ["first"]), ("x.py", "THREEe", []), ("x.md", "THREE", []), ("x.py", "THREE quiet", []),
        ("x.py", "fo12bXr", ["first"]), ("x.py", "fo1\n\n\nb\nr", ["first"]), ("x.py", "fo1bXr", []), ("x", '"+"+"', ["counts"]), ("x", '"+"+" bb cc', []), ("x", "bb bb cc cc cc", ["counts"]),
        ("x", "bb bb cc cc cc cc", []), ("x.md", "CURL qu/et", ["helper", "last"]),
    ]
    assert found(spark, tmp_path, [t[:2] for t in texts]) == [t[2] for t in texts]


def test_bytes(spark, tmp_path):
    (tmp_path / "a.yar").write_text(r'rule cyr { strings: $a = /[a-z][\xd0\xd1][\x80-\xbf]/ condition: $a } rule dot { strings: $a = /<.>/ condition: $a } rule word { strings: $a = "é" nocase condition: $a }')
    assert found(spark, tmp_path, [("x", "pаy"), ("x", "pay а"), ("x", "<é>"), ("x", "<e>"), ("x", "É"), ("x", "é")]) == [["cyr"], [], ["word"], ["dot"], [], ["word"]]


@pytest.mark.parametrize("text", ["rule x { condition: for all i in (1..2) : (i) }", "rule x { strings: $a = 5 condition: $a }", "rule x { condition: $a at 0 }", "rule x {", 'rule x { strings: $a = "b" condition: @a > 2 }'])
def test_errors(tmp_path, text):
    (tmp_path / "a.yar").write_text(text)
    with pytest.raises(ValueError):
        read_rules(str(tmp_path))


def test_no_files(tmp_path):
    assert read_rules(str(tmp_path)) == []
