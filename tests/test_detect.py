"""The whole score against a plain reading of its definition, over a small made-up history."""

import math
import random
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gitsift.operators.detect import detect

METRICS = ["total_loc", "loc_added", "loc_removed", "files_changed", "files_added", "files_removed", "commit_msg_words"]
SCHEMA = (
    "seq long, sha string, repo string, email string, total_loc long, loc_added long, loc_removed long, files_changed int, files_added int, files_removed int, commit_msg_words int, hour_utc int, weekday_utc int, "
    "message string, filetypes array<string>, top_dirs array<string>, gpg_signed boolean, author_committer_mismatch boolean, gap_seconds double, churn_ratio double, commit_delay_seconds double, "
    "new_deps array<struct<ecosystem:string,name:string,spec:string>>, changed_deps array<struct<ecosystem:string,name:string,old_spec:string,new_spec:string>>, "
    "new_binary_files array<struct<path:string,kind:string>>, yara_hits array<struct<path:string,rule_id:string,description:string,severity:string>>, extra int"
)


def history(seed=2, n=130):
    r = random.Random(seed)
    out = []
    for i in range(n):
        who = r.choice(["main@x.example", "main@x.example", "Few@young.example", "dep[bot]@x.example", "two@disp.example"]) if i < n - 1 else "main@x.example"
        add, rem = int(r.paretovariate(0.8)) * 3, r.randrange(9)
        row = {
            "seq": i, "sha": f"{i:07d}{'a' * 33}", "repo": "r/" + ("one" if i % 13 else "two"), "email": who, "total_loc": add + rem, "loc_added": add, "loc_removed": rem, "files_changed": r.randrange(1, 9), "files_added": r.randrange(3),
            "files_removed": r.choice([0, 0, 1]), "commit_msg_words": r.randrange(1, 12), "hour_utc": r.choice([8, 9, 9, 10, 22]), "weekday_utc": r.randrange(5), "message": r.choice(["fix", "add a thing", "Update."]),
            "filetypes": r.choice([[".py"], [".py", ".md", ".py"], [".md", ".js"], [], [".py", ".js", ".js", ".md"]]), "top_dirs": r.choice([["src"], ["src", "docs"], ["(root)"]]),
            "gpg_signed": r.random() < 0.8, "author_committer_mismatch": r.random() < 0.1, "gap_seconds": None if i < 5 else math.exp(r.uniform(0, 14)), "churn_ratio": math.log10((add + 1) / (rem + 1)) * 3, "commit_delay_seconds": float(r.choice([0, 0, 5, 90000])),
            "new_deps": r.choice([[], [], [("npm", "lodahs", "1")], [("npm", "own", "git+https://x/y")]]), "changed_deps": r.choice([[], [], [("npm", "lodash", "1", "https://z")]]), "new_binary_files": r.choice([[], [], [("a.png", "ELF (Linux)")]]),
            "yara_hits": r.choice([[], [], [("a.py", "r1", "one", "low"), ("a.py", "r2", "two", "high"), ("b.py", "r3", "three", "high")], [("a.py", "r1", "one", "odd")]]), "extra": 1,
        }
        out.append(row)
    out[-1]["top_dirs"] = ["never"]
    out[-3]["filetypes"] = None
    out[-4]["gpg_signed"] = None
    return out


def m(x):
    return 1 - (1 - x) ** (1 / 15)


def fit(xs):
    p = np.array(xs, dtype=float)
    if p.min() == p.max():
        p = np.append(p, p[0] + 1)
    slope, cut = np.polyfit(np.log(p + 1e-6), np.log(1 + 1e-6 - np.array([(p <= x).mean() for x in p])), 1)
    return math.exp(cut / -slope) if slope else 0.0, -slope


def tail(v, f):
    return max(0.0, 1 - (f[0] / v) ** f[1]) if v else 0.0


def circle(v, xs, period):
    d = [np.mean([math.exp(4 * math.cos((x - q) * 2 * math.pi / period)) for x in xs]) for q in range(period)]
    return 1 - d[v] / max(d)


def normal(x, xs):
    if x is None or len(xs) < 5 or np.std(xs, ddof=1) < 1.5:
        return 0.5
    return math.erf(abs(x - np.mean(xs)) / np.std(xs, ddof=1) / math.sqrt(2))


def types(row, group):
    """Mean share, frequency, pair frequency and pair ratio of a commit's types within a group of commits."""
    bag = lambda r: r["filetypes"] or []
    files = sum(len(bag(r)) for r in group) or 1
    kinds = sorted(set(bag(row)))
    share = [100 * sum(bag(r).count(t) for r in group) / files for t in kinds]
    freq = [sum(t in bag(r) for r in group) / len(group) for t in kinds]
    pair, ratio = [], []
    for a, b in combinations(kinds, 2):
        both = [math.log10(bag(r).count(a) / bag(r).count(b)) for r in group if a in bag(r) and b in bag(r)]
        pair.append(len(both) / len(group))
        if len(both) >= 10:
            away = math.log10(bag(row).count(a) / bag(row).count(b)) - np.mean(both)
            ratio.append(1.0 if abs(away) < 1e-9 else np.var(both, ddof=1) / away**2)
    mean = lambda xs, d: sum(xs) / len(xs) if xs else d
    return mean(share, 100) / 100, mean(freq, 1), mean(pair, 1), mean(ratio, 1)


def expected(rows, limit, as_of):
    out = {}
    for repo in {r["repo"] for r in rows}:
        group = sorted((r for r in rows if r["repo"] == repo), key=lambda r: r["seq"])
        for row in group[-limit:]:
            own = [r for r in group if r["email"] == row["email"]]
            if "[bot]" in row["email"]:
                out[row["sha"][:7]] = 0.0
                continue
            known = len(own) > 20
            prof = (own[:-1] or own) if known else []
            v = []
            for k in METRICS:
                g = tail(row[k], fit([r[k] for r in group]))
                a = tail(row[k], fit([r[k] for r in own])) if known else 0.5
                v += ([m(g)] if k not in ("files_added", "files_removed") else []) + [m(a)]
                if k == "total_loc" and row["message"] in ("fix", "Update.") and g > 0.8:
                    v.append(0.9)
            v += [m(circle(row["hour_utc"], [r["hour_utc"] for r in prof], 24)), m(circle(row["weekday_utc"], [r["weekday_utc"] for r in prof], 7))] if known else [m(0.5)] * 2
            v += [m(1 - x) for x in types(row, group)] + ([m(1 - x) for x in types(row, own)] if known else [])
            log = lambda x: None if x is None else math.log(x + 1)
            for k, f in (("gap_seconds", log), ("commit_delay_seconds", log), ("churn_ratio", float)):
                v.append(m(normal(f(row[k]), [f(r[k]) for r in prof if r[k] is not None])))
            n = len(prof)
            v.append(m(1 - min(sum(d in r["top_dirs"] for r in prof) / n for d in row["top_dirs"])) if n >= 5 else m(0.5))
            if n >= 5:
                if sum(bool(r["gpg_signed"]) for r in prof) / n > 0.5 and not row["gpg_signed"]:
                    v.append(0.85)
                rate = sum(r["author_committer_mismatch"] for r in prof) / n
                if row["author_committer_mismatch"] and rate < 0.2:
                    v.append(0.35 * (1 - rate / 0.2))
            v += [0.9] * any(d[1] == "lodahs" for d in row["new_deps"])
            v += [0.9] * row["email"].endswith("disp.example") + [0.7] * row["email"].endswith("young.example")
            v += [0.9] * bool(row["new_binary_files"]) + [0.85] * bool(row["changed_deps"] or any(d[1] == "own" for d in row["new_deps"]))
            v += [max({"low": 0.3, "high": 0.9, "odd": 0.5}[h[3]] for h in row["yara_hits"])] if row["yara_hits"] else []
            out[row["sha"][:7]] = 1 - math.prod(1 - x for x in v)
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = history()
    as_tuple = lambda r: tuple(r[c.split()[0]] for c in SCHEMA.split(", "))
    df = spark.createDataFrame([as_tuple(r) for r in rows + rows[:9] + rows[-2:]], SCHEMA)  # some delivered twice
    popular = spark.createDataFrame([("npm", "lodash")], "ecosystem string, name string")
    disposable = spark.createDataFrame([("disp.example",)], "domain string")
    domains = spark.createDataFrame([("young.example", datetime(2023, 11, 1)), ("x.example", datetime(2000, 1, 1))], "domain string, creation_ts timestamp")
    got = detect(df, popular, disposable, domains, datetime(2023, 12, 1), limit=100)
    return rows, {r.sha: r for r in got.collect()}


def test_scores(scored):
    rows, got = scored
    want = expected(rows, 100, None)
    assert set(got) == set(want)
    for sha, x in want.items():
        assert got[sha].decision_val == pytest.approx(x, abs=6e-5), sha
        assert got[sha].decision == ("Unusual" if x >= 0.962 else "Normal")


def test_reasons(scored):
    rows, got = scored
    last = got[rows[-1]["sha"][:7]]
    assert last.decision_val == 1.0 and last.top_reasons[0] == "Directory rarity (author) (score 1.00)"
    assert last.top_reasons_explained[0].endswith("(rarity 100.0%).")
    for r in got.values():
        assert len(r.top_reasons) == len(r.top_reasons_explained) == (1 if "[bot]" in r.email else 5)
        strengths = [float(x.rsplit(" ", 1)[1][:-1]) for x in r.top_reasons] if len(r.top_reasons) == 5 else [0]
        assert strengths == sorted(strengths, reverse=True)
        assert all(r.top_reasons_explained)


def test_defaults(spark):
    rows = history(n=6)[:3]
    as_tuple = lambda r: tuple(r[c.split()[0]] for c in SCHEMA.split(", "))
    df = spark.createDataFrame([as_tuple(r) for r in rows], SCHEMA)
    nulls = df.select("seq", "sha", "repo", *[F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c not in ("seq", "sha", "repo", "email", "extra")], "email")
    assert detect(nulls).count() == 3
    assert detect(df.where("false")).count() == 0
