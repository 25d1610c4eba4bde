import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from gitsift.sources import files, gitlog

RESULT = "repo string, seq long, sha string, email string, decision string, decision_val double, top_reasons array<string>, top_reasons_explained array<string>"
ROWS = [("r", 1, "aaaaaaa", "a@b", "Unusual", 0.98765, ["x", "y"], ["one", "two", "three", "four"]), ("r", 2, "bbbbbbb", "c@d", "Normal", 0.1, ["z"], ["t\tab"]), ("s", 1, "ccccccc", "e@f", "Unusual", 1.0, [], [])]


def test_tsv_and_report(spark, tmp_path):
    df = spark.createDataFrame(ROWS, RESULT)
    files.write_results(df, str(tmp_path / "out"))
    back = {r.sha: r for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).collect()}
    assert back["aaaaaaa"].top_reasons == "x | y" and back["bbbbbbb"].top_reasons_explained == "t\tab" and len(back) == 3
    lines = [r.line for r in files.report_lines(df).collect()]
    r_lines = ["r: 2 commits scored, 1 flagged Unusual", "  aaaaaaa  " + "a@b".ljust(30) + " score=0.988", "      - one", "      - two", "      - three"]
    assert lines == [*r_lines, "s: 1 commits scored, 1 flagged Unusual", "  ccccccc  " + "e@f".ljust(30) + " score=1.000"]
    long = df.withColumn("email", F.lit("a" * 40))
    assert [r.line for r in files.report_lines(long).collect()][1] == "  aaaaaaa  " + "a" * 40 + " score=0.988"
    assert files.report_lines(df.where("false")).count() == 0
    assert {(r.repo, r.scored, r.flagged) for r in files.flagged_counts(df).collect()} == {("r", 2, 1), ("s", 1, 1)}


def test_lists(spark, tmp_path):
    (tmp_path / "gems.json").write_text(json.dumps({"downloaded_timestamp": 1, "packages": ["rails", "rake"]}, indent=1))
    (tmp_path / "broken.json").write_text("{nope")
    got = files.read_popular(spark, {"rubygems": str(tmp_path / "gems.json"), "npm": str(tmp_path / "missing.json"), "go": str(tmp_path / "broken.json")})
    assert {tuple(r) for r in got.collect()} == {("rubygems", "rails"), ("rubygems", "rake")}
    (tmp_path / "d.txt").write_text("# list\n Temp.Example \n\ntemp.example\nother.example\n")
    assert {r[0] for r in files.read_domains(spark, str(tmp_path / "d.txt")).collect()} == {"temp.example", "other.example"}


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_repository(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=A@b.example", *a], check=True, capture_output=True)
    git("init", "-q")
    for k, (name, text) in enumerate([("a.py", "x\n"), ("a.py", "y\nz\n"), ("img/b.png", "MZ\0")]):
        (repo / name).parent.mkdir(exist_ok=True)
        (repo / name).write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", f"change {k}")
    gitlog.register(spark)
    read = lambda part: spark.read.format("gitlog").option("repos", str(repo)).option("part", part).option("commits_per_partition", 2).load()
    commits = read("commits").orderBy("seq").collect()
    assert [(r.seq, len(r.parents), r.author_email, r.message) for r in commits] == [(0, 0, "A@b.example", "change 0\n"), (1, 1, "A@b.example", "change 1\n"), (2, 1, "A@b.example", "change 2\n")]
    changes = read("changes").orderBy("seq").collect()
    assert [(r.seq, r.b_path, r.is_new, r.header and bytes(r.header)) for r in changes] == [(1, "a.py", False, None), (2, "img/b.png", True, b"MZ\0")]
    from gitsift.operators.extract import extract_commits

    got = extract_commits(read("commits"), read("changes")).orderBy("seq").collect()
    assert [(r.loc_added, r.loc_removed, r.top_dirs) for r in got][0] == (2, 1, ["(root)"])
    assert got[1].new_binary_files[0].kind == "PE/EXE (Windows)"
    from gitsift.__main__ import main

    assert main([str(repo), "--limit", "5", "--out", str(tmp_path / "scored"), "--threshold", "0.1"], spark) == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "scored")).count() == 2
    with pytest.raises(Exception):
        spark.read.format("gitlog").option("repos", str(tmp_path / "none")).load().collect()


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_moves_and_signatures(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a, **k: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=a@b.example", *a], check=True, capture_output=True, **k).stdout.decode()
    run("init", "-q")
    body = "".join(f"line {k}\n" for k in range(50))
    steps = [("a.txt", body), ("gone.bin", "\x7fELF...."), ("odd \" näme.txt", "+++ x\n--- y\n" + "0" * 40 + "\n")]
    for name, content in steps:
        (repo / name).write_text(content)
        run("add", "-A")
        run("commit", "-q", "-m", f"add {name}")
    (repo / "sub").mkdir()
    run("mv", "a.txt", "sub/b.txt")
    (repo / "sub/b.txt").write_text(body + "more\n")
    run("rm", "-q", "gone.bin")
    run("add", "-A")
    run("commit", "-q", "-m", "move")
    raw = run("cat-file", "commit", "HEAD")
    head, _, message = raw.partition("\n\n")
    signed = head.replace("tree ", "tree ", 1) + "\ngpgsig -----BEGIN PGP SIGNATURE-----\n \n AAAA\n -----END PGP SIGNATURE-----\n\n" + message
    parent = run("rev-parse", "HEAD").strip()
    signed = signed.replace(next(x for x in head.split("\n") if x.startswith("parent ")), f"parent {parent}")
    run("reset", "-q", "--hard", run("hash-object", "-t", "commit", "-w", "--stdin", input=signed.encode()).strip())
    gitlog.register(spark)
    read = lambda part, n=2: spark.read.format("gitlog").option("repos", str(repo)).option("part", part).option("commits_per_partition", n).load().orderBy("seq")
    commits = read("commits").collect()
    assert [r.seq for r in commits] == [0, 1, 2, 3, 4] and [r.signature is not None for r in commits] == [False] * 4 + [True]
    assert commits[4].parents == [commits[3].sha] and commits[4].message == "move\n" and commits[0].parents == [] and commits[1].author_email == "a@b.example"
    changes = {(r.seq, r.b_path or r.a_path): r for r in read("changes").collect()}
    assert set(changes) == {(1, "gone.bin"), (2, "odd \" näme.txt"), (3, "gone.bin"), (3, "sub/b.txt")}
    moved = changes[3, "sub/b.txt"]
    assert (moved.a_path, moved.is_new, moved.is_deleted) == ("a.txt", False, False) and moved.patch.count("\n+") - moved.patch.count("\n+++") == 1
    assert changes[3, "gone.bin"].is_deleted and bytes(changes[1, "gone.bin"].header) == b"\x7fELF" and "+" + "0" * 40 in changes[2, "odd \" näme.txt"].patch
    from gitsift.operators.extract import extract_commits

    got = {r.seq: r for r in extract_commits(read("commits"), read("changes", 100)).collect()}
    assert (got[3].loc_added, got[3].loc_removed, got[3].files_changed, got[3].files_added, got[3].files_removed) == (1, 1, 2, 0, 1) and got[4].gpg_signed and not got[3].gpg_signed


def test_stream_counts(spark, tmp_path):
    from gitsift.streaming.scorer import by_day, daily_activity, read_stream

    rows = [("a", "r", "x@y", 5, "2024-01-01 10:00:00"), ("a", "r", "x@y", 5, "2024-01-02 10:00:00"), ("b", "r", "z@y", 7, "2024-01-01 11:00:00"), ("c", "r", "z@y", 1, "2024-06-01 00:00:00")]
    for k, part in enumerate((rows[:3], rows[3:], [("d", "r", "q", 1, "2024-12-01 00:00:00")])):
        df = spark.createDataFrame(part, "sha string, repo string, email string, total_loc long, t string").withColumn("ingested_ts", F.col("t").cast("timestamp")).drop("t").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        q = daily_activity(read_stream(spark, str(tmp_path / "in"), df.schema), "30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {str(r.day.start)[:10]: (r.n_commits, r.total_loc, r.n_authors) for r in by_day(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got["2024-01-01"] == (2, 12, 2) and got["2024-06-01"] == (1, 1, 1) and "2024-01-02" not in got
