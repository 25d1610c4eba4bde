"""Score the latest commits of local repositories: ``python -m gitsift repo... [--limit 200] [--out DIR] [--rules DIR] [--threshold 0.962]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gitsift.functions import scoring as S
from gitsift.operators.detect import detect
from gitsift.operators.extract import extract_commits, rule_hits
from gitsift.rules.basic import BASIC
from gitsift.rules.textfiles import read_rules
from gitsift.session import stage
from gitsift.sources import files, gitlog


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="gitsift", description=__doc__)
    p.add_argument("repos", nargs="+", help="paths of local repositories")
    p.add_argument("--limit", type=int, default=S.WINDOW, help="latest commits to score, of each repository")
    p.add_argument("--out", help="folder for the results as tab-separated files")
    p.add_argument("--rules", help="folder of rule files (*.yar); default: the built-in rules")
    p.add_argument("--popular", action="append", default=[], metavar="ECOSYSTEM=FILE", help="JSON list of popular packages")
    p.add_argument("--disposable", help="text file of disposable mail domains")
    p.add_argument("--threshold", type=float, default=S.THRESHOLD)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    gitlog.register(spark)
    read = lambda part: spark.read.format("gitlog").option("repos", ",".join(a.repos)).option("part", part).load()
    raw, changes = stage(read("commits"), "raw"), stage(read("changes"), "changes")
    rows = extract_commits(raw, changes, rule_hits(changes, read_rules(a.rules) if a.rules else BASIC))
    commits = stage(rows, "commits")
    if commits.count() < 2:
        print("fewer than two commits to compare", file=sys.stderr)
        return 1
    popular = files.read_popular(spark, dict(x.split("=", 1) for x in a.popular)) if a.popular else None
    disposable = files.read_domains(spark, a.disposable) if a.disposable else None
    results = stage(detect(commits, popular, disposable, limit=a.limit, threshold=a.threshold), "results")
    for r in files.report_lines(results).toLocalIterator():
        print(r["line"])
    if a.out:
        files.write_results(results, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
