"""Queries that map dependency names as typed to the entries of the reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitsift.llm.names import Decorations, map_names
from gitsift.llm.queries import R
from gitsift.session import distinct_commits, stage, table

PACKAGES = {
    "npm": Decorations(prefixes=("node",), suffixes=("js", "node")),
    "pypi": Decorations(prefixes=("py", "python"), suffixes=("py", "python")),
    "rubygems": Decorations(prefixes=("rb", "ruby"), suffixes=("rb", "ruby")),
    "go": Decorations(prefixes=("go", "golang"), suffixes=("go", "golang"), hosts=("codeforge.example", "githarbor.example")),
}


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (seq, space, name) of the new and changed dependencies."""
    brief = lambda c: F.transform(c, lambda x: F.struct(x["ecosystem"].alias("space"), x["name"].alias("name")))
    empty = F.array().cast("array<struct<space:string,name:string>>")
    both = F.concat(F.coalesce(brief("new_deps"), empty), F.coalesce(brief("changed_deps"), empty))
    rows = table(spark, sf_dir, "commits").where((F.size("new_deps") > 0) | (F.size("changed_deps") > 0))
    commits = distinct_commits(rows, "seq", "new_deps", "changed_deps")
    return commits.select("seq", F.explode(F.array_distinct(both)).alias("d")).select("seq", "d.space", "d.name").where("name is not null and space is not null").distinct()


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    typed = stage(_typed(spark, sf_dir), "typed-names")
    reference = table(spark, sf_dir, "popular").select(F.col("ecosystem").alias("space"), "name")
    return typed, map_names(typed, reference, PACKAGES)


@R.query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per commit and dependency name that is no entry itself: the entry it is a spelling of, or ''."""
    typed, mapped = _mapped(spark, sf_dir)
    other = mapped.where(F.col("entry").isNull() | (F.col("entry") != F.col("name")))
    return typed.join(other, ["space", "name"]).select(
        "seq", F.col("space").alias("ecosystem"), F.col("name").alias("dep_name"), F.coalesce("entry", F.lit("")).alias("popular_name")
    )


@R.query()
def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names that stand for no entry, with the number of commits that use them."""
    typed, mapped = _mapped(spark, sf_dir)
    lost = mapped.where(F.col("entry").isNull()).select("space", "name")
    return typed.join(lost, ["space", "name"]).groupBy(F.col("space").alias("ecosystem"), F.col("name").alias("dep_name")).agg(F.count_distinct("seq").alias("n_commits"))
