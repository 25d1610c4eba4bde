"""Commit features from raw commits and file changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gitsift.functions import commits as C
from gitsift.rules.engine import Rule, scan


BLOCK = 100_000  # walk places that make up one block of an author's commits


def gaps(commits: DataFrame, scope: Sequence[str] = ("repo",), block: int = BLOCK) -> DataFrame:
    """(``sha``, ``before``): authored time of the author's commit before, in walk order; null for the first.

    An author may own a large part of a history, so the commits are cut into blocks of walk places: inside a block a
    window looks back, and the first commit of a block takes the last of the author's block before.
    """
    keys = [*scope, "email"]
    rows = commits.select("sha", *keys, "seq", "authored_epoch", F.floor(F.col("seq") / block).alias("_block"))
    inside = W.partitionBy(*keys, "_block").orderBy("seq")
    rows = rows.withColumns({"_lag": F.lag("authored_epoch").over(inside), "_first": F.row_number().over(inside) == 1})
    last = commits.groupBy(*keys, F.floor(F.col("seq") / block).alias("_block")).agg(F.max_by("authored_epoch", "seq").alias("_last"))
    last = last.withColumn("_carried", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")))
    same = [rows[k].eqNullSafe(last[k]) for k in [*keys, "_block"]]
    return rows.join(last, same, "left").select("sha", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")).alias("before"))


def single_parent(raw: DataFrame, scope: Sequence[str] = ("repo",)) -> DataFrame:
    """Scored commits with what their header gives; merges and roots are dropped before the gap is taken.

    ``raw``: sha, seq, parents, author_email, committer_email, authored_epoch, committed_epoch,
    message, signature and the scope columns; rows repeated by late delivery count once, rows without a sha are left out. A null
    message counts as empty; a null ``parents`` is no single parent. The gap is to the author's
    commit before in walk order (``seq``, not time), absolute, null for the first.
    """
    cols = ["sha", *scope, "seq", "parents", "author_email", "committer_email", "authored_epoch", "committed_epoch", "message", "signature"]
    email = C.clean_email(F.col("author_email"))
    kept = raw.where((F.size("parents") == 1) & F.col("sha").isNotNull())
    one = kept.select(*cols).dropDuplicates(["sha"]).withColumn("email", email)
    # the gaps are found on a few narrow columns and joined to the wide rows by sha, by which these are partitioned
    narrow = kept.select("sha", *scope, "seq", "authored_epoch", email.alias("email")).dropDuplicates(["sha"])
    ts = F.timestamp_seconds("authored_epoch")
    message = F.coalesce("message", F.lit(""))
    committer = F.coalesce(F.nullif("committer_email", F.lit("")), F.lit("unknown"))
    return one.join(gaps(narrow, scope), "sha").select(
        "sha",
        *scope,
        "seq",
        "email",
        committer.alias("committer_email"),
        ts.alias("authored_ts"),
        F.hour(ts).alias("hour_utc"),
        C.weekday(ts).alias("weekday_utc"),
        C.message_words(message).alias("commit_msg_words"),
        F.trim(message, F.lit(" \t\r\n\x0b\x0c")).alias("message"),
        F.col("signature").isNotNull().alias("gpg_signed"),
        C.differs(F.col("email"), committer).alias("author_committer_mismatch"),
        F.abs(F.col("authored_epoch") - F.col("before")).cast("double").alias("gap_seconds"),
        C.delay_seconds(F.col("authored_epoch"), F.col("committed_epoch")).alias("commit_delay_seconds"),
    )


def diff_lines(changes: DataFrame) -> DataFrame:
    """Added and removed lines of each file's patch; lines that begin with +++ or --- are skipped.

    ``changes``: seq, file_ord, a_path, b_path, is_new, is_deleted, patch, header. A null patch has no lines.
    """
    path = F.coalesce(F.nullif("b_path", F.lit("")), F.nullif("a_path", F.lit("")), F.lit(""))
    lines = changes.select("seq", "file_ord", path.alias("path"), F.posexplode(F.split("patch", "\n", -1)).alias("line_ord", "line"))
    shown = ~F.col("line").startswith("+++") & ~F.col("line").startswith("---")
    sign = F.substring("line", 1, 1)
    return lines.where(shown & sign.isin("+", "-")).select("seq", "file_ord", "path", "line_ord", sign.alias("sign"), F.expr("substring(line, 2)").alias("line"))


def line_counts(changes: DataFrame) -> DataFrame:
    """Per commit: lines added, removed, both, and files changed, added, removed."""
    path = F.coalesce("patch", F.lit(""))
    kept = F.filter(F.split(path, "\n", -1), lambda x: ~x.startswith("+++") & ~x.startswith("---"))
    n = lambda s: F.size(F.filter("kept", lambda x: x.startswith(s)))
    files = changes.select("seq", "is_new", "is_deleted", kept.alias("kept")).select("seq", "is_new", "is_deleted", n("+").alias("add"), n("-").alias("rem"))
    added, removed = F.sum("add"), F.sum("rem")
    return files.groupBy("seq").agg(
        (added + removed).alias("total_loc"),
        added.alias("loc_added"),
        removed.alias("loc_removed"),
        F.count(F.lit(1)).cast("int").alias("files_changed"),
        F.count_if("is_new").cast("int").alias("files_added"),
        F.count_if("is_deleted").cast("int").alias("files_removed"),
    )


def paths_of(changes: DataFrame) -> DataFrame:
    """Per commit: bag of file types (files with a dot in the base name) and of top directories, in diff order."""
    path = F.coalesce(F.nullif("b_path", F.lit("")), F.nullif("a_path", F.lit("")))
    rows = changes.select("seq", "file_ord", path.alias("path"))
    listed = F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("file_ord", "path"))))
    return (
        rows.groupBy("seq")
        .agg(listed.alias("p"))
        .select(
            "seq",
            F.filter(F.transform("p", lambda x: C.file_extension(x["path"])), lambda t: t.isNotNull()).alias("filetypes"),
            F.transform("p", lambda x: C.top_dir(x["path"])).alias("top_dirs"),
        )
    )


def dependency_changes(changes: DataFrame) -> DataFrame:
    """Per commit, ``new_deps`` and ``changed_deps``: added lines of a manifest against removed lines of the same file, by name.

    The last of several lines for one name counts. A dependency is new if its name is not among the removed
    ones, changed if it is and the specification differs.
    """
    names = list(C.MANIFESTS)
    base = C.basename(F.col("path"))
    lines = diff_lines(changes.where(C.basename(F.coalesce(F.nullif("b_path", F.lit("")), F.col("a_path"))).isin(names)))
    deps = lines.withColumn("d", C.dependency(base, F.col("line"))).where(F.col("d").isNotNull())
    last = lambda s: F.max_by(F.when(F.col("sign") == s, F.col("d.spec")), F.when(F.col("sign") == s, F.col("line_ord")))
    first = F.min(F.when(F.col("sign") == "+", F.col("line_ord")))
    by_name = deps.groupBy("seq", "file_ord", "d.ecosystem", "d.name").agg(last("+").alias("new_spec"), last("-").alias("old_spec"), first.alias("ord"))
    added = by_name.where(F.col("new_spec").isNotNull())
    new = F.when(F.col("old_spec").isNull(), F.struct("file_ord", "ord", F.struct("ecosystem", "name", F.col("new_spec").alias("spec")).alias("d")))
    changed = F.when(F.col("old_spec") != F.col("new_spec"), F.struct("file_ord", "ord", F.struct("ecosystem", "name", "old_spec", "new_spec").alias("d")))
    drop_order = lambda a: F.transform(F.array_sort(a), lambda x: x["d"])
    return added.groupBy("seq").agg(drop_order(F.collect_list(new)).alias("new_deps"), drop_order(F.collect_list(changed)).alias("changed_deps"))


def bundled_binaries(changes: DataFrame) -> DataFrame:
    """Per commit, ``new_binary_files``: new files whose first bytes are those of a native binary under another kind of name."""
    path = F.coalesce(F.nullif("b_path", F.lit("")), F.nullif("a_path", F.lit("")), F.lit(""))
    rows = changes.where("is_new").select("seq", "file_ord", path.alias("path"), C.binary_kind(path, F.col("header")).alias("kind")).where(F.col("kind").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("file_ord", F.struct("path", "kind").alias("b"))))
    return rows.groupBy("seq").agg(F.transform(listed, lambda x: x["b"]).alias("new_binary_files"))


def added_text(changes: DataFrame) -> DataFrame:
    """Per file that is not deleted and gained lines: ``seq``, ``file_ord``, ``path`` and the added lines as one ``text``."""
    path = F.coalesce(F.nullif("b_path", F.lit("")), F.nullif("a_path", F.lit("")))
    lines = F.filter(F.split("patch", "\n", -1), lambda x: x.startswith("+") & ~x.startswith("+++"))
    rows = changes.where(~F.coalesce("is_deleted", F.lit(False))).select("seq", "file_ord", path.alias("path"), lines.alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
    return rows.where(F.col("path").isNotNull() & (F.size("lines") > 0)).select("seq", "file_ord", "path", text.alias("text"))


def rule_hits(changes: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per commit with any: ``yara_hits`` of all its files, in order of files and rules."""
    hits = scan(added_text(changes), rules).select("seq", "file_ord", F.posexplode_outer("yara_hits").alias("ord", "hit")).where(F.col("hit").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("file_ord", "ord", "hit")))
    return hits.groupBy("seq").agg(F.transform(listed, lambda x: x["hit"]).alias("yara_hits"))


def extract_commits(raw: DataFrame, changes: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Feature rows of all single-parent commits. ``hits`` (seq, yara_hits): rule hits per commit, if scanned."""
    out = single_parent(raw)
    for part in (line_counts(changes), paths_of(changes), dependency_changes(changes), bundled_binaries(changes), *([hits] if hits is not None else [])):
        out = out.join(part, "seq", "left")
    zero = {c: 0 for c in ("total_loc", "loc_added", "loc_removed", "files_changed", "files_added", "files_removed")}
    return out.fillna(zero).withColumn("churn_ratio", C.churn_ratio(F.col("loc_added"), F.col("loc_removed")))
