"""The anomaly score of the latest commits of every repository, with its reasons."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gitsift.functions import commits as C
from gitsift.functions import scoring as S
from gitsift.operators import profiles as P
from gitsift.operators import supply
from gitsift.session import distinct_commits, stage, stage_all

AUTHOR = ("repo", "email")
NARROW = ["repo", "email", "seq", "hour_utc", "weekday_utc", "filetypes", "top_dirs", "gpg_signed", "author_committer_mismatch", "gap_seconds", "churn_ratio", "commit_delay_seconds", *P.METRICS]
OUTPUT = ["total_loc", "loc_added", "loc_removed", "files_changed", "files_added", "files_removed", "commit_msg_words", "hour_utc"]
GLOBAL_IN_SCORE = ["total_loc", "loc_added", "loc_removed", "files_changed", "commit_msg_words"]


def latest(commits: DataFrame, limit: int) -> DataFrame:
    """``sha`` of the ``limit`` latest commits of each repository in walk order, with their place (1 is the latest).

    Each task keeps no more than ``limit`` rows of a repository before the shuffle.
    """
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("seq"), "sha"))
    return commits.select("sha", "repo", "seq").withColumn("place", place).where(F.col("place") <= limit).select("sha", "place")


def is_bot(email: Column) -> Column:
    return F.lower(email).contains("[bot]")


def score_types(rows: DataFrame, repo_stats: DataFrame, author_stats: DataFrame) -> DataFrame:
    """Per scored ``sha``: mean share, frequency, pair frequency and pair ratio of its types, repository-wide (g) and by author (a), and the rarest type or pair of each.

    ``repo_stats``, ``author_stats``: from :func:`profiles.type_statistics`, stored, as they are read several times. Defaults where there is nothing to average: 100, 1, 1, 1.
    """
    cells = rows.select("sha", *AUTHOR, P.type_counts().alias("types"))
    t = cells.select("sha", *AUTHOR, F.explode("types").alias("x")).select("sha", *AUTHOR, F.col("x.t").alias("filetype"), F.col("x.place").alias("ord"))
    p = cells.select("sha", *AUTHOR, F.posexplode(P.type_pairs()).alias("ord", "x")).select("sha", *AUTHOR, "ord", "x.a", "x.b", "x.ratio")

    def means(joined: DataFrame, label: Column, values: dict[str, Column]) -> DataFrame:
        aggs = []
        for name, v in values.items():
            low = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), "ord", label.alias("label"))))
            aggs += [F.avg(v).alias(name), low["label"].alias(f"{name}_label")]
        return joined.groupBy("sha").agg(*aggs)

    out = rows.select("sha")
    for keys, stats, s in ((["repo"], repo_stats, "g"), (list(AUTHOR), author_stats, "a")):
        one = t.join(P.type_shares(stats, keys).select(*keys, "filetype", "pct", "freq"), [*keys, "filetype"], "left")
        out = out.join(means(one, F.col("filetype"), {f"pct_{s}": F.coalesce("pct", S.num(0)), f"freq_{s}": F.coalesce("freq", S.num(0))}), "sha", "left")
        two = p.join(P.pair_shares(stats, keys), [*keys, "a", "b"], "left")
        away = F.col("ratio") - F.col("mean")
        # equal ratios leave only rounding noise in the difference: that is a distance of 0
        near = F.abs(away) < 1e-9
        fit = F.when(F.col("n") >= S.MIN_PAIR_SAMPLES, F.when(near, S.num(1)).otherwise(F.col("sd") * F.col("sd") / F.when(~near, away * away)))
        out = out.join(means(two, F.concat_ws(",", "a", "b"), {f"pair_{s}": F.coalesce("freq", S.num(0)), f"ratio_{s}": fit}), "sha", "left")
    return out


def signals(commits: DataFrame, popular: DataFrame | None = None, disposable: DataFrame | None = None, domains: DataFrame | None = None, as_of: datetime | None = None, limit: int = S.WINDOW, hosts: tuple[str, str] = supply.GO_HOSTS) -> DataFrame:
    """One row per scored commit with every rarity, in columns named after it; see :func:`detect`."""
    # both are read by many branches below: written once to the shared folder
    narrow = stage(distinct_commits(commits, *NARROW), "narrow-commits")
    # the wide columns are read for the scored commits only
    rows = stage(commits.join(latest(narrow, limit), "sha").dropDuplicates(["sha"]), "scored-commits")
    counts = narrow.groupBy(*AUTHOR).agg(F.count(F.lit(1)).alias("author_commits"))
    scored_authors = rows.where(~is_bot(F.col("email"))).select(*AUTHOR).distinct()
    established = stage(counts.where(F.col("author_commits") > S.ESTABLISHED).join(scored_authors, list(AUTHOR), "left_semi").select(*AUTHOR), "established")
    own = stage(P.of_authors(narrow, established, AUTHOR), "own-commits")
    touched = rows.select("sha", *AUTHOR, F.explode(F.array_distinct("top_dirs")).alias("top_dir"))
    # results of a row per repository, author or scored commit are stored, so that each plan stays small
    parts = {
        "fits": P.wide_fits(P.tail_fits(P.metric_values(narrow, ["repo"]), ["repo", "metric"]), ["repo"], "g"),
        "author_fits": P.wide_fits(P.tail_fits(P.metric_values(own, AUTHOR), [*AUTHOR, "metric"]), AUTHOR, "a"),
        "profiles": P.author_profiles(own),
        "repo_types": P.type_statistics(narrow, ["repo"]),
        "author_types": P.type_statistics(own, AUTHOR),
        "directories": touched.join(P.directory_counts(own), [*AUTHOR, "top_dir"], "left").groupBy("sha").agg(F.min(F.coalesce("n", F.lit(0))).alias("least_dir")),
    }
    if popular is not None:
        parts["typosquats"] = supply.first_typosquat(rows, popular, hosts)
    part = stage_all(parts)
    part["types"] = stage(score_types(rows, part["repo_types"], part["author_types"]), "types")
    r = rows.join(established.withColumn("established", F.lit(True)), list(AUTHOR), "left").withColumn("established", F.coalesce("established", F.lit(False)))
    r = r.join(part["fits"], "repo", "left")
    for name in ("author_fits", "profiles"):
        r = r.join(part[name], list(AUTHOR), "left")
    for name in ("types", "directories"):
        r = r.join(part[name], "sha", "left")
    none = F.lit(None)
    if popular is not None:
        r = r.join(part["typosquats"], "sha", "left")
    else:
        r = r.withColumn("typosquat", none.cast("struct<ecosystem:string,name:string,match:string>"))
    r = r.withColumn("domain", C.email_domain(F.col("email")))
    if disposable is not None:
        r = r.join(disposable.select("domain", F.lit(True).alias("disposable")).distinct(), "domain", "left")
    else:
        r = r.withColumn("disposable", F.lit(False))
    if domains is not None:
        when = F.lit(as_of) if as_of is not None else F.current_timestamp()
        ages = domains.groupBy("domain").agg(F.min("creation_ts").alias("creation_ts"))
        r = r.join(ages.select("domain", supply.domain_age_days(F.col("creation_ts"), when).alias("age_days")), "domain", "left")
    else:
        r = r.withColumn("age_days", none.cast("long"))

    known = F.col("established")
    author = lambda x, default: F.when(known, x).otherwise(S.num(default))
    cols: dict[str, Column] = {}
    for m in P.METRICS:
        cols[f"{m}_g"] = S.tail_rarity(F.col(m), F.col(f"{m}_alpha_g"), F.col(f"{m}_beta_g"))
        cols[f"{m}_a"] = author(S.tail_rarity(F.col(m), F.col(f"{m}_alpha_a"), F.col(f"{m}_beta_a")), S.UNKNOWN)
    for name, hist, period in (("hour", "hours", 24), ("weekday", "weekdays", 7)):
        cols[f"{name}_a"] = F.coalesce(author(S.circular_rarity(F.col(f"{name}_utc"), S.circular_density(F.col(hist), period)), S.UNKNOWN), S.num(S.UNKNOWN))
    log1 = lambda c: F.log(F.col(c) + S.num(1))
    for name, x in (("gap", log1("gap_seconds")), ("delay", log1("commit_delay_seconds")), ("churn", F.col("churn_ratio"))):
        cols[f"{name}_a"] = S.normal_rarity(x, F.col(f"{name}_n"), F.col(f"{name}_mean"), F.col(f"{name}_sd"))
    total = F.coalesce("profile_total", F.lit(0))
    cols["dir_a"] = F.when((total >= S.MIN_SAMPLES) & F.col("least_dir").isNotNull(), S.num(1) - F.col("least_dir") / F.when(total > 0, total)).otherwise(S.num(S.UNKNOWN))
    for name, default in (("pct", 100), ("freq", 1), ("pair", 1), ("ratio", 1)):
        cols[f"{name}_g"] = F.coalesce(f"{name}_g", S.num(default))
        cols[f"{name}_a"] = F.coalesce(author(F.col(f"{name}_a"), default), S.num(default))
        cols[f"{name}_a_label"] = F.coalesce(F.when(known, F.col(f"{name}_a_label")), F.lit("NA"))
        cols[f"{name}_g_label"] = F.coalesce(f"{name}_g_label", F.lit("NA"))
    cols["generic_score"] = F.when(C.is_generic_message(F.col("message")) & (S.tail_rarity(F.col("total_loc"), F.col("total_loc_alpha_g"), F.col("total_loc_beta_g")) > 0.8), S.num(0.9)).otherwise(S.num(0))
    cols["identity_score"] = S.identity_score(F.col("author_committer_mismatch"), F.coalesce("mismatch_count", F.lit(0)), total)
    cols["signing_score"] = S.signing_score(F.col("gpg_signed"), F.coalesce("signed_count", F.lit(0)), total)
    cols["typosquat_score"] = F.when(F.col("typosquat").isNotNull(), S.num(0.9)).otherwise(S.num(0))
    cols["disposable_score"] = F.when(F.coalesce("disposable", F.lit(False)) & (F.col("domain") != ""), S.num(0.9)).otherwise(S.num(0))
    cols["domain_score"] = F.when((F.col("age_days") < 90) & (F.col("domain") != ""), S.num(0.7)).otherwise(S.num(0))
    cols["binary_score"] = F.when(F.size("new_binary_files") > 0, S.num(0.9)).otherwise(S.num(0))
    cols["url"] = supply.direct_url_change()
    cols["url_score"] = F.when(supply.direct_url_change().isNotNull(), S.num(0.85)).otherwise(S.num(0))
    # the first of the most severe hits
    ranked = F.array_sort(F.transform("yara_hits", lambda h, i: F.struct((-S.severity_score(h["severity"])).alias("k"), i.alias("i"), h.alias("h"))))
    cols["hit"] = F.get(ranked, 0)["h"]
    cols["n_hits"] = F.coalesce(F.size("yara_hits"), F.lit(0))
    cols["rule_score"] = F.coalesce(-F.get(ranked, 0)["k"], S.num(0))
    return r.withColumns(cols)


def mapped(name: str) -> Column:
    """Contribution of a rarity or similarity column to the score."""
    kind = name.rsplit("_", 1)[0]
    x = F.col(name)
    if kind == "pct":
        return S.contribution(S.num(1) - x / 100.0)
    if kind in ("freq", "pair", "ratio"):
        return S.contribution(S.num(1) - x)
    return S.contribution(x)


FLAT = ["typosquat", "disposable", "domain", "binary", "url", "rule"]


def score_terms() -> list[Column]:
    """The 35 terms of the score; of added and removed files only the author's side counts."""
    out = []
    for m in P.METRICS:
        out += [mapped(f"{m}_g")] * (m in GLOBAL_IN_SCORE) + [mapped(f"{m}_a")]
    out.append(mapped("hour_a"))
    for k in ("pct", "freq", "pair", "ratio"):
        out += [mapped(f"{k}_g"), mapped(f"{k}_a")]
    out.append(F.col("generic_score"))
    out += [mapped(f"{k}_a") for k in ("weekday", "gap", "delay", "churn", "dir")]
    out += [F.col("identity_score"), F.col("signing_score"), *[F.col(f"{k}_score") for k in FLAT]]
    return out


# Labels and sentences of the reasons, in the order that breaks ties.
BOT_REASON = "Bot author excluded from detection"
BOT_TEXT = "This commit's author is a recognized bot account ([bot] suffix), which is excluded from detection entirely."
METRIC_NAMES = {
    "total_loc": ("Total lines of code changed", "total lines changed"),
    "loc_added": ("Lines of code added", "lines added"),
    "loc_removed": ("Lines of code removed", "lines removed"),
    "files_changed": ("Files changed", "files touched"),
    "files_added": ("Files added", "files added"),
    "files_removed": ("Files removed", "files removed"),
    "commit_msg_words": ("Commit message length", "words in the commit message"),
}
TYPE_REASONS = [
    ("pct", "Filetype rarity (%)", "Only %s%% of all file changes (repo-wide) are to '%s' files.", "Only %s%% of this author's file changes are to '%s' files."),
    ("freq", "Filetype rarity (per-commit)", "Only %s%% of commits (repo-wide) ever touch '%s' files.", "Only %s%% of this author's commits ever touch '%s' files."),
    ("pair", "Filetype combo frequency", "Only %s%% of commits (repo-wide) touch '%s' files together.", "Only %s%% of this author's commits touch '%s' files together."),
]
RATIO_LABEL = "Filetype combo ratio"
RATIO_TEXTS = (
    "The relative amounts of '%s' files in this commit are atypical for the repo (match %s%%).",
    "The relative amounts of '%s' files in this commit are atypical for this author (match %s%%).",
)
AUTHOR_REASONS = [
    ("weekday", "Day-of-week rarity (author)", "This commit's day of week is unusual for this author (%s%% rarer than their most common day)."),
    ("gap", "Inter-commit gap rarity (author)", "The time since this author's previous commit is unusual for them (rarity %s%%)."),
    ("delay", "Author-vs-commit time delay rarity (author)", "The gap between authoring and committing this change is unusual for this author (rarity %s%%)."),
    ("churn", "Add:remove churn ratio rarity (author)", "The ratio of lines added to lines removed is unusual compared to this author's normal editing pattern (rarity %s%%)."),
    ("dir", "Directory rarity (author)", "This commit touches a top-level directory this author rarely or never touches (rarity %s%%)."),
]

METRIC_TEXT = "%s%% of {whose} have %s or more {noun}."
WHOSE = ("commits (repo-wide)", "this author's commits")
HOUR = ("Hour of day (author)", "This commit's hour of day (UTC %d:00) is unusual for this author (%s%% rarer than their most common hour).")
GENERIC = ("Generic message on large diff", "The commit message reads as generic ('wip'/'fix'/'update'-style) despite this being an unusually large diff.")
MISMATCH = ("Author/committer email mismatch", "The commit's author and committer identities differ, which is unusual for this author.")
UNSIGNED = ("Unsigned commit from usually-signing author", "This author usually signs their commits with GPG, but this one is unsigned.")
# label, sentence where there is nothing, sentence where there is something
TYPOSQUAT = (
    "Possible typosquat dependency",
    "No newly added dependency resembles a popular package name.",
    "The newly added %s dependency '%s' closely resembles the popular package '%s' -- possible typosquat.",
)
DISPOSABLE = (
    "Disposable author email domain",
    "Author email domain is not a known disposable/temp-mail domain.",
    "The commit author's email domain ('%s') is a known disposable/temp-mail domain.",
)
YOUNG_DOMAIN = (
    "Recently-registered author email domain",
    "Author email domain's WHOIS registration age is not suspiciously recent.",
    "The commit author's email domain ('%s') was registered only %d days ago -- possible expired-domain account takeover.",
)
BINARY = (
    "Bundled binary disguised as non-executable file",
    "No newly added file has binary magic bytes under a non-executable-looking name.",
    "'%s' is a native %s binary disguised under a non-executable-looking filename.",
)
DIRECT_URL = (
    "Direct-URL dependency",
    "No dependency was added/changed to a direct URL instead of a registry version.",
    "The %s dependency '%s' was changed from a pinned version ('%s') to a direct URL ('%s'), which isn't immutable and bypasses registry integrity checks.",
    "The newly added %s dependency '%s' points at a direct URL ('%s') instead of a registry version.",
)
RULE_HIT = (
    "YARA content match",
    "No content introduced by this commit matches a known malicious-pattern rule.",
    "Content added to '%s' matches the '%s' pattern (%s-severity), a known malicious-code indicator%s.",
    " (+%d more rule hit%s)",
)


def _decimal(x: Column) -> Column:
    """One decimal, as text; half up, whatever the last digits of sums and quotients."""
    return F.format_string("%.1f", F.round(F.round(x, 9), 1))


def _pct(x: Column) -> Column:
    return _decimal(x * 100.0)


def reasons() -> list[tuple[str, Column, Column]]:
    """(label, strength, sentence) of the 26 possible reasons; the author's sentence if its side is at least as strong."""
    out: list[tuple[str, Column, Column]] = []

    def two(label: str, g: Column, a: Column, text_g: Column, text_a: Column) -> None:
        out.append((label, F.greatest(g, a), F.when(a >= g, text_a).otherwise(text_g)))

    def one(label: str, strength: Column, text: Column) -> None:
        out.append((label, strength, text))

    def either(texts: tuple[str, ...], strength: str, nothing: Column, *values: Column) -> None:
        one(texts[0], F.col(strength), F.when(nothing, F.lit(texts[1])).otherwise(fmt(texts[2], *values)))

    fmt = F.format_string
    for m, (label, noun) in METRIC_NAMES.items():
        g, a = (fmt(METRIC_TEXT.format(whose=whose, noun=noun), _pct(S.num(1) - F.col(f"{m}_{side}")), F.coalesce(F.col(m).cast("string"), F.lit("None"))) for side, whose in zip("ga", WHOSE))
        two(label, mapped(f"{m}_g"), mapped(f"{m}_a"), g, a)
    one(HOUR[0], F.greatest(S.num(0), mapped("hour_a")), fmt(HOUR[1], F.col("hour_utc"), _pct(F.col("hour_a"))))
    for k, label, text_g, text_a in TYPE_REASONS:
        show = _decimal if k == "pct" else _pct
        two(label, mapped(f"{k}_g"), mapped(f"{k}_a"), fmt(text_g, show(F.col(f"{k}_g")), F.col(f"{k}_g_label")), fmt(text_a, show(F.col(f"{k}_a")), F.col(f"{k}_a_label")))
    two(RATIO_LABEL, mapped("ratio_g"), mapped("ratio_a"), fmt(RATIO_TEXTS[0], F.col("ratio_g_label"), _pct(F.col("ratio_g"))), fmt(RATIO_TEXTS[1], F.col("ratio_a_label"), _pct(F.col("ratio_a"))))
    one(GENERIC[0], F.col("generic_score"), F.lit(GENERIC[1]))
    for k, label, text in AUTHOR_REASONS:
        one(label, F.greatest(S.num(0), mapped(f"{k}_a")), fmt(text, _pct(F.col(f"{k}_a"))))
    one(MISMATCH[0], F.col("identity_score"), F.lit(MISMATCH[1]))
    one(UNSIGNED[0], F.col("signing_score"), F.lit(UNSIGNED[1]))
    t, u, h, first, n = F.col("typosquat"), F.col("url"), F.col("hit"), F.get("new_binary_files", 0), F.col("n_hits")
    either(TYPOSQUAT, "typosquat_score", t.isNull(), t["ecosystem"], t["name"], t["match"])
    either(DISPOSABLE, "disposable_score", F.col("disposable_score") == 0, F.substring_index("email", "@", -1))
    either(YOUNG_DOMAIN, "domain_score", F.col("domain_score") == 0, F.col("domain"), F.col("age_days"))
    either(BINARY, "binary_score", F.col("binary_score") == 0, first["path"], first["kind"])
    went = fmt(DIRECT_URL[2], u["ecosystem"], u["name"], u["old_spec"], u["spec"])
    one(DIRECT_URL[0], F.col("url_score"), F.when(u.isNull(), F.lit(DIRECT_URL[1])).when(u["kind"] == "changed", went).otherwise(fmt(DIRECT_URL[3], u["ecosystem"], u["name"], u["spec"])))
    more = F.when(n > 1, fmt(RULE_HIT[3], n - 1, F.when(n > 2, "s").otherwise(""))).otherwise("")
    either(RULE_HIT, "rule_score", h.isNull(), h["path"], h["description"], h["severity"], more)
    return out


def detect(commits: DataFrame, popular: DataFrame | None = None, disposable: DataFrame | None = None, domains: DataFrame | None = None, as_of: datetime | None = None, limit: int = S.WINDOW, threshold: float = S.THRESHOLD, hosts: tuple[str, str] = supply.GO_HOSTS) -> DataFrame:
    """Score the latest ``limit`` commits of each repository.

    ``commits``: feature rows with ``repo`` and ``seq``, one or more deliveries per ``sha``. Optional lists: ``popular`` (ecosystem, name), ``disposable`` (domain),
    ``domains`` (domain, creation_ts; ages are taken at ``as_of``, by default now).
    Result: ``repo``, ``seq``, ``sha`` (7 characters), ``email``, ``decision``, ``decision_val``, the size columns, ``top_reasons``, ``top_reasons_explained``.

    Authors of at most 20 commits get the fixed rarities of an unknown author. The profile leaves out
    the author's last commit only. Bot authors are listed as Normal with score 0. A null size counts as 0 and is no sample of the
    fits; a null signature is unsigned; null or empty types, directories and dependencies give the defaults. No commits: no rows.
    """
    s = signals(commits, popular, disposable, domains, as_of, limit, hosts)
    bot = is_bot(F.col("email"))
    value = F.when(bot, S.num(0)).otherwise(S.prob_or(score_terms()))
    listed = F.array(*[F.struct((-strength).alias("k"), F.lit(i).alias("i"), F.lit(label).alias("label"), text.alias("text")) for i, (label, strength, text) in enumerate(reasons())])
    top = F.slice(F.array_sort("listed"), 1, 5)
    named = F.transform("top", lambda x: F.format_string("%s (score %.2f)", x["label"], -x["k"]))
    told = F.transform("top", lambda x: x["text"])
    bot_only = lambda text, other: F.when(bot, F.array(F.lit(text))).otherwise(other)
    scored = s.withColumns({"value": value, "listed": listed}).withColumn("top", top)
    return scored.select(
        "repo",
        "seq",
        F.substring("sha", 1, 7).alias("sha"),
        "email",
        F.when(~bot & (F.col("value") >= threshold), "Unusual").otherwise("Normal").alias("decision"),
        F.round("value", 4).alias("decision_val"),
        *OUTPUT,
        bot_only(BOT_REASON, named).alias("top_reasons"),
        bot_only(BOT_TEXT, told).alias("top_reasons_explained"),
    )
