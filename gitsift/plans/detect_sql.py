"""The whole score and its reasons in SQL, written from the definition and apart from the operators: what the detection is compared with."""

from __future__ import annotations

from gitsift.plans.profile_queries import _HABITS, LONG, PROFILE, _fits, _normal_sql
from gitsift.plans.profile_queries import C as COMMITS


def _tail(fit: str) -> str:
    return f"CASE WHEN mv.x = 0 THEN 0 ELSE greatest(0, 1 - power({fit}.alpha / mv.x, {fit}.beta)) END"


def _wide(side: str, default: str) -> str:
    names = ["total_loc", "loc_added", "loc_removed", "files_changed", "files_added", "files_removed", "commit_msg_words"]
    return ", ".join(f"coalesce(max({side}) FILTER (metric = '{m}'), {default}) AS {m}_{side}" for m in names)


def _circle(column: str, period: int) -> str:
    c = column[0]
    return f"""{c}h AS (SELECT repo, email, {column} AS v, count(*) AS n FROM prof GROUP BY ALL), {c}q AS (SELECT unnest(range({period})) AS q),
{c}d AS (SELECT repo, email, q, sum(n * exp(4 * cos(2 * pi() * (q - v) / {period}))) AS d FROM {c}h, {c}q GROUP BY ALL), {c}r AS (SELECT repo, email, q, 1 - d / max(d) OVER (PARTITION BY repo, email) AS rarity FROM {c}d)"""


def _types(tag: str, keys: str) -> str:
    """Type and pair statistics by ``keys``, and their means over each scored commit."""
    return f"""n{tag} AS (SELECT {keys}, count(*) AS commits FROM c GROUP BY ALL), t{tag} AS (SELECT {keys}, ft, sum(n) AS files, count(*) AS n FROM t GROUP BY ALL),
v{tag} AS (SELECT {keys}, ft, files * 100.0 / sum(files) OVER (PARTITION BY {keys}) AS pct, n / commits AS freq FROM t{tag} JOIN n{tag} USING ({keys})),
p{tag} AS (SELECT {keys}, a, b, count(*) AS n, avg(ratio) AS mean, stddev_samp(ratio) AS sd FROM p GROUP BY ALL), q{tag} AS (SELECT *, n / commits AS freq FROM p{tag} JOIN n{tag} USING ({keys})),
o{tag} AS (SELECT sha, avg(pct) AS pct, list_sort(list({{'v': pct, 'o': place, 'l': ft}}))[1].l AS pct_l, avg(freq) AS freq, list_sort(list({{'v': freq, 'o': place, 'l': ft}}))[1].l AS freq_l FROM (SELECT t.sha, t.ft, t.place, v.pct, v.freq FROM t JOIN r USING (sha) JOIN v{tag} v ON {" AND ".join(f"t.{k} = v.{k}" for k in keys.split(", "))} AND t.ft = v.ft) GROUP BY sha),
w{tag} AS (SELECT p.sha, p.a || ',' || p.b AS label, row_number() OVER (PARTITION BY p.sha ORDER BY p.a, p.b) AS place, q.freq, CASE WHEN q.n >= 10 THEN CASE WHEN abs(p.ratio - q.mean) < 1e-9 THEN 1 ELSE q.sd * q.sd / power(p.ratio - q.mean, 2) END END AS fit
  FROM p JOIN r USING (sha) JOIN q{tag} q ON {" AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))} AND p.a = q.a AND p.b = q.b),
x{tag} AS (SELECT sha, avg(freq) AS pair, list_sort(list({{'v': freq, 'o': place, 'l': label}}))[1].l AS pair_l, avg(fit) AS ratio, list_sort(list({{'v': fit, 'o': place, 'l': label}}) FILTER (fit IS NOT NULL))[1].l AS ratio_l FROM w{tag} GROUP BY sha)"""


def _m(x: str) -> str:
    return f"(1 - power(1 - ({x}), 1 / 15.0))"


def _pct(x: str) -> str:
    return f"printf('%.1f', round(round(({x}) * 100.0, 9), 1))"


def _reason(i: int, strength: str, label: str, text: str) -> str:
    return f"{{'k': -({strength})::DOUBLE, 'i': {i}, 'l': '{label}', 't': {text}}}"


def _two(i: int, g: str, a: str, label: str, text_g: str, text_a: str) -> str:
    return _reason(i, f"greatest({g}, {a})", label, f"CASE WHEN {a} >= {g} THEN {text_a} ELSE {text_g} END")


def _size(i: int, m: str, label: str, noun: str) -> str:
    say = lambda side, whose: f"{_pct(f'1 - {m}_{side}')} || '% of {whose} have ' || coalesce({m}::VARCHAR, 'None') || ' or more {noun}.'"
    return _two(i, _m(f"{m}_g"), _m(f"{m}_a"), label, say("g", "commits (repo-wide)"), say("a", "this author''s commits"))


def _habit(i: int, k: str, label: str, before: str, after: str) -> str:
    return _reason(i, f"greatest(0, {_m(f'{k}_a')})", label, f"'{before}' || {_pct(f'{k}_a')} || '{after}'")


REASONS = ",\n".join([
    _size(0, "total_loc", "Total lines of code changed", "total lines changed"),
    _size(1, "loc_added", "Lines of code added", "lines added"),
    _size(2, "loc_removed", "Lines of code removed", "lines removed"),
    _size(3, "files_changed", "Files changed", "files touched"),
    _size(4, "files_added", "Files added", "files added"),
    _size(5, "files_removed", "Files removed", "files removed"),
    _size(6, "commit_msg_words", "Commit message length", "words in the commit message"),
    _reason(7, f"greatest(0, {_m('hour_a')})", "Hour of day (author)", f"'This commit''s hour of day (UTC ' || hour_utc || ':00) is unusual for this author (' || {_pct('hour_a')} || '% rarer than their most common hour).'"),
    _two(8, _m("1 - pct_g / 100"), _m("1 - pct_a / 100"), "Filetype rarity (%)", "'Only ' || printf('%.1f', round(round(pct_g, 9), 1)) || '% of all file changes (repo-wide) are to ''' || pct_g_l || ''' files.'", "'Only ' || printf('%.1f', round(round(pct_a, 9), 1)) || '% of this author''s file changes are to ''' || pct_a_l || ''' files.'"),
    _two(9, _m("1 - freq_g"), _m("1 - freq_a"), "Filetype rarity (per-commit)", f"'Only ' || {_pct('freq_g')} || '% of commits (repo-wide) ever touch ''' || freq_g_l || ''' files.'", f"'Only ' || {_pct('freq_a')} || '% of this author''s commits ever touch ''' || freq_a_l || ''' files.'"),
    _two(10, _m("1 - pair_g"), _m("1 - pair_a"), "Filetype combo frequency", f"'Only ' || {_pct('pair_g')} || '% of commits (repo-wide) touch ''' || pair_g_l || ''' files together.'", f"'Only ' || {_pct('pair_a')} || '% of this author''s commits touch ''' || pair_a_l || ''' files together.'"),
    _two(11, _m("1 - ratio_g"), _m("1 - ratio_a"), "Filetype combo ratio", f"'The relative amounts of ''' || ratio_g_l || ''' files in this commit are atypical for the repo (match ' || {_pct('ratio_g')} || '%).'", f"'The relative amounts of ''' || ratio_a_l || ''' files in this commit are atypical for this author (match ' || {_pct('ratio_a')} || '%).'"),
    _reason(12, "generic", "Generic message on large diff", "'The commit message reads as generic (''wip''/''fix''/''update''-style) despite this being an unusually large diff.'"),
    _habit(13, "weekday", "Day-of-week rarity (author)", "This commit''s day of week is unusual for this author (", "% rarer than their most common day)."),
    _habit(14, "gap", "Inter-commit gap rarity (author)", "The time since this author''s previous commit is unusual for them (rarity ", "%)."),
    _habit(15, "delay", "Author-vs-commit time delay rarity (author)", "The gap between authoring and committing this change is unusual for this author (rarity ", "%)."),
    _habit(16, "churn", "Add:remove churn ratio rarity (author)", "The ratio of lines added to lines removed is unusual compared to this author''s normal editing pattern (rarity ", "%)."),
    _habit(17, "dir", "Directory rarity (author)", "This commit touches a top-level directory this author rarely or never touches (rarity ", "%)."),
    _reason(18, "identity", "Author/committer email mismatch", "'The commit''s author and committer identities differ, which is unusual for this author.'"),
    _reason(19, "signing", "Unsigned commit from usually-signing author", "'This author usually signs their commits with GPG, but this one is unsigned.'"),
    _reason(20, "squat_s", "Possible typosquat dependency", "CASE WHEN squat IS NULL THEN 'No newly added dependency resembles a popular package name.' ELSE 'The newly added ' || squat.ecosystem || ' dependency ''' || squat.name || ''' closely resembles the popular package ''' || squat.match || ''' -- possible typosquat.' END"),
    _reason(21, "throwaway", "Disposable author email domain", "CASE WHEN throwaway = 0 THEN 'Author email domain is not a known disposable/temp-mail domain.' ELSE 'The commit author''s email domain (''' || regexp_extract(email, '.*@(.*)', 1) || ''') is a known disposable/temp-mail domain.' END"),
    _reason(22, "fresh", "Recently-registered author email domain", "CASE WHEN fresh = 0 THEN 'Author email domain''s WHOIS registration age is not suspiciously recent.' ELSE 'The commit author''s email domain (''' || domain || ''') was registered only ' || age_days || ' days ago -- possible expired-domain account takeover.' END"),
    _reason(23, "bundled", "Bundled binary disguised as non-executable file", "CASE WHEN bundled = 0 THEN 'No newly added file has binary magic bytes under a non-executable-looking name.' ELSE '''' || nb[1].path || ''' is a native ' || nb[1].kind || ' binary disguised under a non-executable-looking filename.' END"),
    _reason(24, "url", "Direct-URL dependency", "CASE WHEN went IS NOT NULL THEN 'The ' || went.ecosystem || ' dependency ''' || went.name || ''' was changed from a pinned version (''' || went.old_spec || ''') to a direct URL (''' || went.new_spec || '''), which isn''t immutable and bypasses registry integrity checks.' WHEN came IS NOT NULL THEN 'The newly added ' || came.ecosystem || ' dependency ''' || came.name || ''' points at a direct URL (''' || came.spec || ''') instead of a registry version.' ELSE 'No dependency was added/changed to a direct URL instead of a registry version.' END"),
    _reason(25, "rule", "YARA content match", "CASE WHEN hit IS NULL THEN 'No content introduced by this commit matches a known malicious-pattern rule.' ELSE 'Content added to ''' || hit.path || ''' matches the ''' || hit.description || ''' pattern (' || hit.severity || '-severity), a known malicious-code indicator' || CASE WHEN len(yh) > 2 THEN ' (+' || (len(yh) - 1) || ' more rule hits)' WHEN len(yh) = 2 THEN ' (+1 more rule hit)' ELSE '' END || '.' END"),
])

TERMS = ", ".join([
    *[_m(f"{m}_{s}") for m in ("total_loc", "loc_added", "loc_removed", "files_changed", "commit_msg_words") for s in "ga"], _m("files_added_a"), _m("files_removed_a"), _m("hour_a"),
    *[_m(f"1 - {k}_{s}{' / 100' if k == 'pct' else ''}") for k in ("pct", "freq", "pair", "ratio") for s in "ga"], "generic", *[_m(f"{k}_a") for k in ("weekday", "gap", "delay", "churn", "dir")],
    "identity", "signing", "squat_s", "throwaway", "fresh", "bundled", "url", "rule",
])


def detect_sql(forms: str, squats: str, url: str, as_of: str) -> str:
    """CTEs that end in ``scored``: a row per scored commit with value, decision and reasons (``top``: as a list)."""
    known = "(n_author > 20)"
    author = lambda x, default: f"CASE WHEN {known} THEN coalesce({x}, {default}) ELSE {default} END"
    return rf"""WITH RECURSIVE {COMMITS}, {PROFILE}, {LONG}, {_fits("repo", "g")}, {_fits("repo, email", "a")}, {_HABITS}, {forms}, {squats},
y AS (SELECT sha, any_value(new_binary_files) AS nb, any_value(yara_hits) AS yh FROM commits WHERE sha IS NOT NULL GROUP BY sha),
na AS (SELECT repo, email, count(*) AS n_author FROM c GROUP BY ALL),
r AS (SELECT c.*, n_author FROM c JOIN na USING (repo, email) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY seq DESC, c.sha) <= 200),
mv AS (SELECT u.* FROM u JOIN r USING (sha)), ms AS (SELECT mv.sha, mv.metric, {_tail("fitg")} AS g, {_tail("fita")} AS a FROM mv JOIN fitg ON fitg.repo = mv.repo AND fitg.metric = mv.metric JOIN fita ON fita.repo = mv.repo AND fita.email = mv.email AND fita.metric = mv.metric),
sizes AS (SELECT sha, {_wide("g", "0")}, {_wide("a", "0")} FROM ms GROUP BY sha),
{_circle("hour_utc", 24)}, {_circle("weekday_utc", 7)},
pt AS (SELECT repo, email, count(*) AS total, count(*) FILTER (coalesce(gpg_signed, false)) AS signed, count(*) FILTER (coalesce(mismatch, false)) AS mm FROM prof GROUP BY ALL),
dc AS (SELECT repo, email, dir, count(*) AS n FROM (SELECT repo, email, unnest(list_distinct(top_dirs)) AS dir FROM prof) GROUP BY ALL),
dr AS (SELECT x.sha, min(coalesce(dc.n, 0)) AS least FROM (SELECT sha, repo, email, unnest(list_distinct(top_dirs)) AS dir FROM r) x LEFT JOIN dc ON dc.repo = x.repo AND dc.email = x.email AND dc.dir = x.dir GROUP BY x.sha),
t AS (SELECT repo, email, sha, ft, count(*) AS n, min(place) AS place FROM (SELECT repo, email, sha, unnest(l) AS ft, generate_subscripts(l, 1) AS place FROM (SELECT *, list_filter(filetypes, lambda x: x IS NOT NULL) AS l FROM c)) GROUP BY ALL),
p AS (SELECT x.repo, x.email, x.sha, x.ft AS a, y.ft AS b, log10(x.n / y.n) AS ratio FROM t x JOIN t y ON x.sha = y.sha AND x.ft < y.ft),
{_types("rr", "repo")}, {_types("aa", "repo, email")},
dreg AS (SELECT domain, min(creation_ts) AS creation FROM domain_reg GROUP BY domain), ds AS (SELECT DISTINCT domain, true AS listed FROM domain_reg WHERE creation_ts IS NULL),
b0 AS (SELECT r.*, y.nb, y.yh, CASE WHEN contains(email, '@') THEN lower(regexp_extract(email, '.*@(.*)', 1)) ELSE '' END AS domain FROM r JOIN y USING (sha)),
b1 AS (SELECT b0.*, sizes.* EXCLUDE (sha) REPLACE ({", ".join(f"CASE WHEN {known} THEN sizes.{m}_a ELSE 0.5 END AS {m}_a" for m in ("total_loc", "loc_added", "loc_removed", "files_changed", "files_added", "files_removed", "commit_msg_words"))}),
  {author("hr.rarity", "0.5")} AS hour_a, {author("wr.rarity", "0.5")} AS weekday_a, CASE WHEN {known} THEN coalesce(pt.total, 0) ELSE 0 END AS total, pt.signed, pt.mm, dr.least, z.h AS squat, coalesce(ds.listed, false) AS listed,
  floor((epoch(TIMESTAMP '{as_of}') - floor(epoch(dreg.creation))) / 86400)::BIGINT AS age_days,
  CASE WHEN {known} THEN {_normal_sql("ln(gap_seconds + 1)", "gn", "gm", "gsd")} ELSE 0.5 END AS gap_a, CASE WHEN {known} THEN {_normal_sql("ln(commit_delay_seconds + 1)", "dn", "a.dm", "dsd")} ELSE 0.5 END AS delay_a, CASE WHEN {known} THEN {_normal_sql("churn_ratio", "cn", "cm", "csd")} ELSE 0.5 END AS churn_a,
  {", ".join(f"coalesce({o}rr.{k}, {d}) AS {k}_g, coalesce({o}rr.{k}_l, 'NA') AS {k}_g_l, {author(f'{o}aa.{k}', d)} AS {k}_a, CASE WHEN {known} THEN coalesce({o}aa.{k}_l, 'NA') ELSE 'NA' END AS {k}_a_l" for o, k, d in (("o", "pct", 100), ("o", "freq", 1), ("x", "pair", 1), ("x", "ratio", 1)))},
  list_filter(changed_deps, lambda d: regexp_matches(d.new_spec, '{url}') AND NOT regexp_matches(d.old_spec, '{url}'))[1] AS went, list_filter(new_deps, lambda d: regexp_matches(d.spec, '{url}'))[1] AS came,
  list_sort(list_transform(yh, lambda one, i: {{'k': -(CASE one.severity WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.5 END)::DOUBLE, 'i': i, 'h': one}}))[1] AS ranked
  FROM b0 JOIN sizes USING (sha) LEFT JOIN hr ON hr.repo = b0.repo AND hr.email = b0.email AND hr.q = b0.hour_utc LEFT JOIN wr ON wr.repo = b0.repo AND wr.email = b0.email AND wr.q = b0.weekday_utc
  LEFT JOIN pt ON pt.repo = b0.repo AND pt.email = b0.email LEFT JOIN a ON a.repo = b0.repo AND a.email = b0.email LEFT JOIN dr ON dr.sha = b0.sha LEFT JOIN z ON z.sha = b0.sha LEFT JOIN dreg ON dreg.domain = b0.domain LEFT JOIN ds ON ds.domain = b0.domain
  LEFT JOIN orr ON orr.sha = b0.sha LEFT JOIN xrr ON xrr.sha = b0.sha LEFT JOIN oaa ON oaa.sha = b0.sha LEFT JOIN xaa ON xaa.sha = b0.sha),
b2 AS (SELECT *, contains(lower(email), '[bot]') AS bot, CASE WHEN total >= 5 AND least IS NOT NULL THEN 1 - least / total ELSE 0.5 END AS dir_a,
  CASE WHEN regexp_matches(trim(string_split(message, chr(10))[1], E' \t\r'), '^(?i:wip|update|updates|fix|fixes|fixed|minor|misc|stuff|changes|tweak|typo|cleanup|refactor|small fix|quick fix)\.?$') AND total_loc_g > 0.8 THEN 0.9 ELSE 0 END::DOUBLE AS generic,
  CASE WHEN total >= 5 AND coalesce(mismatch, false) AND mm / total < 0.2 THEN 0.35 * (1 - mm / total / 0.2) ELSE 0 END::DOUBLE AS identity, CASE WHEN total >= 5 AND signed > total * 0.5 AND NOT coalesce(gpg_signed, false) THEN 0.85 ELSE 0 END::DOUBLE AS signing,
  CASE WHEN squat IS NOT NULL THEN 0.9 ELSE 0 END::DOUBLE AS squat_s, CASE WHEN listed AND domain <> '' THEN 0.9 ELSE 0 END::DOUBLE AS throwaway, CASE WHEN age_days < 90 AND domain <> '' THEN 0.7 ELSE 0 END::DOUBLE AS fresh,
  CASE WHEN len(nb) > 0 THEN 0.9 ELSE 0 END::DOUBLE AS bundled, CASE WHEN went IS NOT NULL OR came IS NOT NULL THEN 0.85 ELSE 0 END::DOUBLE AS url, ranked.h AS hit, coalesce(-ranked.k, 0) AS rule FROM b1),
b3 AS (SELECT *, CASE WHEN bot THEN 0 ELSE 1 - list_aggregate(list_transform([{TERMS}], lambda v: 1 - v), 'product') END AS value, list_sort([{REASONS}])[1:5] AS top FROM b2),
scored AS (SELECT repo, seq, sha[1:7] AS sha, email, CASE WHEN NOT bot AND value >= 0.962 THEN 'Unusual' ELSE 'Normal' END AS decision, round(value, 4) AS decision_val, total_loc, loc_added, loc_removed, files_changed, files_added, files_removed, commit_msg_words, hour_utc,
  CASE WHEN bot THEN 'Bot author excluded from detection' ELSE array_to_string(list_transform(top, lambda x: x.l || ' (score ' || printf('%.2f', -x.k) || ')'), ' | ') END AS top_reasons,
  CASE WHEN bot THEN 'This commit''s author is a recognized bot account ([bot] suffix), which is excluded from detection entirely.' ELSE array_to_string(list_transform(top, lambda x: x.t), ' | ') END AS top_reasons_explained, top FROM b3)
"""
