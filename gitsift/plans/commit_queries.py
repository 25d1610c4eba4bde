"""Queries over raw commits, patches, dependencies and identities, and the score itself."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitsift.functions import commits as C
from gitsift.functions import scoring as S
from gitsift.operators import extract, profiles, supply
from gitsift.operators.detect import detect, is_bot
from gitsift.plans.detect_sql import detect_sql
from gitsift.plans.profile_queries import C as COMMITS
from gitsift.plans.profile_queries import LONG, _commits, _fits
from gitsift.plans.registry import Registry
from gitsift.rules.basic import BASIC
from gitsift.rules.engine import EXCLUDED_DIRS, Rule, Text, number, path_excluded, path_matches, scan, truth
from gitsift.rules.textfiles import parse_rules
from gitsift.session import scratch_path, table
from gitsift.sources import files
from gitsift.streaming import scorer

R = Registry()

AS_OF = datetime(2024, 1, 1)
HOSTS = ("codeforge.example/", "githarbor.example/")


@R.query("""
WITH r AS (SELECT sha, any_value(repo) AS repo, any_value(seq) AS seq, any_value(author_email) AS a, any_value(committer_email) AS ce, any_value(authored_epoch) AS t, any_value(committed_epoch) AS ct,
                  any_value(message) AS message, any_value(signature) AS signature FROM raw_commits WHERE len(parents) = 1 GROUP BY sha),
e AS (SELECT *, coalesce(nullif(a, ''), 'unknown') AS e0, coalesce(nullif(ce, ''), 'unknown') AS committer_email FROM r),
m AS (SELECT *, CASE WHEN contains(e0, '//') THEN replace(replace(e0, ':', ''), '//', '') ELSE e0 END AS email FROM e)
SELECT sha, repo, seq, email, committer_email, hour(make_timestamp(t * 1000000))::INT AS hour_utc, (isodow(make_timestamp(t * 1000000)) - 1)::INT AS weekday_utc,
  len(string_split(coalesce(message, ''), ' '))::INT AS commit_msg_words, trim(coalesce(message, ''), E' \\t\\r\\n\\x0b\\x0c') AS message, signature IS NOT NULL AS gpg_signed, lower(email) <> lower(committer_email) AS author_committer_mismatch,
  abs(t - lag(t) OVER (PARTITION BY repo, email ORDER BY seq))::DOUBLE AS gap_seconds, greatest(0, ct - t)::DOUBLE AS commit_delay_seconds FROM m
""")
def raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header features of all single-parent commits from the raw history."""
    return extract.single_parent(table(spark, sf_dir, "raw_commits")).drop("authored_ts")


# A view of changed files made from the documents: each is the patch of one file, four in turn make up a commit. Lines of npm dependencies
# are written in the notation of the manifest that the file is.
PATHS = ["web/package.json", "svc/go.mod", "Gemfile", "requirements.txt", "src/app.py", "docs/v1.2/LICENSE", "assets/logo.PNG"]
HEADERS = ["4D5A9000", "7F454C46", "FEEDFACE", "89504E47"]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    dep = r'"([\w-]+)": "\^([\d.]+)",'
    rows = d.select("doc_id", "text", pick(PATHS, i % 7).alias("path"), (i % 5 == 0).alias("is_new"), ((i % 5 != 0) & (i % 11 == 1)).alias("is_deleted"))
    patch = F.when(F.col("path") == "svc/go.mod", F.regexp_replace("text", dep, r"$1.example/mod v$2")).when(F.col("path") == "Gemfile", F.regexp_replace("text", dep, r'gem "$1", "~> $2"')).otherwise(F.col("text"))
    return rows.select(
        F.expr("doc_id div 4").alias("seq"), (i % 4).cast("int").alias("file_ord"), F.when(~F.col("is_new"), F.col("path")).alias("a_path"), F.when(~F.col("is_deleted"), F.col("path")).alias("b_path"), "is_new", "is_deleted",
        patch.alias("patch"), F.when(F.col("is_new"), F.unhex(pick(HEADERS, F.expr("(doc_id div 5) % 4")))).alias("header"),
    )


_FILES = r"""
p AS (SELECT doc_id, doc_id // 4 AS seq, (doc_id % 4)::INT AS file_ord, ['web/package.json', 'svc/go.mod', 'Gemfile', 'requirements.txt', 'src/app.py', 'docs/v1.2/LICENSE', 'assets/logo.PNG'][doc_id % 7 + 1] AS path,
  doc_id % 5 = 0 AS is_new, doc_id % 5 <> 0 AND doc_id % 11 = 1 AS is_deleted, text FROM documents),
f AS (SELECT *, CASE path WHEN 'svc/go.mod' THEN regexp_replace(text, '"([\w-]+)": "\^([\d.]+)",', '\1.example/mod v\2', 'g') WHEN 'Gemfile' THEN regexp_replace(text, '"([\w-]+)": "\^([\d.]+)",', 'gem "\1", "~> \2"', 'g') ELSE text END AS patch FROM p),
l AS (SELECT seq, file_ord, path, unnest(string_split(coalesce(patch, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(patch, ''), chr(10)), 1) AS ord FROM f),
d AS (SELECT seq, file_ord, path, ord, line[1] AS sign, line[2:] AS body FROM l WHERE line[1] IN ('+', '-') AND NOT starts_with(line, '+++') AND NOT starts_with(line, '---'))
"""
_COUNTS = """n AS (SELECT seq, (count(*) FILTER (sign = '+'))::BIGINT AS loc_added, (count(*) FILTER (sign = '-'))::BIGINT AS loc_removed FROM d GROUP BY seq),
w AS (SELECT seq, count(*)::INT AS files_changed, (count(*) FILTER (is_new))::INT AS files_added, (count(*) FILTER (is_deleted))::INT AS files_removed FROM f GROUP BY seq),
m AS (SELECT seq, coalesce(loc_added, 0) + coalesce(loc_removed, 0) AS total_loc, coalesce(loc_added, 0) AS loc_added, coalesce(loc_removed, 0) AS loc_removed, files_changed, files_added, files_removed FROM w LEFT JOIN n USING (seq))"""


@R.query(f"WITH {_FILES}, {_COUNTS} SELECT * FROM m")
def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and files added and removed by each commit."""
    return extract.line_counts(_changes(spark, sf_dir))


_DEPS = r"""
k AS (SELECT seq, file_ord, sign, ord, 'npm' AS ecosystem, regexp_extract(body, '^\s*"([^"]+)"\s*:\s*"([^"]*)"\s*,?\s*$', 1) AS name, regexp_extract(body, '^\s*"([^"]+)"\s*:\s*"([^"]*)"\s*,?\s*$', 2) AS spec FROM d
    WHERE path = 'web/package.json' AND regexp_matches(body, '^\s*"([^"]+)"\s*:\s*"([^"]*)"\s*,?\s*$') AND NOT starts_with(trim(body)[2:], '_') AND regexp_extract(body, '"([^"]+)"', 1) NOT IN ('name', 'version', 'description', 'main', 'license', 'author', 'homepage',
      'repository', 'scripts', 'engines', 'private', 'type', 'module', 'exports', 'files', 'keywords', 'bin', 'browser', 'sideEffects', 'packageManager', 'types', 'typings', 'publishConfig', 'funding', 'bugs', 'directories')
  UNION ALL SELECT seq, file_ord, sign, ord, 'go', regexp_extract(body, '^\s*([\w\-.]+\.[\w\-.]+(?:/[\w\-./]+)*)\s+(v[\w.\-+]+)', 1), regexp_extract(body, '^\s*([\w\-.]+\.[\w\-.]+(?:/[\w\-./]+)*)\s+(v[\w.\-+]+)', 2) FROM d
    WHERE path = 'svc/go.mod' AND regexp_matches(body, '^\s*([\w\-.]+\.[\w\-.]+(?:/[\w\-./]+)*)\s+(v[\w.\-+]+)')
  UNION ALL SELECT seq, file_ord, sign, ord, 'rubygems', regexp_extract(body, '^\s*gem\s+["'']([\w\-.]+)["''](?:\s*,\s*["'']([^"'']*)["''])?', 1), regexp_extract(body, '^\s*gem\s+["'']([\w\-.]+)["''](?:\s*,\s*["'']([^"'']*)["''])?', 2) FROM d
    WHERE path = 'Gemfile' AND regexp_matches(body, '^\s*gem\s+["'']([\w\-.]+)["''](?:\s*,\s*["'']([^"'']*)["''])?')
  UNION ALL SELECT seq, file_ord, sign, ord, 'pypi', lower(regexp_extract(trim(body), '^([A-Za-z0-9][\w\-.]*)\s*([=<>!~][^\s#]*)?', 1)), regexp_extract(trim(body), '^([A-Za-z0-9][\w\-.]*)\s*([=<>!~][^\s#]*)?', 2) FROM d
    WHERE path = 'requirements.txt' AND regexp_matches(trim(body, E' \t\r'), '^[A-Za-z0-9]')),
g AS (SELECT seq, file_ord, ecosystem, name, max_by(spec, ord) FILTER (sign = '+') AS new_spec, max_by(spec, ord) FILTER (sign = '-') AS old_spec, min(ord) FILTER (sign = '+') AS ord FROM k GROUP BY ALL),
c AS (SELECT * FROM g WHERE new_spec IS NOT NULL AND old_spec IS DISTINCT FROM new_spec)
""".replace("trim(body)", r"trim(body, E' \t\r')")


@R.query(f"WITH {_FILES}, {_DEPS} SELECT seq, ecosystem, name, old_spec, new_spec FROM c")
def dependency_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that each commit adds (no old specification) or changes, in all four kinds of manifest."""
    d = extract.dependency_changes(_changes(spark, sf_dir))
    new = d.select("seq", F.explode("new_deps").alias("x")).select("seq", "x.ecosystem", "x.name", F.lit(None).cast("string").alias("old_spec"), F.col("x.spec").alias("new_spec"))
    return new.unionByName(d.select("seq", F.explode("changed_deps").alias("x")).select("seq", "x.ecosystem", "x.name", "x.old_spec", "x.new_spec"))


@R.query(f"""WITH {_FILES}, {_COUNTS}, {_DEPS},
dn AS (SELECT seq, string_agg(ecosystem || ':' || name || ':' || new_spec, '|' ORDER BY file_ord, ord) FILTER (old_spec IS NULL) AS new_deps, string_agg(ecosystem || ':' || name || ':' || old_spec || '>' || new_spec, '|' ORDER BY file_ord, ord) FILTER (old_spec IS NOT NULL) AS changed_deps FROM c GROUP BY seq),
pt AS (SELECT seq, string_agg(CASE path WHEN 'web/package.json' THEN '.json' WHEN 'svc/go.mod' THEN '.mod' WHEN 'requirements.txt' THEN '.txt' WHEN 'src/app.py' THEN '.py' WHEN 'assets/logo.PNG' THEN '.PNG' END, '|' ORDER BY file_ord) AS filetypes,
  string_agg(CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END, '|' ORDER BY file_ord) AS top_dirs,
  string_agg(path || '=' || ['PE/EXE (Windows)', 'ELF (Linux)', 'Mach-O 32-bit'][(doc_id // 5) % 4 + 1], '|' ORDER BY file_ord) FILTER (is_new AND (doc_id // 5) % 4 < 3) AS binaries FROM f GROUP BY seq)
SELECT seq, total_loc, files_changed, coalesce(filetypes, '') AS filetypes, top_dirs, coalesce(new_deps, '') AS new_deps, coalesce(changed_deps, '') AS changed_deps, coalesce(binaries, '') AS binaries FROM m JOIN pt USING (seq) LEFT JOIN dn USING (seq)""")
def file_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the changed files of each commit give: lines, types, directories, dependencies, disguised binaries."""
    changes = _changes(spark, sf_dir)
    out = extract.line_counts(changes)
    for part in (extract.paths_of(changes), extract.dependency_changes(changes), extract.bundled_binaries(changes)):
        out = out.join(part, "seq", "left")
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "|"), F.lit("")).alias(c)
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return out.select(
        "seq", "total_loc", "files_changed", F.array_join("filetypes", "|").alias("filetypes"), F.array_join("top_dirs", "|").alias("top_dirs"),
        text("new_deps", lambda x: join(x["ecosystem"], ":", x["name"], ":", x["spec"])), text("changed_deps", lambda x: join(x["ecosystem"], ":", x["name"], ":", x["old_spec"], ">", x["new_spec"])),
        F.coalesce(F.array_join(F.transform("new_binary_files", lambda x: join(x["path"], "=", x["kind"])), "|"), F.lit("")).alias("binaries"),
    )


@R.query(rf"""WITH {COMMITS}, n AS (SELECT DISTINCT d.ecosystem AS ecosystem, d.name AS name FROM (SELECT unnest(new_deps) AS d FROM c)),
a AS (SELECT n.* FROM n ANTI JOIN popular USING (ecosystem, name)),
f AS (SELECT ecosystem, name, name AS form FROM popular UNION SELECT ecosystem, name, replace(name, '{HOSTS[0]}', '{HOSTS[1]}') FROM popular WHERE ecosystem = 'go' AND starts_with(name, '{HOSTS[0]}')
  UNION SELECT ecosystem, name, replace(name, '{HOSTS[1]}', '{HOSTS[0]}') FROM popular WHERE ecosystem = 'go' AND starts_with(name, '{HOSTS[1]}'))
SELECT a.ecosystem, a.name, min(f.name) AS match FROM a JOIN f ON a.ecosystem = f.ecosystem AND damerau_levenshtein(regexp_replace(a.name, '[^\x00-\x7F]', '~', 'g'), f.form) <= 1 GROUP BY ALL""")
def typosquat_one_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New dependencies one edit from a popular name, or from a Go name on the other host (word order and go/golang are tested apart)."""
    deps = _commits(spark, sf_dir, "new_deps").select(F.explode("new_deps").alias("d")).select("d.ecosystem", "d.name")
    return supply.typosquats(deps, table(spark, sf_dir, "popular"), HOSTS, ("own", "host"))


_FORMS = rf"""perm AS (SELECT ecosystem, name, []::VARCHAR[] AS used, string_split(name, '-') AS rest FROM popular WHERE contains(name, '-')
  UNION ALL SELECT ecosystem, name, list_append(used, rest[i]), list_concat(rest[1:i - 1], rest[i + 1:]) FROM (SELECT *, unnest(range(1, len(rest) + 1)) AS i FROM perm)),
gw AS (SELECT name, words, i, words[i] AS w FROM (SELECT name, string_split(name, '-') AS words, unnest(range(1, len(string_split(name, '-')) + 1)) AS i FROM popular WHERE ecosystem = 'go') WHERE contains(words[i], 'go')),
form AS (SELECT ecosystem, name, name AS form FROM popular UNION SELECT ecosystem, name, array_to_string(used, '-') FROM perm WHERE len(rest) = 0
  UNION SELECT 'go', name, replace(name, '{HOSTS[0]}', '{HOSTS[1]}') FROM popular WHERE ecosystem = 'go' AND starts_with(name, '{HOSTS[0]}') UNION SELECT 'go', name, replace(name, '{HOSTS[1]}', '{HOSTS[0]}') FROM popular WHERE ecosystem = 'go' AND starts_with(name, '{HOSTS[1]}')
  UNION SELECT 'go', name, array_to_string(list_concat(words[1:i - 1], [CASE WHEN contains(w, 'golang') THEN replace(w, 'golang', 'go') ELSE replace(w, 'go', 'golang') END], words[i + 1:]), '-') FROM gw
  UNION SELECT 'go', name, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), '-') FROM gw)"""
_SQUATS = r"""sq_n AS (SELECT sha, unnest(new_deps) AS d, generate_subscripts(new_deps, 1) AS ord FROM c), sq_a AS (SELECT DISTINCT d.ecosystem AS ecosystem, d.name AS name FROM sq_n), sq_o AS (SELECT sq_a.* FROM sq_a ANTI JOIN popular USING (ecosystem, name)),
sq_h AS (SELECT sq_o.ecosystem, sq_o.name, min(form.name) AS match FROM sq_o JOIN form ON sq_o.ecosystem = form.ecosystem AND damerau_levenshtein(regexp_replace(sq_o.name, '[^\x00-\x7F]', '~', 'g'), form.form) <= 1 GROUP BY ALL),
z AS (SELECT sha, min_by({'ecosystem': sq_h.ecosystem, 'name': sq_h.name, 'match': sq_h.match}, ord) AS h FROM sq_n JOIN sq_h ON sq_n.d.ecosystem = sq_h.ecosystem AND sq_n.d.name = sq_h.name GROUP BY sha)"""


@R.query(f"""WITH RECURSIVE {COMMITS}, {_FORMS}, {_SQUATS} SELECT sha, h.ecosystem AS ecosystem, h.name AS name, h.match AS match FROM z""")
def typosquats_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per commit: the first new dependency that resembles a popular name or one of its alternative forms."""
    commits = _commits(spark, sf_dir, "new_deps")
    return supply.first_typosquat(commits, table(spark, sf_dir, "popular"), HOSTS).select("sha", "typosquat.ecosystem", "typosquat.name", "typosquat.match")


_SQL_URL = r"(?i)^\s*(?:https?://|git\+|git://|ssh://|[\w.-]+/[\w.-]+#)"


@R.query(rf"""WITH {COMMITS}, w AS (SELECT sha, list_filter(changed_deps, lambda d: regexp_matches(d.new_spec, '{_SQL_URL}') AND NOT regexp_matches(d.old_spec, '{_SQL_URL}'))[1] AS a,
  list_filter(new_deps, lambda d: regexp_matches(d.spec, '{_SQL_URL}'))[1] AS b FROM c)
SELECT sha, CASE WHEN a IS NOT NULL THEN 'changed' ELSE 'new' END AS kind, coalesce(a.ecosystem, b.ecosystem) AS ecosystem, coalesce(a.name, b.name) AS name, coalesce(a.new_spec, b.spec) AS spec FROM w WHERE a IS NOT NULL OR b IS NOT NULL""")
def direct_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits whose dependencies point at a direct URL."""
    u = _commits(spark, sf_dir, "new_deps", "changed_deps").select("sha", supply.direct_url_change().alias("u")).where(F.col("u").isNotNull())
    return u.select("sha", "u.kind", "u.ecosystem", "u.name", "u.spec")


@R.query(f"""WITH {COMMITS}, d AS (SELECT sha, CASE WHEN contains(email, '@') THEN lower(regexp_extract(email, '.*@(.*)', 1)) ELSE '' END AS domain FROM c)
SELECT sha, domain, coalesce(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(creation_ts))) / 86400)::BIGINT, -1) AS age_days, coalesce(creation_ts IS NULL AND r.domain IS NOT NULL, false) AS unregistered FROM d LEFT JOIN domain_reg r USING (domain)""")
def domain_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age in days of each author's e-mail domain (-1: unknown); listed domains without a registration stand in for disposable ones."""
    c = _commits(spark, sf_dir, "email").select("sha", C.email_domain(F.col("email")).alias("domain"))
    j = c.join(table(spark, sf_dir, "domain_reg").withColumn("listed", F.lit(True)), "domain", "left")
    return j.select("sha", "domain", F.coalesce(supply.domain_age_days(F.col("creation_ts"), F.lit(AS_OF)), F.lit(-1)).alias("age_days"), (F.coalesce("listed", F.lit(False)) & F.col("creation_ts").isNull()).alias("unregistered"))


@R.query(rf"""WITH {COMMITS} SELECT sha, regexp_matches(trim(string_split(message, chr(10))[1], E' \t\r'), '^(?i:{C.GENERIC})\.?$') AS generic, contains(lower(email), '[bot]') AS bot FROM c""")
def message_and_bot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with a generic message; commits by bots."""
    return _commits(spark, sf_dir, "message", "email").select("sha", C.is_generic_message(F.col("message")).alias("generic"), is_bot(F.col("email")).alias("bot"))


@R.query(r"""SELECT doc_id, regexp_matches(text, '\braise\s+\w+Error\(') AND regexp_matches(text, '"\^\d+\.\d+\.\d+"') AS both_found,
  len(regexp_extract_all(text, '\braise\s+\w+Error\(')) AS n_raises, (regexp_matches(text, '"\^\d+\.\d+\.\d+"')::INT + contains(text, '+++ b/')::INT + regexp_matches(text, 'load_\w+\(')::INT) >= 2 AS two_of FROM documents WHERE text IS NOT NULL""")
def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of the rule language over documents: all, a count, two of three."""
    strings = {"a": Text(r"\braise\s+\w+Error\("), "b": Text(r'"\^\d+\.\d+\.\d+"'), "c": Text("+++ b/", "text"), "d": Text(r"load_\w+\(")}
    rule = Rule("r", [], strings)
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", truth(rule, ["all", "a", "b"], t, {}).alias("both_found"), number(rule, ["count", "a"], t).cast("long").alias("n_raises"), truth(rule, ["of", 2, "b", "c", "d"], t, {}).alias("two_of")
    )


@R.query(r"""WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text <> ''),
b AS (SELECT doc_id, t, regexp_matches(t, '\bsubprocess\.(?:run|call|Popen)\b|\bos\.system\s*\(|\bchild_process\b|\bexecSync\s*\(') AS spawns, regexp_matches(t, '\burllib\.request\b|\brequests\.get\s*\(|\bfetch\s*\(|\b(?:curl|wget)\s+-?') AS downloads,
  regexp_matches(t, '\bgetpass\.getuser\b')::INT + regexp_matches(t, '\bplatform\.node\b')::INT + regexp_matches(t, '\bsocket\.gethostname\b')::INT + regexp_matches(t, '\bos\.uname\b')::INT AS asks,
  regexp_matches(t, '"\^\d+\.\d+\.\d+"')::INT + contains(t, '+++ b/')::INT + regexp_matches(t, '^@@ -\d+')::INT AS pins, len(list_filter(string_split(t, '"')[2:-2], lambda x: regexp_full_match(x, '\s*\+\s*'))) AS glued FROM d),
r AS (SELECT doc_id, unnest([
  CASE WHEN downloads THEN {'rule_id': 'downloads', 'severity': 'medium'} END, CASE WHEN spawns AND downloads THEN {'rule_id': 'download_and_run', 'severity': 'high'} END,
  CASE WHEN regexp_matches(t, '\bshutil\.rmtree\s*\(|\bfs\.rmSync\s*\(|\brm\s+-rf\s') THEN {'rule_id': 'deletes_files', 'severity': 'low'} END,
  CASE WHEN contains(t, '.ssh/id_rsa') OR contains(t, '.aws/credentials') OR regexp_matches(t, '(?i)(?:secret|token)_?key') THEN {'rule_id': 'reads_secrets', 'severity': 'high'} END,
  CASE WHEN asks >= 2 THEN {'rule_id': 'enumerates_host', 'severity': 'medium'} END, CASE WHEN regexp_matches(t, '"(?:pre|post)install"\s*:\s*"[^"]+"') THEN {'rule_id': 'install_hook', 'severity': 'high'} END,
  CASE WHEN len(regexp_extract_all(t, '":\s*"https?://')) > len(regexp_extract_all(t, '":\s*"https?://registry\.')) + 1 THEN {'rule_id': 'many_http_specs', 'severity': 'high'} END,
  CASE WHEN len(regexp_extract_all(t, '\\x[0-9a-fA-F]{2}')) >= 20 THEN {'rule_id': 'hex_escapes', 'severity': 'medium'} END,
  CASE WHEN glued >= 20 OR regexp_matches(t, '\beval\s*\(') AND NOT regexp_matches(t, '\bast\.literal_eval\b') THEN {'rule_id': 'string_glue', 'severity': 'low'} END,
  CASE WHEN regexp_matches(t, '\p{Latin}\p{Cyrillic}|\p{Cyrillic}\p{Latin}|\p{Latin}\p{Greek}|\p{Greek}\p{Latin}') THEN {'rule_id': 'mixed_scripts', 'severity': 'medium'} END,
  CASE WHEN len(regexp_extract_all(t, '\braise\s+\w+Error\(')) >= 2 THEN {'rule_id': 'raises_errors', 'severity': 'low'} END, CASE WHEN pins >= 2 THEN {'rule_id': 'versions_pinned', 'severity': 'low'} END]) AS h FROM b)
SELECT doc_id, h.rule_id AS rule_id, h.severity AS severity FROM r WHERE h IS NOT NULL""")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the built-in rules in all documents: every rule, whatever paths it is for, over the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("path"), "text")
    hits = F.explode_outer("yara_hits").alias("h")  # no filter on the array is inferred, so the patterns run once
    rules = [replace(r, include=()) for r in BASIC]
    return scan(d, rules, max_bytes=None).select("doc_id", hits).where(F.col("h").isNotNull()).select("doc_id", "h.rule_id", "h.severity")


@R.query(f"""WITH {COMMITS}, y AS (SELECT sha, unnest(yara_hits) AS h FROM (SELECT sha, any_value(yara_hits) AS yara_hits FROM commits WHERE sha IS NOT NULL GROUP BY sha))
SELECT sha, h.path AS path, h.rule_id AS rule_id, regexp_matches(h.path, '\\.(py|js)$') AS code, list_has_any(string_split(lower(h.path), '/')[:-2], [{", ".join(repr(d) for d in EXCLUDED_DIRS)}]) AND contains(h.path, '/') AS excluded FROM y""")
def rule_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of recorded rule hits against path patterns and excluded directories."""
    h = _commits(spark, sf_dir, "yara_hits").select("sha", F.explode("yara_hits").alias("h")).select("sha", "h.path", "h.rule_id")
    return h.select("sha", "path", "rule_id", path_matches(F.col("path"), ["*.py", "*.js"]).alias("code"), path_excluded(F.col("path")).alias("excluded"))


@R.query(f"""WITH {COMMITS}, y AS (SELECT sha, unnest(yara_hits) AS h, generate_subscripts(yara_hits, 1) AS i FROM (SELECT sha, any_value(yara_hits) AS yara_hits FROM commits WHERE sha IS NOT NULL GROUP BY sha)),
s AS (SELECT *, CASE h.severity WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.5 END AS score FROM y)
SELECT sha, arg_max(h.rule_id, score * 1000000 - i) AS rule_id, max(score)::DOUBLE AS score, count(*) AS n_hits FROM s GROUP BY sha""")
def worst_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the most severe rule hits of each commit."""
    h = _commits(spark, sf_dir, "yara_hits").select("sha", F.posexplode("yara_hits").alias("i", "h"))
    k = F.struct(-S.severity_score(F.col("h.severity")), F.col("i"))
    return h.groupBy("sha").agg(F.min_by("h.rule_id", k).alias("rule_id"), F.max(S.severity_score(F.col("h.severity"))).alias("score"), F.count(F.lit(1)).alias("n_hits"))


@R.query(f"""WITH {COMMITS}, {LONG}, {_fits('repo')}, v AS (SELECT sha, metric, CASE WHEN x = 0 THEN 0 ELSE greatest(0, 1 - power(alpha / x, beta)) END AS j FROM u JOIN fit USING (repo, metric)),
z AS (SELECT sha, 1 - product(power(1 - j, 1 / 15.0)) AS score FROM v GROUP BY sha)
SELECT sha, round(score, 4) AS score FROM z""")
def size_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilistic OR of the seven size contributions of every commit, within its repository."""
    commits = _commits(spark, sf_dir, "repo", *profiles.METRICS)
    fits = profiles.wide_fits(profiles.tail_fits(profiles.metric_values(commits, ["repo"]), ["repo", "metric"]), ["repo"], "g")
    terms = [S.contribution(S.tail_rarity(F.col(m), F.col(f"{m}_alpha_g"), F.col(f"{m}_beta_g"))) for m in profiles.METRICS]
    return commits.join(fits, "repo").select("sha", F.round(S.prob_or(terms), 4).alias("score"))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = table(spark, sf_dir, "domain_reg")
    disposable = domains.where("creation_ts is null").select("domain")
    return detect(table(spark, sf_dir, "commits"), table(spark, sf_dir, "popular"), disposable, domains, AS_OF, hosts=HOSTS)


_SCORED = detect_sql(_FORMS, _SQUATS, _SQL_URL, str(AS_OF))


@R.query(_SCORED + "SELECT * EXCLUDE (top) REPLACE (coalesce(files_changed, -1) AS files_changed, coalesce(commit_msg_words, -1) AS commit_msg_words) FROM scored")
def detect_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, decision and reasons of the latest commits of every repository; the reasons as one text, as in the written results, unknown sizes as -1."""
    return files.flat(_detected(spark, sf_dir)).fillna(-1, ["files_changed", "commit_msg_words"])


@R.query(_SCORED + "SELECT repo, count(*) AS scored, count(*) FILTER (decision = 'Unusual') AS flagged FROM scored GROUP BY repo")
def detect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and flagged commits per repository."""
    return files.flagged_counts(_detected(spark, sf_dir))


@R.query(_SCORED + r""", f AS (SELECT * FROM scored WHERE decision = 'Unusual')
SELECT repo, repo || ': ' || count(*) || ' commits scored, ' || count(*) FILTER (decision = 'Unusual') || ' flagged Unusual' AS line FROM scored GROUP BY repo
UNION ALL SELECT repo, '  ' || sha || '  ' || email || repeat(' ', greatest(30 - length(email), 0)) || ' score=' || printf('%.3f', decision_val) FROM f
UNION ALL SELECT repo, '      - ' || r.t FROM (SELECT repo, unnest(top[1:3]) AS r FROM f)""")
def detect_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report: totals, flagged commits, their first three reasons."""
    return files.report_lines(_detected(spark, sf_dir))


@R.query("SELECT ecosystem, name FROM popular")
def package_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The popular packages written as one JSON list for each ecosystem, and read back from these."""
    out = scratch_path(spark, "packages")
    lists = table(spark, sf_dir, "popular").groupBy("ecosystem").agg(F.collect_list("name").alias("packages"))  # reference lists of some thousand names
    lists.write.partitionBy("ecosystem").json(out)
    return files.read_popular(spark, {r[0]: f"{out}/ecosystem={r[0]}" for r in lists.select("ecosystem").collect()})


@R.query("SELECT DISTINCT lower(regexp_extract(email, '.*@(.*)', 1)) AS domain FROM commits WHERE sha IS NOT NULL AND contains(email, '@') AND regexp_extract(email, '.*@(.*)', 1) <> ''")
def domain_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail domains of all authors written as a text file, in capitals and with comments, and read back as a list of domains."""
    out = scratch_path(spark, "domains")
    domains = table(spark, sf_dir, "commits").where("sha is not null").select(F.upper(C.email_domain(F.col("email"))).alias("d")).distinct().where("d <> ''")
    domains.select(F.explode(F.array(F.lit("# a comment"), F.lit(""), F.concat(F.lit("  "), "d", F.lit(" ")))).alias("value")).write.text(out)
    return files.read_domains(spark, out)


NOTATION = r"""
private rule added_file { strings: $a = "+++ b/" condition: $a }
rule signed { meta: description = "Signed off" severity = "low" strings: $a = "SIGNED off AFTER" nocase $b = /shrank\s+by\s+[0-9]{3,}?/i condition: any of them }
rule hunk_head { strings: $h = { 40 40 20 2D ?? [0-6] 2C } condition: $h }
rule latin_letters { strings: $a = /\xc3[\x80-\xbf]/ condition: $a }
rule go_or_rb { meta: severity = "high" strings: $a1 = /b\/[a-z]{2,12}?\/[a-z]{2,12}?\.go/ $a2 = /b\/[a-z]{2,12}?\/[a-z]{2,12}?\.rb/ $b = "def " condition: 2 of ($a*, $b) }
rule many_returns { strings: $r = "return " $d = /^-\s/ condition: #r + #d > 2 }
rule added_not_signed { condition: added_file and not signed }
"""


@R.query(r"""WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text <> ''),
b AS (SELECT doc_id, contains(t, '+++ b/') AS added, regexp_matches(t, '(?i)SIGNED off AFTER|shrank\s+by\s+[0-9]{3}') AS signed, regexp_matches(t, '(?s)@@ -..{0,6},') AS head, regexp_matches(t, '[\x{C0}-\x{FF}]') AS latin,
  regexp_matches(t, 'b/[a-z]{2,12}/[a-z]{2,12}\.go')::INT + regexp_matches(t, 'b/[a-z]{2,12}/[a-z]{2,12}\.rb')::INT + contains(t, 'def ')::INT AS two, len(regexp_extract_all(t, 'return ')) + regexp_matches(t, '^-\s')::INT AS returns FROM d),
r AS (SELECT doc_id, unnest([CASE WHEN signed THEN ['signed', 'Signed off', 'low'] END, CASE WHEN head THEN ['hunk_head', 'hunk_head', 'medium'] END, CASE WHEN latin THEN ['latin_letters', 'latin_letters', 'medium'] END,
  CASE WHEN two >= 2 THEN ['go_or_rb', 'go_or_rb', 'high'] END, CASE WHEN returns > 2 THEN ['many_returns', 'many_returns', 'medium'] END, CASE WHEN added AND NOT signed THEN ['added_not_signed', 'added_not_signed', 'medium'] END]) AS h FROM b)
SELECT doc_id, h[1] AS rule_id, h[2] AS description, h[3] AS severity FROM r WHERE h IS NOT NULL""")
def rule_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in all documents of rules read from the text notation: case, hexadecimal strings with gaps, classes of bytes, lazy and bounded repetition, n of some, counts, references."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("path"), "text")
    hits = scan(d, parse_rules(NOTATION), max_bytes=None).select("doc_id", F.explode_outer("yara_hits").alias("h")).where(F.col("h").isNotNull())
    return hits.select("doc_id", "h.rule_id", "h.description", "h.severity")


@R.query(f"""WITH {COMMITS}, {LONG}, {_fits('repo')}
SELECT sha, repo, email, total_loc, round(1 - power(alpha / total_loc, beta), 5) AS rarity FROM c JOIN fit USING (repo) WHERE metric = 'total_loc' AND total_loc <> 0 AND 1 - power(alpha / total_loc, beta) >= 0.9""")
def stream_tail_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits read as a stream, each delivery once, that lie in the tail of their repository's fitted size."""
    commits = table(spark, sf_dir, "commits")
    one = _commits(spark, sf_dir, "repo", "total_loc")
    fits = profiles.tail_fits(profiles.metric_values(one, ["repo"], ["total_loc"]), ["repo", "metric"])
    stream = scorer.read_stream(spark, f"{sf_dir}/commits.parquet", commits.schema).where("sha is not null").withColumn("ingested_ts", F.col("ingested_ts").cast("timestamp"))
    unique = scorer.first_deliveries(stream)
    out = scratch_path(spark, "alerts")
    alerts = scorer.tail_alerts(unique, fits, "total_loc", 0.9)
    alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).parquet(out).withColumn("rarity", F.round("rarity", 5))
