"""Checks of dependencies and identities against reference lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitsift.functions import commits as C

GO_HOSTS = ("github.com/", "gitlab.com/")
KINDS = ("own", "host", "word", "order")  # forms of a popular name that others are confused with


def popular_forms(popular: DataFrame, hosts: tuple[str, str] = GO_HOSTS, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(ecosystem, name, form): each entry under the forms of it that can be written out: its own, and for Go those on the other
    host, and with one word that holds go or golang changed to the other or left out. Other orders of its words are not written out."""
    name, words = F.col("name"), F.split("name", "-", -1)
    forms = [F.array(name)] if "own" in kinds else []
    go = []
    if "host" in kinds:
        for a, b in (hosts, hosts[::-1]):
            go.append(F.when(name.startswith(a), F.array(F.concat(F.lit(b), F.substring(name, F.lit(len(a) + 1), F.length(name))))).otherwise(F.array().cast("array<string>")))
    if "word" in kinds:
        w = lambda i: F.get(words, i)
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: w(i).contains("go"))
        before, after = (lambda i: F.slice(words, 1, i)), (lambda i: F.slice(words, i + 2, F.size(words)))
        other = lambda i: F.when(w(i).contains("golang"), F.replace(w(i), F.lit("golang"), F.lit("go"))).otherwise(F.replace(w(i), F.lit("go"), F.lit("golang")))
        go.append(F.transform(places, lambda i: F.array_join(F.concat(before(i), F.array(other(i)), after(i)), "-")))
        go.append(F.transform(places, lambda i: F.array_join(F.concat(before(i), after(i)), "-")))
    if go:
        forms.append(F.when(F.col("ecosystem") == "go", F.concat(*go)).otherwise(F.array().cast("array<string>")))
    rows = popular.select("ecosystem", "name").where("ecosystem is not null and name is not null").distinct()
    return rows.select("ecosystem", "name", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *forms))).alias("form"))


def _shortened(name: Column) -> Column:
    """The name and every name with one character less."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), cut))


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    same = F.length(a) == F.length(b)
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return (F.levenshtein(a, b) <= 1) | (same & F.exists(places, lambda i: swapped(i) == b))


def _letters(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name, "")), "")


def one_edit_any_order(a: Column, b: Column) -> Column:
    """Whether ``a`` is at most one edit from ``b`` with its hyphen words in some order.

    An edit touches one word, or two at the hyphen between them. So a stretch of one or two words of ``a`` is compared with the
    one or two words of ``b`` that remain when the other words of ``a`` are taken out of it.
    """
    words, theirs = F.split(a, "-", -1), F.split(b, "-", -1)

    def taken(left: Column, word: Column) -> Column:
        at = F.array_position(left, word).cast("int")
        return F.when(at > 0, F.concat(F.slice(left, F.lit(1), at - 1), F.slice(left, at + 1, F.size(left))))

    def meets(i: Column, n: int) -> Column:
        rest = F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + n + 1, F.size(words)))
        remains = F.aggregate(rest, theirs, taken)
        own = F.array_join(F.slice(words, i + 1, n), "-")
        near = one_edit(own, F.array_join(remains, "-")) | one_edit(own, F.array_join(F.reverse(remains), "-"))
        return F.coalesce(F.size(remains).isin(1, 2) & near, F.lit(False))

    place = lambda n: F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.exists(place(1), lambda i: meets(i, 1)) | F.exists(place(2), lambda i: meets(i, 2))


def typosquats(names: DataFrame, popular: DataFrame, hosts: tuple[str, str] = GO_HOSTS, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(ecosystem, name, match): names that are no entry but one edit from one, or from an alternative form; the first match by bytes.

    Instead of comparing all names with all entries, both are joined on what they have in
    common when one edit apart: the name itself or the name short of one character. A swap of neighbours
    shares such a shortened form too. For other orders of the words of an entry (any number of words), both are joined in the same
    way on their letters in order. Null names have no match. ``kinds``: the forms that count.
    """
    asked = names.select("ecosystem", "name").where("ecosystem is not null and name is not null").distinct()
    asked = asked.join(popular.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_anti")
    left = asked.select("ecosystem", "name", F.explode(_shortened(F.col("name"))).alias("key"))
    right = popular_forms(popular, hosts, kinds).select("ecosystem", F.col("name").alias("match"), "form", F.explode(_shortened(F.col("form"))).alias("key"))
    hits = left.join(right, ["ecosystem", "key"]).where(one_edit(F.col("name"), F.col("form"))).select("ecosystem", "name", "match")
    if "order" in kinds:
        many = popular.select("ecosystem", F.col("name").alias("match")).where(F.col("match").contains("-") & F.col("ecosystem").isNotNull()).distinct()
        key = lambda c: F.explode(_shortened(_letters(F.col(c)))).alias("key")
        met = asked.select("ecosystem", "name", key("name")).join(many.select("ecosystem", "match", key("match")), ["ecosystem", "key"]).select("ecosystem", "name", "match").distinct()
        hits = hits.unionByName(met.where(one_edit_any_order(F.col("name"), F.col("match"))))
    return hits.groupBy("ecosystem", "name").agg(F.min("match").alias("match"))


def first_typosquat(commits: DataFrame, popular: DataFrame, hosts: tuple[str, str] = GO_HOSTS) -> DataFrame:
    """Per ``sha``: the first new dependency, in order, that resembles a popular name: ecosystem, name, match."""
    deps = commits.select("sha", F.posexplode("new_deps").alias("ord", "d")).select("sha", "ord", "d.ecosystem", "d.name")
    found = deps.join(typosquats(deps, popular, hosts), ["ecosystem", "name"])
    return found.groupBy("sha").agg(F.min_by(F.struct("ecosystem", "name", "match"), "ord").alias("typosquat"))


def direct_url_change() -> Column:
    """First changed dependency that went to a direct URL, else the first new one that is one: (kind, ecosystem, name, old_spec, spec), or null."""
    none = F.lit(None).cast("string")
    went = F.filter("changed_deps", lambda d: C.is_direct_url(d["new_spec"]) & ~C.is_direct_url(d["old_spec"]))
    new = F.filter("new_deps", lambda d: C.is_direct_url(d["spec"]))
    row = lambda kind, d, old, spec: F.struct(F.lit(kind).alias("kind"), d["ecosystem"].alias("ecosystem"), d["name"].alias("name"), old.alias("old_spec"), spec.alias("spec"))
    a, b = F.get(went, 0), F.get(new, 0)
    return F.when(a.isNotNull(), row("changed", a, a["old_spec"], a["new_spec"])).when(b.isNotNull(), row("new", b, none, b["spec"]))


def domain_age_days(creation: Column, as_of: Column) -> Column:
    """Whole days from the registration to ``as_of``; null for an unknown registration."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(creation)) / 86400)
