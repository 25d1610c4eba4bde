"""Mapping free-entered names to a reference list: BK-trees under an edit metric.

Decorations (case, look-alike letters, versions, extras, separators, affixes) are removed by rule, giving each typed
name a few plain forms. What is left are typing errors, found in a BK-tree over the forms of the reference entries.
The tree's metric is the Levenshtein distance, which obeys the triangle inequality; the faults counted are
insertions, deletions, substitutions and swaps of neighbours. As k faults are at most 2k
Levenshtein steps, a search of radius 2k finds every entry within k faults, and the
faults of the hits are then counted exactly.

The words of a name may also stand in another order. A second BK-tree holds the entries of several words by their letters
alone, under the distance of multisets (the larger of the two numbers of letters that one has beyond the other), a metric
that no order of words changes and that each fault changes by 1 at most. Its hits are verified over all orders of the words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gitsift.session import stage

# Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGIT_LETTERS = {"0": "o", "1": "l", "3": "e", "5": "s"}


@dataclass(frozen=True)
class Decorations:
    """What may be added to a name of one namespace (ecosystem) without changing what it names."""

    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()  # first path segments that stand for one another
    trailing: tuple[str, ...] = (r"\[[^\]]*\]", r"(?:[@~^<>=!]+|\s+)\s*v?\d[\w.*+-]*", r"\.git", r"/dist")


def fold(name: str) -> str:
    """Compatibility form, lower case, Latin letters for look-alikes, without invisible characters."""
    name = unicodedata.normalize("NFKC", name).casefold()
    name = "".join(LOOKALIKE.get(c, c) for c in name if unicodedata.category(c) != "Cf")
    return re.sub(r"(?<=[a-z])[0135]|[0135](?=[a-z])", lambda m: DIGIT_LETTERS[m[0]], name.strip())


def split(name: str, d: Decorations) -> tuple[str, list[str]]:
    """Path before the last segment (hosts made equal), and the words of the last segment."""
    *path, last = name.strip("/").split("/")
    if path and path[0] in d.hosts:
        path[0] = d.hosts[0]
    return "/".join(re.sub(r"[-_.\s]+", "", p) for p in path), [w for w in re.split(r"[-_.\s]+", last) if w]


def undecorated(name: str, d: Decorations) -> Iterator[str]:
    """The name, and it without what may trail it, as often as something does."""
    name = unicodedata.normalize("NFKC", name).strip()
    seen = {name}
    todo = [name]
    while todo:
        yield (now := todo.pop())
        for t in d.trailing:
            cut = re.sub(rf"(?<=.)(?:{t})\s*$", "", now, flags=re.I | re.S).strip()
            if cut and cut not in seen:
                seen.add(cut)
                todo.append(cut)


def forms_typed(name: str, d: Decorations) -> dict[str, int]:
    """Plain forms of a typed name and the number of affixes dropped for each."""
    out: dict[str, int] = {}
    for base in undecorated(name, d):
        path, words = split(fold(base), d)
        readings = [(words, 0)]
        if len(words) > 1 and words[0] in d.prefixes:
            readings.append((words[1:], 1))
        if len(words) > 1 and words[-1] in d.suffixes:
            readings.append((words[:-1], 1))
        for w, cost in readings:
            form = (path + "/" if path else "") + "".join(w)
            if w and out.get(form, 99) > cost:
                out[form] = cost
    return out


def forms_entry(name: str, d: Decorations) -> tuple[dict[str, int], str, tuple[str, ...]]:
    """Plain forms under which a reference entry can be found, with the cost of each, and its path and words for other orders of the words."""
    path, words = split(fold(name), d)
    lead = path + "/" if path else ""
    out = {lead + "".join(words): 0}
    if len(words) > 1 and words[-1] in d.suffixes:
        out.setdefault(lead + "".join(words[:-1]), 1)
    return out, lead, tuple(sorted(words))


# Least length of a form and the typing errors from there on: none below 3 letters, one below 5, else two.
FAULTS = ((3, 1), (5, 2))


def faults_allowed(length: int, faults: Sequence[tuple[int, int]] = FAULTS) -> int:
    """Typing errors taken for a spelling of an entry form of this length."""
    return max((n for least, n in faults if length >= least), default=0)


def _levenshtein(word: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distances of one word (codes) to many queries (rows of codes, 0 beyond their length)."""
    m = len(word)
    if m == 0:
        return lengths.copy()
    if m > 63:
        k = len(queries)
        return _faults(np.repeat(word[None], k, axis=0), np.full(k, m), queries, lengths, swaps=False)
    peq = np.zeros(max(int(queries.max(initial=0)), int(word.max())) + 1, dtype=np.uint64)
    for i, c in enumerate(word):
        peq[c] |= np.uint64(1 << i)
    n, one, top = len(queries), np.uint64(1), np.uint64(1 << (m - 1))
    pv, mv = np.full(n, (1 << m) - 1, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    score = np.full(n, m, dtype=np.int64)
    for j in range(int(lengths.max(initial=0))):  # bit-parallel over the word, one query letter at a time
        eq = peq[queries[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        live = j < lengths
        score += live & ((ph & top) != 0)
        score -= live & ((mh & top) != 0)
        ph = (ph << one) | one
        pv = (mh << one) | ~(xv | ph)
        mv = ph & xv
    return score


def _faults(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, swaps: bool = True) -> np.ndarray:
    """Edit distances of many pairs at once: rows of codes ``a`` and ``b`` with their lengths; swaps of neighbours count 1."""
    wa, wb, n = int(la.max(initial=0)), int(lb.max(initial=0)), len(la)
    pick = np.arange(n)
    row = np.repeat(np.arange(wb + 1)[:, None], n, axis=1)
    before = row
    out = np.where(la == 0, lb, 0)
    for i in range(wa):
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(wb):
            best = np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + (a[:, i] != b[:, j]))
            if swaps and i and j:
                hit = (a[:, i] == b[:, j - 1]) & (a[:, i - 1] == b[:, j])
                best = np.where(hit, np.minimum(best, before[j - 1] + 1), best)
            new[j + 1] = best
        before, row = row, new
        out = np.where(la == i + 1, row[lb, pick], out)
    return out


def _damerau(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, edits between the swapped letters included."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, c = last.get(b[j - 1], 0), col
            same = a[i - 1] == b[j - 1]
            if same:
                col = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][c] + (i - k - 1) + 1 + (j - c - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


def any_order_faults(typed: str, lead: str, words: Sequence[str], most: int) -> int | None:
    """Least faults between ``typed`` and ``lead`` followed by the words in any order; None if there are more than ``most``.

    The orders are tried word by word, as long as the table of distances, kept near its diagonal, leaves hope. States that are
    met again on another way are left out.
    """
    n, w = len(typed), most + 1  # one more than asked: see BKTree.within on swaps around another edit
    total = len(lead) + sum(map(len, words))
    if abs(total - n) > w:
        return None
    far = w + 1
    best: int | None = None

    def extend(state, word):
        before, row, last, i = state
        for c in word:
            i += 1
            new, left = [], far
            for k in range(2 * w + 1):
                j = i - w + k
                if j < 0 or j > n:
                    x = far
                elif j == 0:
                    x = i
                else:
                    x = row[k] + (c != typed[j - 1])
                    if k < 2 * w:
                        x = min(x, row[k + 1] + 1)
                    x = min(x, left + 1)
                    if j > 1 and last is not None and c == typed[j - 2] and last == typed[j - 1]:
                        x = min(x, before[k] + 1)
                    x = min(x, far)
                new.append(x)
                left = x
            before, row, last = row, tuple(new), c
            if min(row) > w and min(before) >= w:
                return None
        return before, row, last, i

    empty = tuple(abs(k - w) if k >= w else far for k in range(2 * w + 1))
    start = extend(((far,) * (2 * w + 1), empty, None, 0), lead)
    todo = [(start, tuple(sorted(words)), lead)] if start else []
    seen = set()
    while todo:
        state, rest, so_far = todo.pop()
        if not rest:
            faults = state[1][n - total + w]
            if faults == most + 1:
                faults = _damerau(so_far, typed)
            if faults <= most and (best is None or faults < best):
                best = faults
            continue
        for k, word in enumerate(rest):
            if k and rest[k - 1] == word:
                continue
            new, left = extend(state, word), rest[:k] + rest[k + 1 :]
            if new and (new, left) not in seen:
                seen.add((new, left))
                todo.append((new, left, so_far + word))
    return best


class BKTree:
    """BK-tree over words; children of a node by their distance to it. Searched for many queries at once.

    ``letters``: the distance is that of the multisets of letters, else Levenshtein's.
    """

    def __init__(self, words: Sequence[str], letters: bool = False, faults: Sequence[tuple[int, int]] = FAULTS) -> None:
        self.words = sorted(set(words))
        self.letters, self.faults = letters, faults
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for w in self.words for c in w}))}
        self.children: list[dict[int, int]] = [{} for _ in self.words]
        self.rows, self.lengths = self.encode(self.words)
        self.allowed = np.array([faults_allowed(x, faults) for x in self.lengths], dtype=np.int64)
        # built level by level: the words under a node are split by their distance to it
        todo = [(0, np.arange(1, len(self.words)))] if self.words else []
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            d = self._distance(node, self.rows[below], self.lengths[below])
            for k in np.unique(d):
                group = below[d == k]
                self.children[node][int(k)] = int(group[0])
                todo.append((int(group[0]), group[1:]))

    def encode(self, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of letter codes, or of the number of each letter, and the lengths of the names."""
        lengths = np.array([len(x) for x in names], dtype=np.int64)
        other = len(self.alphabet) + 1
        code = np.array([self.alphabet.get(c, other) for x in names for c in x], dtype=np.int64)
        row = np.repeat(np.arange(len(names)), lengths)
        if self.letters:
            return np.bincount(row * (other + 1) + code, minlength=len(names) * (other + 1)).reshape(len(names), other + 1).astype(np.int32), lengths
        out = np.zeros((len(names), int(lengths.max(initial=0))), dtype=np.int64)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code
        return out, lengths

    def _distance(self, node: int, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = self.lengths[node]
        if self.letters:
            beyond = np.maximum(rows - self.rows[node], 0).sum(axis=1)
            return np.maximum(beyond, beyond - lengths + n)
        return _levenshtein(self.rows[node, :n], rows, lengths)

    def near(self, rows: np.ndarray, lengths: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs whose distance is at most ``steps`` times the faults allowed of the node's word."""
        reach = steps * int(self.allowed.max(initial=0))
        pairs: list[tuple[np.ndarray, int]] = []
        todo = [(0, np.arange(len(rows)))] if self.words and len(rows) else []
        while todo:
            node, ask = todo.pop()
            d = self._distance(node, rows[ask], lengths[ask])
            hit = ask[d <= steps * self.allowed[node]]
            if len(hit):
                pairs.append((hit, node))
            for k, child in self.children[node].items():
                go = ask[np.abs(d - k) <= reach]
                if len(go):
                    todo.append((child, go))
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate([x for x, _ in pairs]), np.concatenate([np.full(len(x), node) for x, node in pairs])) if pairs else (none, none)

    def within(self, names: Sequence[str]) -> list[tuple[int, int, int]]:
        """All (query number, word number, faults) with at most faults_allowed(word length) faults; a tree of the Levenshtein distance."""
        queries, lengths = self.encode(names)
        q, w = self.near(queries, lengths, 2)
        hits: list[tuple[int, int, int]] = []
        for at in range(0, len(q), 20_000):
            qs, ws = q[at : at + 20_000], w[at : at + 20_000]
            f = _faults(self.rows[ws], self.lengths[ws], queries[qs], lengths[qs])
            for i in np.flatnonzero((f == self.allowed[ws] + 1) & (f > 2)):  # a swap around another edit: a fault less than in the table
                f[i] = _damerau(self.words[ws[i]], names[qs[i]])
            ok = f <= self.allowed[ws]
            hits += list(zip(qs[ok].tolist(), ws[ok].tolist(), f[ok].tolist()))
        return hits


class Shard:
    """Entries of one namespace, or a part of them, with their two trees."""

    def __init__(self, entries: Sequence[str], d: Decorations, faults: Sequence[tuple[int, int]]) -> None:
        self.d, self.faults = d, faults
        self.by_form: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.by_letters: dict[str, list[tuple[str, str, tuple[str, ...]]]] = defaultdict(list)
        for e in entries:
            forms, lead, words = forms_entry(e, d)
            for form, cost in forms.items():
                self.by_form[form].append((e, cost))
            if len(set(words)) > 1:
                self.by_letters["".join(sorted(lead + "".join(words)))].append((e, lead, words))
        self.tree = BKTree(list(self.by_form), faults=faults)
        self.letters = BKTree(list(self.by_letters), letters=True, faults=faults)

    def winners(self, names: Sequence[str]) -> dict[str, tuple[int, int, bytes, str]]:
        """Per typed name that stands for an entry: (faults, cost, entry as bytes, entry), the least of all."""
        typed: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for n in names:
            for form, cost in forms_typed(n, self.d).items():
                typed[form].append((n, cost))
        asked, best = list(typed), {}

        def offer(form: str, entry: str, faults: int, cost: int) -> None:
            for n, c in typed[form]:
                rank = (faults, c + cost, entry.encode(), entry)
                if n not in best or rank < best[n]:
                    best[n] = rank

        for q, w, f in self.tree.within(asked):
            for e, cost in self.by_form[self.tree.words[w]]:
                offer(asked[q], e, f, cost)
        for q, w in zip(*(x.tolist() for x in self.letters.near(*self.letters.encode(asked), 1))):
            most = int(self.letters.allowed[w])
            for e, lead, words in self.by_letters[self.letters.words[w]]:
                f = any_order_faults(asked[q], lead, words, most)
                if f is not None:
                    offer(asked[q], e, f, 1)
        return best


def map_names(
    typed: DataFrame,
    reference: DataFrame,
    decorations: dict[str, Decorations] | None = None,
    faults: Sequence[tuple[int, int]] = FAULTS,
    shard_entries: int = 20_000,
    names_a_group: int = 400,
    most_groups: int = 4096,
) -> DataFrame:
    """For each distinct (``space``, ``name``) of ``typed``: the reference entry it is a spelling of.

    ``reference`` has the columns ``space`` and ``name``; both frames' other columns are not read. ``decorations``: what may be added
    to names, by space; ``faults``: (least length, typing errors allowed from there on).
    Result: ``space``, ``name``, ``entry`` (null: unmatched), ``faults`` (typing errors), ``cost``
    (affixes or word order changed). A name that is itself an entry maps to itself
    with 0 and 0. Of several entries within reach the winner has the fewest faults, then the least cost,
    then the first name by bytes; entries that tie are so resolved the same way each time. Empty names
    and names of only separators are unmatched; rows with a null name or space are left
    out; an empty reference leaves every name unmatched. The words of a name may stand in any order, however many they are.

    The reference is cut into shards of about ``shard_entries`` entries, and the distinct names of a namespace into groups of about
    ``names_a_group`` (larger ones, if there were more than ``most_groups`` of a namespace); each group meets each shard of its namespace. A task
    builds the trees of a shard once for a group and streams the group's names through them, so it holds a shard and one batch of names.
    The number of tasks follows the number of groups, not the bytes. The winners of the shards are merged at the end.
    """
    decorations = decorations or {}
    known = F.col("name").isNotNull() & F.col("space").isNotNull()
    names, entries = (df.select("space", "name").where(known).distinct() for df in (typed, reference))
    exact = names.join(entries, ["space", "name"], "left_semi").select("space", "name", F.col("name").alias("entry"), F.lit(0).alias("faults"), F.lit(0).alias("cost"))
    rest = stage(names.join(entries, ["space", "name"], "left_anti"), "names")
    size = lambda df, name: df.groupBy("space").agg(F.count(F.lit(1)).alias(name))
    shards = F.ceil(F.col("n_entries") / shard_entries)
    groups = F.least(F.ceil(F.col("n_names") / names_a_group), F.greatest(F.lit(1), F.floor(F.lit(most_groups) / shards)))
    cuts = size(entries, "n_entries").join(size(rest, "n_names"), "space").select("space", shards.cast("int").alias("shards"), groups.cast("int").alias("groups"))
    upto = F.sum(F.col("shards") * F.col("groups")).over(W.orderBy("space"))  # over the namespaces
    cuts = stage(cuts.select("*", (upto - F.col("shards") * F.col("groups")).alias("first")), "name-groups")
    total = cuts.agg(F.sum(F.col("shards") * F.col("groups"))).first()[0] or 1
    part = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = (F.col("first") + F.col("shard") * F.col("groups") + F.col("group")).cast("int").alias("cell")
    e = entries.join(cuts, "space").select("*", part("shards").alias("shard"), each("groups").alias("group")).select(cell, F.lit(0).alias("kind"), "space", "name")
    n = rest.join(cuts, "space").select("*", part("groups").alias("group"), each("shards").alias("shard")).select(cell, F.lit(1).alias("kind"), "space", "name")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_now, shard = None, None
        entries_now: list[str] = []
        asked: list[str] = []
        space_now = None

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if asked and entries_now:
                shard = shard or Shard(entries_now, decorations.get(space_now, Decorations()), faults)
                rows = [(space_now, k, v[3], v[0], v[1]) for k, v in shard.winners(asked).items()]
                if rows:
                    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["space", "name", "entry", "faults", "cost"])
            asked.clear()

        for batch in batches:
            for c, kind, space, name in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if c != cell_now:
                    yield from found()
                    cell_now, shard, entries_now, space_now = c, None, [], space
                (asked if kind else entries_now).append(name)
                if len(asked) == 2_000:
                    yield from found()
        yield from found()

    cells = e.unionByName(n).repartitionById(int(min(total, most_groups)), F.pmod("cell", F.lit(int(min(total, most_groups))))).sortWithinPartitions("cell", "kind", "name")
    found = cells.mapInArrow(search, "space string, name string, entry string, faults int, cost int").groupBy("space", "name").agg(F.min(F.struct("faults", "cost", "entry")).alias("w"))
    mapped = rest.join(found, ["space", "name"], "left").select("space", "name", "w.entry", "w.faults", "w.cost")
    return mapped.unionByName(exact)
