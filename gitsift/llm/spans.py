"""Long exact spans shared between records: prefix-partitioned sparse suffix trees.

Of every text only those suffixes are kept that start at an anchor: a position whose
hash of the next K characters is least in some window of W consecutive positions. Equal
texts have equal anchors, so any span of L characters that two records share has an anchor
among its first W positions, and the suffixes of both records at this anchor agree for at least
L - W + 1 characters. Suffixes are partitioned by this much of their beginning (as a
fingerprint); a suffix whose beginning occurs in one record only cannot be shared and is dropped
before any text moves. What remains is cut to the W - 1 characters before and the L after the
anchor, sorted, and each partition's suffix tree is read off the common prefixes of
neighbours: a node of depth d, whose suffixes also agree in the L - d characters to
the left, is a repeat of at least L characters. Comparisons are of the texts themselves.

The prefixes have variable lengths: a partition with too many suffixes is split by more characters, until its parts fit or
agree in L characters and so are one node. A shared span may go on to the right or to the left of the anchor, so it is
split in two: the suffixes that agree in half of what is missing to the right, and those that agree in the rest of it to the left.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from gitsift.session import stage

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CHUNK = 500_000  # characters hashed at a time


@dataclass(frozen=True)
class Lengths:
    """min_length L; W = L // 2 anchor window; R = L - W + 1 characters that agree right of an anchor; K for the hash."""

    min_length: int

    @property
    def window(self) -> int:
        return max(1, self.min_length // 2)

    @property
    def right(self) -> int:
        return self.min_length - self.window + 1

    @property
    def gram(self) -> int:
        return min(16, self.right)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every window of w values: by running extremes from both ends of blocks of w."""
    op, pad = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % w, pad, dtype=np.uint64)]).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """Anchors and the fingerprints of the characters that follow them."""

    def __init__(self, lengths: Lengths) -> None:
        self.l = lengths
        size = 2 * CHUNK + 4 * lengths.min_length
        self.powers = np.concatenate([[np.uint64(1)], np.full(size, STEP, dtype=np.uint64)])
        self.powers = np.multiply.accumulate(self.powers)
        inverse = pow(int(STEP), -1, 2**64)
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(inverse), dtype=np.uint64)]))

    def _grams(self, c: np.ndarray) -> np.ndarray:
        """Hash of the next ``gram`` characters at every position, from hashes of 1, 2, 4, ... characters."""
        out, size, part, have = None, 0, c, 1
        left = self.l.gram
        while left:
            if left & have:
                out = part if out is None else out[: len(c) - size - have + 1] * self.powers[have] + part[size : len(c) - have + 1]
                size += have
                left -= have
            if left:
                part = part[: len(c) - 2 * have + 1] * self.powers[have] + part[have:]
                have *= 2
        return out

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and fingerprints of the anchors in one stretch of text."""
        l = self.l
        n = len(codes)
        if n < l.min_length:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        c = _scrambled(codes * STEP + MIX)
        h = self._grams(c)
        h = _scrambled(h)
        w = min(l.window, len(h))
        least = _sliding(h, w, least=True)
        edge = np.zeros(w - 1, dtype=np.uint64)
        highest = _sliding(np.concatenate([edge, least, edge]), w, least=False)
        at = np.flatnonzero(h == highest)
        at = at[at + l.right <= n]
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(c * self.powers[:n])])
        return at, _scrambled((sums[at + l.right] - sums[at]) * self.inverse[at])


def _anchor_rows(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(Lengths(min_length))

        def row(ids: list, at: list, fp: list) -> pa.RecordBatch:
            n = [len(x) for x in at]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.repeat(np.array(ids, dtype=np.int64), n)), pa.array(np.concatenate(at).astype(np.int32))], names=["fp", "id", "pos"]
            )

        for batch in batches:
            ids, ats, fps = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = _codes(text)
                for start in range(0, max(1, len(codes) - min_length + 1), CHUNK):  # very long texts: overlapping stretches
                    at, fp = anchors.of(codes[start : start + CHUNK + 2 * min_length])
                    ids.append(i)
                    ats.append(at + start)
                    fps.append(fp)
            if ids:
                yield row(ids, ats, fps)

    return run


SEGMENTS = 4000  # rows that a task holds before it passes them on


def _segment_rows(min_length: int):
    """(id, text, anchors) -> one row per anchor with the text around it."""
    before = Lengths(min_length).window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        out: list[tuple] = []

        def passed_on() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["key", "n", "id", "pos", "left", "right"])
            out.clear()
            return rows

        for batch in batches:
            lists = batch.column(2)
            offsets, places = lists.offsets.to_numpy(), lists.values
            fp, n, pos = (places.field(k).to_numpy() for k in ("fp", "n", "pos"))
            for r in range(batch.num_rows):  # one text at a time
                i, text = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                for k in range(offsets[r], offsets[r + 1]):
                    p = int(pos[k])
                    out.append((int(fp[k]), int(n[k]), i, p, text[max(0, p - before) : p], text[p : p + min_length]))
                    if len(out) == SEGMENTS:
                        yield passed_on()
        if out:
            yield passed_on()

    return run


def _lcp(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def deep_nodes(rights: list[str]) -> Iterator[tuple[int, int, int]]:
    """Internal nodes (depth, first, past) of the tree over sorted suffixes; equal suffixes are a node of their whole length."""
    open_: list[tuple[int, int]] = []
    for i in range(1, len(rights) + 1):
        d = _lcp(rights[i - 1], rights[i]) if i < len(rights) else -1
        first = i - 1
        while open_ and open_[-1][0] > d:
            depth, first = open_.pop()
            yield depth, first, i
        if d >= 0 and (not open_ or open_[-1][0] < d):
            open_.append((d, first))


def repeats(group: list[tuple[int, int, str, str]], min_length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Classes of (id, start, end): places of one partition that share at least min_length characters.

    ``group``: (id, pos, left, right) of suffixes sorted by ``right``. Start and end are those of the longest match
    with another record in the class, as far as the cut text shows it.
    """
    for depth, first, past in deep_nodes([g[3] for g in group]):
        need = min_length - depth
        by_left: dict[str, list[tuple[int, int, str, str]]] = defaultdict(list)
        for g in group[first:past]:
            if len(g[2]) >= need:
                by_left[g[2][len(g[2]) - need :]].append(g)
        for members in by_left.values():
            if len({m[0] for m in members}) < 2:
                continue
            members.sort(key=lambda m: m[2][::-1])
            back = [m[2][::-1] for m in members]
            ext = [0] * len(members)
            for step in (1, -1):  # nearest neighbour of another record on either side
                order = range(len(members)) if step == 1 else range(len(members) - 1, -1, -1)
                reach, prev = 0, None  # common left of this run with the last place of another record
                for k in order:
                    if prev is not None:
                        shared = _lcp(back[prev], back[k])
                        reach = shared if members[prev][0] != members[k][0] else min(reach, shared)
                        ext[k] = max(ext[k], reach)
                    prev = k
            yield [(m[0], m[1] - e, m[1] + depth) for m, e in zip(members, ext)]


def _class_rows(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, group = None, []

        def classes() -> list[tuple[str, int, int, int]]:
            out = []
            if len(group) > 1:
                for places in repeats(group, min_length):
                    ids = sorted({p[0] for p in places})
                    name = hashlib.md5(np.array(ids, dtype=np.int64).tobytes()).hexdigest()
                    out += [(name, *p) for p in places]
            return out

        def batch_of(rows: list) -> pa.RecordBatch:
            c, i, s, e = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(i, type=pa.int64()), pa.array(s, type=pa.int32()), pa.array(e, type=pa.int32())], names=["class", "id", "start", "end"])

        for batch in batches:
            rows: list[tuple[str, int, int, int]] = []
            for f, *g in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if f != fp:
                    rows += classes()
                    fp, group = f, []
                group.append(tuple(g))
            if rows:
                yield batch_of(rows)
        if rows := classes():
            yield batch_of(rows)

    return run


LEAVES = 20  # missing characters from which on the last splits are made at once


def _split(many: DataFrame, min_length: int) -> DataFrame:
    """Parts of over-full partitions: suffixes that agree in ``r`` characters to the right and ``l`` to the left of the anchor go to the part of
    those that agree in half of the missing characters more to the right, and to the part of those that agree in the others to the left."""
    missing = F.lit(min_length) - F.col("r") - F.col("l")
    more = F.ceil(missing / 2).cast("int")
    one = F.struct((F.col("r") + more).alias("r"), F.col("l").alias("l"))
    other = F.struct(F.col("r").alias("r"), (F.col("l") + missing - more + 1).alias("l"))
    rows = many.select("id", "pos", "left", "right", F.explode(F.array(one, other)).alias("x")).select("id", "pos", "left", "right", "x.r", "x.l")
    rows = rows.where((F.length("right") >= F.col("r")) & (F.length("left") >= F.col("l")))
    # the length of the left part makes the key of two strings unambiguous
    key = F.xxhash64("r", "l", F.substring(F.col("right"), F.lit(1), F.col("r")), F.expr("right(`left`, l)"))
    rows = rows.withColumn("key", key)
    sizes = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("key", "n")
    return rows.join(sizes, "key")


def shared_places(docs: DataFrame, id: str, text: str, min_length: int = 300, max_group: int = 4000) -> DataFrame:
    """Places of texts that occur word for word in another record, as classes of places.

    Columns: ``class`` (its records all share one span of at least ``min_length`` characters), ``id``,
    ``start``, ``end`` (0-based, end excluded, in code points: the stretch that the record shares with another of the class). Every pair of
    different records with a common substring of ``min_length`` characters meets in some class, and only such pairs do; the stretches of a
    record cover all that it shares.
    Places of one record only are no class. Null, empty and shorter texts have no places; rows
    with a null ``id`` are left out; equal texts under several ids share as any others; ``id`` should be unique (rows of one id are
    taken for one record, their places mixed). Other columns are not read.

    No task gets a partition of more than ``max_group`` suffixes: it is split by longer prefixes first, round by round. Suffixes that agree in all
    ``min_length`` characters are one node, a class without a tree, however many there are; its stretches are of just ``min_length`` characters.
    """
    l = Lengths(min_length)
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_length))
    anchors = stage(texts.mapInArrow(_anchor_rows(min_length), "fp long, id long, pos int"), "anchors")
    repeated = anchors.groupBy("fp").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    kept = anchors.join(repeated.select("fp", "n"), "fp")
    by_doc = kept.groupBy("id").agg(F.collect_set(F.struct("fp", "pos", "n")).alias("anchors"))  # of one text, a row itself, and a fraction of its size
    segments = texts.join(by_doc, "id").mapInArrow(_segment_rows(min_length), "key long, n long, id long, pos int, left string, right string")
    open_ = stage(segments, "segments").withColumns({"r": F.lit(l.right), "l": F.lit(0)})
    missing, few = min_length - l.right, [open_.where(F.col("n") <= max_group)]
    many = open_.where(F.col("n") > max_group)
    full = not many.isEmpty()
    while full and missing > LEAVES:
        open_ = stage(_split(many, min_length), "split-segments")
        missing //= 2
        few.append(open_.where(F.col("n") <= max_group))
        many = open_.where(F.col("n") > max_group)
        full = not many.isEmpty()
    trees = reduce(DataFrame.unionByName, few).select("key", "id", "pos", "left", "right").repartition("key").sortWithinPartitions("key", "right")
    classes = trees.mapInArrow(_class_rows(min_length), "class string, id long, start int, end int")
    if not full:
        return classes
    # the last splits at once: each part is named by the min_length characters that its suffixes agree in
    r = F.explode(F.sequence(F.col("r"), F.lit(min_length) - F.col("l")))
    nodes = many.select("id", "pos", "left", "right", r.alias("r")).where((F.length("right") >= F.col("r")) & (F.length("left") >= F.lit(min_length) - F.col("r")))
    span = F.concat(F.expr(f"right(`left`, {min_length} - r)"), F.substring(F.col("right"), F.lit(1), F.col("r")))
    nodes = nodes.select(F.md5(F.encode(span, "utf-8")).alias("class"), "id", (F.col("pos") + F.col("r") - min_length).alias("start")).distinct()
    common = nodes.groupBy("class").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("class")
    return classes.unionByName(nodes.join(common, "class").select("class", "id", "start", (F.col("start") + min_length).alias("end")))


def class_members(places: DataFrame) -> DataFrame:
    """(``class``, ``id``, ``n``): records of each class once, with the number of records in it.

    A long shared span gives a class at each of its anchors, with the same records; of classes that agree in number, sum and
    exclusive or of their records' hashes (128 bits) one is kept. Linear in the places: no pairs are made.
    """
    members = places.select("class", "id").distinct()
    h = F.xxhash64("id")
    alike = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"))
    return members.join(alike.groupBy("n", "s", "x").agg(F.min("class").alias("class")).select("class", "n"), "class")


def sharing_pairs(places: DataFrame) -> DataFrame:
    """Pairs ``id_a`` < ``id_b`` of records in one class, each once. The number of pairs is the size of the result asked for;
    :func:`class_members` gives the same links without them."""
    members = class_members(places)
    other = members.select("class", F.col("id").alias("id_b"))
    return members.withColumnRenamed("id", "id_a").join(other, "class").where("id_a < id_b").select("id_a", "id_b").distinct()


def shared_portion(docs: DataFrame, id: str, text: str, places: DataFrame) -> DataFrame:
    """One row per record: ``n_chars``, ``shared_chars`` (characters in stretches shared with other records), ``portion``.

    Null and empty texts have 0 of 0 characters and portion 0.
    """
    w = Win.partitionBy("id").orderBy("start", "end").rowsBetween(Win.unboundedPreceding, -1)  # of one text's places
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    shared = places.select("id", "start", "end").distinct().select("id", fresh.alias("fresh")).groupBy("id").agg(F.sum("fresh").alias("shared_chars"))
    base = docs.select(F.col(id).alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    s = F.coalesce("shared_chars", F.lit(0))
    return base.join(shared, "id", "left").select(F.col("id").alias(id), "n_chars", s.alias("shared_chars"), F.when(F.col("n_chars") > 0, s / F.col("n_chars")).otherwise(0.0).alias("portion"))
