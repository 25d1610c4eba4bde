"""Test items that stand in documents, fully or partly: size-partitioned MinHash containment search.

Items are partitioned by their size, so that within a partition one block length and one number of hash
functions fit. Documents are cut into blocks of that length; two neighbouring blocks form a window that holds
the shingles which any passage leaves intact at one place. The containment that is left there gives, through the sizes, the
Jaccard similarity that window and item have at least, and this the number of hash functions for the wanted recall.
Windows with too few shingles of any item at all (a bitmap of fixed size tells) are skipped; of the others the minima become
keyed rows, as do those of the items, and a join of both gives the candidates. These are verified: first by the exact
number of shared shingles, then by aligning item and text word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitsift.session import stage

SHINGLE = 5
STEP, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVISIBLE = "[­​-‍﻿]"
MARKUP = r"(?s)<!--.*?-->|</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>"
ENTITY = r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,8});"
TEXT_BYTES = 32_000_000  # of texts cleaned at a time


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters or digits, lower case) of texts without tags and entities, and each text's offset in them."""
    t = pc.replace_substring_regex(pc.utf8_lower(texts), INVISIBLE, "")
    t = pc.replace_substring_regex(t, MARKUP, " ")
    t = pc.replace_substring_regex(t, ENTITY, " ")
    lists = pc.split_pattern_regex(t, r"[^\pL\pN]+")
    flat = lists.flatten()
    counts = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    real = np.asarray(pc.greater(pc.utf8_length(coded.dictionary), 0), dtype=bool)[code] if len(code) else np.empty(0, dtype=bool)
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    return hashes[code[real]], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word hashes, offsets) of the rows (id, text) of a batch, in parts of about TEXT_BYTES."""
    size = np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64)
    part = np.cumsum(size) // TEXT_BYTES
    for first, past in zip(*(np.flatnonzero(np.diff(part, **{edge: -1})) for edge in ("prepend", "append"))):
        rows = batch.slice(first, past + 1 - first)
        yield rows.column(0).to_numpy(zero_copy_only=False), *words(rows.column(1).cast(pa.large_string()))


@dataclass(frozen=True)
class Tolerance:
    """A passage of an item counts from ``least`` words (or the whole item, if shorter), with one word in ``per_edit`` changed, added or missing (0: none)."""

    least: int = 20
    per_edit: int = 10

    @property
    def longest(self) -> int:
        """Every passage within the tolerance holds one of at most so many words that is within it too: a longer one can be cut
        at a multiple of ``per_edit`` into two of at least ``least`` words, and not both parts can have more than their edits."""
        return 2 * -(-self.least // self.per_edit) * self.per_edit - 1 if self.per_edit else self.least

    def lengths(self, n: int) -> range:
        return range(min(n, self.least), min(n, self.longest) + 1)

    def edits(self, length: int) -> int:
        return length // self.per_edit if self.per_edit else 0

    def shared(self, n: int) -> int:
        """Shingles that a passage of an n-word item keeps at least: its edits cut it into edits + 1 runs."""
        return max(1, min(k - self.edits(k) - (SHINGLE - 1) * (self.edits(k) + 1) for k in self.lengths(n)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    return h ^ (h >> np.uint64(29))


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * STEP + w[i : i + n]
    return _mixed(h)


def holds(item: np.ndarray, text: np.ndarray, tol: Tolerance) -> bool:
    """Whether some passage of the item aligns with a stretch of the text within the tolerance (exact)."""
    n, m = len(item), len(text)
    least = min(n, tol.least)
    starts = n - least + 1
    ramp = np.arange(m + 1)
    cost = np.zeros((starts, m + 1), dtype=np.int32)
    unlike = (item[:, None] != text[None, :]).astype(np.int32)
    for k in range(1, tol.lengths(n).stop):  # k words of the item from each start, ending anywhere in the text
        live = min(starts, n - k + 1)
        cost = cost[:live]
        step = np.empty_like(cost)
        step[:, 0] = k
        step[:, 1:] = np.minimum(cost[:, :-1] + unlike[k - 1 : k - 1 + live], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
        if k >= least and (cost <= tol.edits(k)).any():
            return True
    return False


class SizeClass:
    """Items of ``low`` to ``high`` words: what their passages keep, and the MinHash that finds it. Depends on the sizes only, not on any item."""

    def __init__(self, low: int, high: int | None, tol: Tolerance, recall: float) -> None:
        self.low, self.tol = low, tol
        self.size = min(SHINGLE, low)
        # a passage holds one of the next lower of these lengths, with as many edits allowed
        long = [high] if high else [k for k in range(tol.least, tol.longest + 1) if k == tol.least or tol.edits(k) > tol.edits(k - 1)]
        shortest = high or tol.least  # the passage that a window must hold whole
        self.block = shortest + tol.edits(shortest) - self.size + 1
        if low < SHINGLE:
            self.need = 1
        elif high:
            self.need = min(tol.shared(n) for n in range(low, high + 1))
        else:
            # the intact shingles of a longer passage lie in so many stretches of a block's length, one of which has its share
            share = lambda k: -(-max(0, k - tol.edits(k) - (SHINGLE - 1) * (tol.edits(k) + 1)) // -(-(k + tol.edits(k) - SHINGLE + 1) // self.block))
            self.need = max(1, min(share(k) for k in long))
        self.margin = max(long) + tol.edits(max(long))
        self.item_block = self.block + tol.edits(max(long))  # missing words make an item's stretch longer than the document's
        most = 2 * self.item_block if not high else high - self.size + 1
        jaccard = self.need / (2 * self.block + most - self.need)
        self.n_hashes = math.ceil(math.log(1 - recall) / math.log(1 - jaccard))
        rng = np.random.Generator(np.random.PCG64(low))
        self.factors = rng.integers(0, 2**63, self.n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 2**63, self.n_hashes, dtype=np.uint64)
        self.salt = np.uint64(low)

    def marks(self, s: np.ndarray) -> np.ndarray:
        """Hashes of shingles that tell the classes apart."""
        return _mixed(s + self.salt * STEP)

    def keys(self, s: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """One key for each hash function (columns) of the sets s[first:past]: its minimum, mixed with the function's number."""
        width = int((past - first).max())
        at = first[:, None] + np.minimum(np.arange(width), (past - first)[:, None] - 1)
        own = s[at]
        return np.stack([_mixed((own * f).min(axis=1) + salt) for f, salt in zip(self.factors, self.salts)], axis=1)

    def item_sets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the sets of an item of ``n`` shingles: all, or stretches of two blocks, each from a block's start."""
        starts = np.arange(0, max(1, n - self.item_block), self.item_block)
        return starts, np.minimum(starts + 2 * self.item_block, n)


def size_classes(tol: Tolerance, recall: float, ratio: float = 1.25) -> list[SizeClass]:
    """The partitions by size: single sizes below SHINGLE words, then sizes that differ by ``ratio`` at most, and all from ``least`` words on."""
    out, low = [], 1
    while low < tol.least:
        high = low if low < SHINGLE else min(int(low * ratio), tol.least - 1)
        out.append(SizeClass(low, high, tol, recall))
        low = high + 1
    return [*out, SizeClass(tol.least, None, tol, recall)]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _item_rows(tol: Tolerance, recall: float):
    """(id, text) -> item, class, words, marks of its shingles, keys of its sets"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(tol, recall)
        for batch in batches:
            for ids, flat, offsets in _slices(batch):
                rows = []
                for i, a, b in zip(ids, offsets[:-1], offsets[1:]):
                    if a == b:
                        continue
                    k = max(k for k, c in enumerate(classes) if c.low <= b - a)
                    c, w = classes[k], flat[a:b]
                    s = shingles(w, c.size)
                    rows.append((int(i), k, w, np.unique(c.marks(s)), np.unique(c.keys(s, *c.item_sets(len(s))))))
                if rows:
                    item, k, *lists = zip(*rows)
                    cols = [_lists(np.concatenate(x), np.array([len(v) for v in x])) for x in lists]
                    yield pa.RecordBatch.from_arrays([pa.array(item, type=pa.int64()), pa.array(k, type=pa.int32()), *cols], names=["item", "cls", "words", "marks", "keys"])

    return run


def _window_rows(tol: Tolerance, recall: float, present: list[int], bitmap):
    """(id, text) -> doc, class, place, words around, keys of the windows that have enough shingles of items. ``bitmap``: broadcast bits of the items' marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(tol, recall)
        bits = bitmap.value
        top = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            for ids, flat, offsets in _slices(batch):
                for k in present:
                    c = classes[k]
                    n = np.maximum(0, np.diff(offsets) - c.size + 1)  # shingles of each text
                    rows = np.flatnonzero(n)
                    if not len(rows):
                        continue
                    s = shingles(flat, c.size)
                    at = c.marks(s) & top
                    hit = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                    sums = np.concatenate([[0], np.cumsum(hit.astype(np.int64))])
                    blocks = -(-n[rows] // c.block)
                    row = np.repeat(rows, blocks)
                    first = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * c.block
                    past = np.minimum(first + 2 * c.block, offsets[row] + n[row])
                    kept = np.flatnonzero(sums[past] - sums[first] >= c.need)
                    for part in np.array_split(kept, -(-len(kept) // 2000)) if len(kept) else ():
                        row_, first_, past_ = row[part], first[part], past[part]
                        keys = c.keys(s, first_, past_)
                        low = np.maximum(offsets[row_], first_ - c.margin)
                        high = np.minimum(offsets[row_ + 1], past_ + c.size - 1 + c.margin)
                        around = np.concatenate([flat[a:b] for a, b in zip(low, high)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[row_], type=pa.int64()), pa.array(np.full(len(part), k, dtype=np.int32)), pa.array(first_ - offsets[row_]), _lists(around, high - low), _lists(keys.ravel(), np.full(len(part), c.n_hashes))],
                            names=["doc", "cls", "at", "around", "keys"],
                        )

    return run


def verified(item: np.ndarray, text: np.ndarray, c: SizeClass) -> bool:
    """Exact containment of the item's shingles in the text around a window, then word by word."""
    own, there = shingles(item, c.size), shingles(text, c.size)
    at = np.flatnonzero(np.isin(own, there))
    if len(at) < c.need:
        return False
    least = min(len(item), c.tol.least) - c.size + 1
    if len(at) >= least:  # a verbatim passage: least shingles in a row at one offset
        order = np.argsort(there, kind="stable")
        low, high = (np.searchsorted(there[order], own[at], side=x) for x in ("left", "right"))
        if (high - low == 1).all():
            off = order[low] - at
            run = np.flatnonzero((np.diff(at) != 1) | (np.diff(off) != 0)) + 1
            if np.diff(np.concatenate([[0], run, [len(at)]])).max() >= least:
                return True
    return holds(item, text, c.tol)


def _verified_rows(tol: Tolerance, recall: float):
    """(doc, item, class, words of the item, words around) sorted by doc and item -> pairs, each once"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(tol, recall)
        done = None
        for batch in batches:
            out = []
            parts = [(np.asarray(batch.column(k).offsets), np.asarray(batch.column(k).values).view(np.uint64)) for k in (3, 4)]
            for r, (doc, item, k) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(3)))):
                if (doc, item) == done:
                    continue
                w, text = (flat[offsets[r] : offsets[r + 1]] for offsets, flat in parts)
                if verified(w, text, classes[k]):
                    done = doc, item
                    out.append(done)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], names=["doc", "item"])

    return run


def _bits(items: DataFrame, most_bits: int, bits_a_mark: int = 1024) -> np.ndarray:
    """Bitmap of the items' marks, of a power of two of bits, at most ``most_bits``; made by Spark, read as rows of 64 bits."""
    n = items.agg(F.sum(F.size("marks"))).first()[0] or 0
    size = 1 << max(6, min(n * bits_a_mark, most_bits).bit_length() - 1)
    at = items.select(F.explode("marks").alias("m")).select(F.col("m").bitwiseAND(F.lit(size - 1)).alias("at"))
    word = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))")
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(word.alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, tol: Tolerance = Tolerance(), recall: float = 0.999, most_bits: int = 1 << 27
) -> DataFrame:
    """Pairs (``doc``, ``item``): the document holds a passage of the item within the tolerance. Each pair once.

    ``recall``: the least probability that a pair at the very edge of the tolerance is found; a verbatim passage shares many more
    shingles and is missed far more rarely. All pairs returned are true ones.
    Null ids, null texts and texts without a word take no part. Items of fewer than SHINGLE words are sought as
    one run of words. Several rows of one id give their pairs once. Extra columns are not read. No documents or no items: no rows.

    The documents are read once. Nothing that grows with the items or the documents goes to the driver or into a task's closure: of the
    items only a bitmap of at most ``most_bits`` bits (16 MB) is sent to all tasks. With very many items it fills up and keeps more windows; the result stays
    the same. Items and windows meet in a shuffled join on their keys.
    """
    plain = lambda df, i, t: df.select(F.col(i).cast("long").alias("id"), F.col(t).alias("text")).where("id is not null and text is not null")
    held = stage(plain(items, item_id, item_text).mapInArrow(_item_rows(tol, recall), "item long, cls int, words array<long>, marks array<long>, keys array<long>"), "leak-items")
    present = sorted(r[0] for r in held.select("cls").distinct().collect())  # a few size classes
    bitmap = docs.sparkSession.sparkContext.broadcast(_bits(held, most_bits))
    windows = plain(docs, doc_id, text).mapInArrow(_window_rows(tol, recall, present, bitmap), "doc long, cls int, at long, around array<long>, keys array<long>")
    windows = stage(windows, "leak-windows")
    asked = windows.select("doc", "cls", "at", F.explode("keys").alias("key"))
    met = asked.join(held.select("item", F.explode("keys").alias("key")).distinct(), "key").groupBy("doc", "cls", "at", "item").agg(F.count(F.lit(1)).alias("n"))
    pairs = met.join(windows.drop("keys"), ["doc", "cls", "at"]).join(held.select("item", "cls", "words"), ["item", "cls"])
    # windows of a pair in order of their shared keys, so that the best is tried first and the others rarely
    pairs = pairs.repartition("doc", "item").sortWithinPartitions("doc", "item", F.desc("n"))
    return pairs.select("doc", "item", "cls", "words", "around").mapInArrow(_verified_rows(tol, recall), "doc long, item long")
