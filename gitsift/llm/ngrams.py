"""Counts of all n-grams over a collection of records, by a suffix array with common-prefix intervals.

Every token position starts a suffix that goes on to the end of its record; terms are written as 64-bit codes, so that
suffixes are short strings of bytes, whose order is as good as any. Within a record the suffixes are sorted, and the common prefix of neighbours says for which lengths a suffix repeats an n-gram that its
record has already: those are the duplicates to subtract when records are counted. Equal
suffixes are combined before the shuffle. The rest is range-partitioned and
sorted: each partition holds a stretch of the suffix array, and a scan over
the common prefixes of neighbours closes the intervals, one per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX_TOKENS = 2_000_000  # tokens of suffixes passed on at a time


def _combine(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct rows of an integer matrix: the first place of each, its count, and each row's number among them."""
    packed, room = np.zeros(len(rows), dtype=np.int64), 1
    for col in rows.T:
        col = col - col.min()
        size = int(col.max()) + 1
        if room * size >= 2**62:
            values, packed = np.unique(packed, return_inverse=True)
            room = len(values)
        packed, room = packed * size + col, room * size
    _, first, number, n = np.unique(packed, return_index=True, return_inverse=True, return_counts=True)
    return first, n, number


class Ranks:
    """Order of the prefixes of 1, 2, 4, ... tokens at every position, by doubling; past the end of a record stands 0."""

    def __init__(self, code: np.ndarray, left: np.ndarray, longest: int) -> None:
        """``code``: tokens as numbers from 1 on, record after record; ``left``: tokens from each position to the end of its record."""
        self.left, self.levels, width = left, [code], 1
        while 2 * width <= longest:
            self.levels.append(self._pairs(self.levels[-1], width, width))
            width *= 2

    def _pairs(self, rank: np.ndarray, step: int, width: int) -> np.ndarray:
        ahead = np.zeros(len(rank), dtype=np.int64)
        inside = np.flatnonzero(self.left > step)
        ahead[inside] = rank[inside + step]
        return np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1] + 1

    def prefixes(self, n: int) -> np.ndarray:
        """Numbers that are equal where the first ``n`` tokens are (or all to the end), and in their order."""
        k = min(n.bit_length() - 1, len(self.levels) - 1)
        width = 1 << k
        return self.levels[k] if n == width else self._pairs(self.levels[k], n - width, width)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of tokens that the suffixes at positions a and b have in common."""
        out = np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for k in reversed(range(len(self.levels))):
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                go = np.flatnonzero(out + (1 << k) <= most)
                go = go[self.levels[k][a[go] + out[go]] == self.levels[k][b[go] + out[go]]]
                out[go] += 1 << k
        return out


WIDTH = 8  # bytes of a term's code


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of ``lengths`` codes each, one after the other in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(lengths * WIDTH)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of ``lengths`` each."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _key_codes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices.fill_null(-1), dtype=np.int64)


def _key_values(dictionary: pa.Array, codes: np.ndarray) -> pa.Array:
    return dictionary.take(pa.array(np.maximum(codes, 0), mask=codes < 0))


def _suffixes(max_n: int | None, keys: list[str]):
    """mapInArrow function: arrays of codes in, (keys, suffix, dup, n) out, combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(batch.num_columns - 1)
            if batch.num_rows == 0 or len(tokens.flatten()) == 0:
                continue
            flat, rec = tokens.flatten().to_numpy(), np.asarray(pc.list_parent_indices(tokens), dtype=np.int64)
            code = np.unique(flat, return_inverse=True)[1] + 1
            size = len(code)
            left = np.searchsorted(rec, rec, side="right") - np.arange(size)
            most = min(max_n or size, int(left.max()))
            ranks = Ranks(code, left, most)
            whole = ranks.prefixes(most)
            srt = np.lexsort((whole, rec))
            # common prefix with the suffix sorted before it in the same record
            dup = np.zeros(size, dtype=np.int64)
            if size > 1:
                again = np.flatnonzero(rec[srt[1:]] == rec[srt[:-1]]) + 1
                dup[srt[again]] = np.minimum(ranks.common(srt[again], srt[again - 1]), most)
            coded = [_key_codes(batch.column(i)) for i in range(len(keys))]
            kc = [c[rec] for _, c in coded]
            first, n, _ = _combine(np.column_stack([*kc, whole, dup]))
            lengths = np.minimum(left[first], most)
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // SUFFIX_TOKENS)) + 1
            for part in np.split(np.arange(len(first)), cuts):
                at, many = first[part], lengths[part]
                out = [_key_values(d, c[at]) for (d, _), c in zip(coded, kc)]
                suffix = _binaries(flat[_ragged(at, many)].astype(">i8"), many)
                yield pa.RecordBatch.from_arrays([*out, suffix, pa.array(dup[at].astype(np.int32)), pa.array(n[part].astype(np.int64))], names=[*keys, "suffix", "dup", "n"])

    return run


def _intervals(keys: list[str], shortest: int, longest: int | None, min_tf: int):
    """mapInArrow function over sorted (keys, suffix, dup, n): one row per interval (n-gram) in a batch of the suffix array.

    Of the suffix there are n occurrences whose first ``dup`` tokens repeat within their record. At depth d the intervals are the runs
    of neighbours that share d tokens. N-grams of fewer than ``min_tf`` occurrences are left
    out, except at the two ends of the batch, where the next one may have more of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            suffix = batch.column(len(keys))
            offsets = np.frombuffer(suffix.buffers()[1], dtype=np.int32)[suffix.offset : suffix.offset + rows + 1].astype(np.int64) // WIDTH
            codes = np.frombuffer(suffix.buffers()[2], dtype=">i8")
            dup, n = (batch.column(len(keys) + k).to_numpy() for k in (1, 2))
            first, lengths = offsets[:-1], np.diff(offsets)
            coded = [_key_codes(batch.column(i)) for i in range(len(keys))]
            # tokens shared with the suffix before
            lcp = np.zeros(rows, dtype=np.int64)
            same = np.ones(rows - 1, dtype=bool)
            for _, c in coded:
                same &= c[1:] == c[:-1]
            live, most, d = np.flatnonzero(same) + 1, np.minimum(lengths[1:], lengths[:-1]), 0
            while len(live):
                live = live[most[live - 1] > d]
                live = live[codes[first[live] + d] == codes[first[live - 1] + d]]
                lcp[live] = d = d + 1
            for d in range(shortest, min(int(lengths.max()), longest or rows * 10**6) + 1):
                deep = np.flatnonzero(lengths >= d)
                begins = np.flatnonzero((lcp[deep] < d) | (np.diff(deep, prepend=-1) != 1))
                tf = np.add.reduceat(n[deep], begins)
                df = np.add.reduceat(np.where(dup[deep] < d, n[deep], 0), begins)
                at = deep[begins]
                last = deep[np.append(begins[1:], len(deep)) - 1]
                kept = np.flatnonzero((tf >= min_tf) | (at == 0) | (last == rows - 1))
                if not len(kept):
                    continue
                at = at[kept]
                out = [_key_values(dic, c[at]) for dic, c in coded]
                grams = _binaries(codes[_ragged(first[at], np.full(len(at), d))], np.full(len(at), d))
                yield pa.RecordBatch.from_arrays([*out, grams, pa.array(tf[kept]), pa.array(df[kept])], names=[*keys, "gram", "tf", "df"])

    return run


def ngram_counts(records: DataFrame, tokens: str, max_n: int | None = None, keys: list[str] | None = None, shortest: int = 1, longest: int | None = None, min_tf: int = 1) -> DataFrame:
    """Occurrences ``tf`` and records ``df`` of every n-gram, of any length that a record has.

    ``records`` has one row per record; ``tokens`` is an array of strings in record
    order. ``keys`` are string columns by which collections are counted apart. Columns: the
    keys, ``ngram`` (array), ``tf``, ``df``. Returned are n-grams of ``shortest`` to ``longest`` tokens that occur at least ``min_tf``
    times. Null tokens are dropped and the tokens
    around them count as neighbours; records with a null or empty array have no n-grams; an empty
    table gives an empty result. No other n-gram is left out, however rare or frequent.

    The suffixes of a record go to its end and so hold half the square of its tokens; where records are long, ``max_n`` cuts
    them to the longest n-grams that are wanted. Terms are told apart by 64-bit hashes (two of ten million terms share one with a
    probability of 3 in a million) and written out again at the end.

    A frequent suffix is combined in each map task, so it reaches the range
    partition as one row. An interval cut by the border of a partition or batch comes out in parts,
    which the last aggregation adds.
    """
    keys = list(keys or [])
    names = ", ".join(f"{k} string" for k in keys) + (", " if keys else "")
    rows = records.select(*keys, F.filter(F.col(tokens), lambda t: t.isNotNull()).alias("_tokens"))
    codes = rows.select(*keys, F.transform("_tokens", lambda t: F.xxhash64(t)).alias("codes"))
    suffixes = codes.mapInArrow(_suffixes(max_n, keys), f"{names}suffix binary, dup int, n bigint")
    # equal suffixes meet in the range partition; those of one task are one row for each depth of repetition
    stretch = suffixes.groupBy(*keys, "suffix", "dup").agg(F.sum("n").alias("n")).repartitionByRange(*keys, "suffix").sortWithinPartitions(*keys, "suffix")
    parts = stretch.select(*keys, "suffix", "dup", "n").mapInArrow(_intervals(keys, shortest, longest, min_tf), f"{names}gram binary, tf bigint, df bigint")
    grams = parts.groupBy(*keys, "gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    if min_tf > 1:
        grams = grams.where(F.col("tf") >= min_tf)
    code = F.unhex(F.lpad(F.hex(F.xxhash64("term")), 2 * WIDTH, "0"))
    terms = rows.select(F.explode("_tokens").alias("term")).distinct().select(code.alias("code"), "term")
    if longest == 1:
        return grams.join(terms, F.col("gram") == F.col("code")).select(*keys, F.array("term").alias("ngram"), "tf", "df")
    piece = F.expr(f"substring(gram, {WIDTH} * place + 1, {WIDTH})")
    spelled = grams.select("*", F.explode(F.expr(f"sequence(0, octet_length(gram) div {WIDTH} - 1)")).alias("place")).withColumn("code", piece).join(terms, "code")
    ngram = F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
    return spelled.groupBy(*keys, "gram").agg(ngram.alias("ngram"), F.first("tf").alias("tf"), F.first("df").alias("df")).select(*keys, "ngram", "tf", "df")


def mark_terms(counts: DataFrame, n_records: DataFrame, rare_at_most: int, common_num: int, common_den: int) -> DataFrame:
    """Add ``mark``: ``rare``, ``common`` or null. ``n_records`` is a one-row frame with the number of records.

    Common wins where both hold (only in collections of a few records).
    """
    total = n_records.scalar()
    return counts.withColumn(
        "mark",
        F.when(F.col("df") * common_den >= total * common_num, "common").when(F.col("df") <= rare_at_most, "rare"),
    )
