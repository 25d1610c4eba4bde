"""Mixing sources to target shares of tokens, by entropy balancing.

The copies of a document are to be as close to one as can be (in relative entropy) while each
source gets its share of the tokens. The solution tilts the rates of documents exponentially by
their length, rate = exp(lambda_source * tokens), up to the most repeats allowed; the multipliers solve
the convex dual, by Newton steps whose sums Spark computes over all lengths and sources. The
rates are then rounded to whole copies so that each source's total stays within about one document.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gitsift.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(``id``, ``source``, ``n_tokens``) of every document; null and empty texts have 0 tokens.

    ``tokenizer``: path, on every executor, of a vocabulary in tiktoken's rank format. Special-token strings count as ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, type=pa.int64())], names=["id", "source", "n_tokens"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, source string, n_tokens long")


@dataclass
class Source:
    """State of the dual of one source. ``rate(t) = min(cap, exp(tilt * t / mean))``."""

    cap: float
    tokens: int
    mean: float
    target: float
    tilt: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False

    def step(self, value: float, slope: float) -> None:
        """One Newton step on value(tilt) = target, kept inside the bracket that the values seen so far give."""
        if abs(value - self.target) <= max(0.5, 1e-9 * self.target):
            self.done = True
            return
        if value < self.target:
            self.low = self.tilt
        else:
            self.high = self.tilt
        new = self.tilt + (self.target - value) / slope if slope > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low):
                new = min(-1.0, 2 * self.high)
            elif math.isinf(self.high):
                new = max(1.0, 2 * self.low)
            else:
                new = (self.low + self.high) / 2
        if new == self.tilt:
            self.done = True
        self.tilt = new


def _rate(sources: dict[str, Source]):
    """Column of the rate of a document, from its ``source`` and ``n_tokens``."""
    one = lambda v: F.create_map(*[F.lit(x) for k, s in sources.items() for x in (k, float(v(s)))])[F.col("source")]
    tilt = F.exp(one(lambda s: s.tilt) * F.col("n_tokens") / one(lambda s: s.mean))
    full = one(lambda s: s.target >= s.cap * s.tokens * (1 - 1e-12)) > 0
    return F.when(full, one(lambda s: s.cap)).otherwise(F.least(tilt, one(lambda s: s.cap))), one


def balance(cells: DataFrame, targets: DataFrame, total_tokens: int | None, max_steps: int = 100) -> dict[str, Source]:
    """Multipliers of all sources. ``cells``: source, n_tokens, n (documents of this source and length).

    What comes to the driver is one row per listed source and step. Multipliers that do not settle within ``max_steps`` are an error.
    """
    wanted = {r["source"]: r for r in targets.collect() if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    have = cells.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("n")).collect()
    if not have:
        return {}
    share = sum(wanted[r["source"]]["target_share"] for r in have)
    sources = {r["source"]: Source(float(wanted[r["source"]]["max_repeats"]), r["tokens"], r["tokens"] / r["n"], wanted[r["source"]]["target_share"] / share) for r in have}
    most = min(s.cap * s.tokens / s.target for s in sources.values())
    total = min(most, total_tokens) if total_tokens else most
    for s in sources.values():
        s.target = min(s.target * total, s.cap * s.tokens)
        s.done = s.target >= s.cap * s.tokens * (1 - 1e-12)
    for _ in range(max_steps):
        todo = [k for k, s in sources.items() if not s.done]
        if not todo:
            break
        rate, one = _rate(sources)
        rows = cells.where(F.col("source").isin(todo)).select("source", "n_tokens", "n", rate.alias("rate"), one(lambda s: s.cap).alias("cap"), one(lambda s: s.mean).alias("mean"))
        mass = F.col("n") * F.col("rate") * F.col("n_tokens")
        sums = rows.groupBy("source").agg(F.sum(mass).alias("value"), F.sum(F.when(F.col("rate") < F.col("cap"), mass * F.col("n_tokens") / F.col("mean")).otherwise(0.0)).alias("slope"))
        for r in sums.collect():
            sources[r["source"]].step(r["value"], r["slope"])
    if left := [k for k, s in sources.items() if not s.done]:
        raise RuntimeError(f"no multiplier found in {max_steps} steps for {left}")
    return sources


def sums_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of equal ``keys`` that come earlier by ``order`` (together with the keys unique).

    Taken level by level: over the totals of the first column of ``order``, and inside each of its values by the rest.
    """
    if len(order) == 1:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    level = [*keys, order[0]]
    totals = sums_before(rows.groupBy(*level).agg(F.sum(value).alias(value)), keys, order[:1], value).select(*level, F.col("before").alias("_lead"))
    inside = sums_before(rows, level, order[1:], value)
    return inside.join(totals, level).withColumn("before", F.col("before") + F.col("_lead")).drop("_lead")


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, rows_a_group: int = 50_000, most_cut: int = 100_000) -> DataFrame:
    """Copies of each document: ``id``, ``source``, ``n_tokens``, ``rate``, ``copies`` (0 included) for documents of listed sources.

    ``counts``: from :func:`token_counts`, best stored, as it is read several times. ``targets``: ``source``,
    ``target_share``, ``max_repeats``. Listed sources without tokens are left out and the shares of the others
    scaled up to sum 1; documents of sources that are null, not listed, or listed with share or repeats of 0 (or null)
    are not used, nor are documents without tokens. ``total_tokens`` is the wished size; by default, and at most, the largest at which
    no source exceeds its repeats. Nothing to mix gives an empty result.

    Rounding: documents are put in order of source and length; copies are given where the running sum of the
    fractional rates, in decimals, passes a half-integer. The sum runs over (source, length, slice) cells, level by level: over bands of
    lengths (some hundreds a source), over the lengths of a band, over the slices of a length. A length that more than
    ``rows_a_group`` documents of a source share (more than that, if there were over ``most_cut`` such lengths) is cut into slices by a hash of the ids, so no task holds them all;
    the list of these lengths, at most ``most_cut`` rows, is all that is broadcast.
    """
    used = counts.where(F.col("n_tokens") > 0)
    cells = stage(used.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = balance(cells, targets, total_tokens)
    if not sources:
        return counts.limit(0).withColumns({"rate": F.lit(0.0), "copies": F.lit(0).cast("long")})
    mine = F.col("source").isin(list(sources))
    rate, _ = _rate(sources)
    documents = cells.where(mine).agg(F.sum("n")).first()[0]
    most = max(rows_a_group, -(-documents // most_cut))
    cut = cells.where(mine & (F.col("n") > most)).select("source", "n_tokens", F.ceil(F.col("n") / most).alias("slices"))  # documents / most rows at most
    slice_ = F.pmod(F.xxhash64("id"), F.coalesce("slices", F.lit(1))).alias("slice")
    docs = used.where(mine).join(F.broadcast(cut), ["source", "n_tokens"], "left").select("id", "source", "n_tokens", slice_, F.xxhash64("id", F.lit(1)).alias("_h"))
    whole = F.floor(rate)
    mass = F.col("n").cast("decimal(15,0)") * (rate - whole).cast("decimal(13,12)")
    band = F.floor(F.log2("n_tokens") * 16).alias("band")
    cell = docs.groupBy("source", "n_tokens", "slice").agg(F.count(F.lit(1)).alias("n")).select("source", band, "n_tokens", "slice", rate.alias("rate"), whole.alias("whole"), mass.alias("mass"))
    cell = sums_before(cell, ["source"], ["band", "n_tokens", "slice"], "mass")
    half = F.lit(0.5).cast("decimal(2,1)")
    extra = F.floor(F.col("before") + F.col("mass") + half) - F.floor(F.col("before") + half)
    cell = cell.select("source", "n_tokens", "slice", "rate", "whole", extra.cast("long").alias("extra"))
    rank = F.row_number().over(W.partitionBy("source", "n_tokens", "slice").orderBy("_h", "id"))
    return docs.join(cell, ["source", "n_tokens", "slice"]).select("id", "source", "n_tokens", "rate", (F.col("whole") + (rank <= F.col("extra")).cast("long")).alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: ``target_share``, ``max_repeats``, and of the mixture ``documents``, ``copies``, ``most_copies``, ``tokens``, ``actual_share``."""
    sums = mixed.groupBy("source").agg(
        F.count_if(F.col("copies") > 0).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    total = sums.agg(F.sum("tokens")).scalar()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.join(sums, "source", "left").select(
        "source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("most_copies"), zero("tokens"), (F.coalesce("tokens", F.lit(0)) / total).alias("actual_share")
    )
