"""Queries over the documents: shared spans, leaked test items, mixtures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitsift.llm.leaks import Tolerance, leaked_items
from gitsift.llm.mixture import mix, shares, token_counts
from gitsift.llm.queries import R
from gitsift.llm.spans import class_members, shared_places, shared_portion, sharing_pairs
from gitsift.session import stage, table

MIN_SPAN = 300

# Every window of 300 characters as a row of its own: fit for the small tables that SQL is run on.
_WINDOWS = """WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, i, substring(text, i, 300) AS s FROM d), m AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1), x AS (SELECT w.doc_id, w.i, w.s FROM w JOIN m USING (s))"""


@R.query(_WINDOWS + """ SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id""")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common substring of at least 300 characters."""
    pairs = sharing_pairs(shared_places(table(spark, sf_dir, "documents"), "doc_id", "text", MIN_SPAN))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


@R.query()
def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and class of documents that share a span: the others of the class. The scalable form of the pairs."""
    members = class_members(shared_places(table(spark, sf_dir, "documents"), "doc_id", "text", MIN_SPAN))
    return members.select("class", F.col("id").alias("doc_id"), (F.col("n") - 1).alias("n_links"))


@R.query(_WINDOWS + """, c AS (SELECT doc_id, sum(least(300, coalesce(next - i, 300))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM x) GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0 END AS portion FROM documents LEFT JOIN c USING (doc_id)""")
def p9_shared_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many of its characters stand in spans of at least 300 that another document has too."""
    documents = table(spark, sf_dir, "documents")
    places = shared_places(documents, "doc_id", "text", MIN_SPAN)
    return shared_portion(documents, "doc_id", "text", places).withColumn("portion", F.round("portion", 6))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


@R.query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items of which they hold a passage."""
    return _leaks(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


_CLEAN = r"""regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\x{00AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '(?s)<!--.*?-->|</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>', ' ', 'g'), '&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,8});', ' ', 'g'), '[\pL\pN]+')"""


@R.query(f"""
WITH d AS (SELECT doc_id, {_CLEAN} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_CLEAN} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS k FROM i WHERE len(w) >= 20))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)
UNION SELECT doc_id, item_id FROM d JOIN i ON len(i.w) BETWEEN 1 AND 19 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
""")
def p7_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items of which they hold 20 consecutive words, or a shorter item whole, without any change: the same search with no edits allowed."""
    found = leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", Tolerance(20, 0))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@R.query()
def p7_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that it leaked into."""
    n = _leaks(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    items = table(spark, sf_dir, "eval_items").select("item_id")
    return items.join(n, F.col("item") == F.col("item_id"), "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = stage(token_counts(table(spark, sf_dir, "documents"), "doc_id", "source", "text"), "token-counts")
    targets = table(spark, sf_dir, "mix_targets")
    return mix(counts, targets), targets


@R.query()
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their copies."""
    mixed, _ = _mixture(spark, sf_dir)
    return mixed.where(F.col("copies") > 0).select(F.col("id").alias("doc_id"), "source", "n_tokens", "copies")


@R.query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: the share aimed at and the share reached."""
    mixed, targets = _mixture(spark, sf_dir)
    return shares(mixed, targets).withColumn("actual_share", F.round("actual_share", 6))
