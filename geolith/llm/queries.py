"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.groups import group_sizes, linked_groups, match_pairs
from geolith.llm.near_duplicates import near_duplicate_classes, near_duplicate_features
from geolith.llm.packing import pack_items, packing_report
from geolith.llm.repetition import host_rates, judge_repetition, with_host_verdicts
from geolith.llm.tokens import token_counts, token_ids, token_statistics
from geolith.plans.tables import table
from geolith.storage import Scratch

SMALL_LEAF = 64


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_groups(match_pairs(table(spark, folder, "duplicate_pairs")), Scratch(spark, "p3"))


def p3_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return group_sizes(p3_found(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_features(table(spark, folder, "feature_geometries"), Scratch(spark, "p6"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature with its class of equal geometries and the number of other classes it is linked to."""
    links, members = near_duplicate_classes(table(spark, folder, "feature_geometries"), Scratch(spark, "p6"))
    ends = links.select(F.explode(F.array("left_class", "right_class")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class", "left").select("feature_index", F.col("class").alias("class_index"), F.coalesce("links", F.lit(0)).alias("links"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_seams(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded as one piece and by a tree of very small leaves: how many there are, how many of the trees join, and how many differ."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    both = token_ids(token_ids(documents, ids="whole", leaf=1 << 30), ids="tree", leaf=SMALL_LEAF)
    return both.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.length("text") > SMALL_LEAF, 1)).alias("joined"), F.count(F.when(F.col("whole") != F.col("tree"), 1)).alias("different"))


def p7_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return token_statistics(token_counts(table(spark, folder, "documents").select("lang", "text")))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack_items(token_counts(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_tokens"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(p8_pack(spark, folder))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Measured once and written narrow, as hosts and documents are both derived from it."""
    return Scratch(spark, "p9").save(judge_repetition(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that fail the rule. The verdicts of their hosts are joined as in p9_documents, but by the problem's statement they decide nothing here."""
    return with_host_verdicts(_judged(spark, folder)).where("fails").select("doc_id")


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return with_host_verdicts(_judged(spark, folder)).select("doc_id", "host", "words", "repeated", F.round("share", 6).alias("share"), "fails", F.round("shrunk_rate", 6).alias("shrunk_rate"), "bad_host")


def p9_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return host_rates(_judged(spark, folder)).select("host", "documents", "failures", F.round("shrunk_rate", 6).alias("shrunk_rate"), "bad_host")


QUERIES = {f.__name__: f for f in (p3_found, p3_sizes, p6_found, p6_classes, p7_ids, p7_seams, p7_statistics, p8_pack, p8_report, p9_found, p9_documents, p9_hosts)}

_LINKED = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT left_index AS u, right_index AS v FROM duplicate_pairs
  WHERE left_index IS NOT NULL AND right_index IS NOT NULL AND similarity_percent >= 85 AND NOT isnan(similarity_percent)
  UNION
  SELECT right_index, left_index FROM duplicate_pairs
  WHERE left_index IS NOT NULL AND right_index IS NOT NULL AND similarity_percent >= 85 AND NOT isnan(similarity_percent)
), cc(feature_index, group_index) USING KEY (feature_index) AS (
  SELECT u, u FROM e GROUP BY u
  UNION
  (SELECT c.feature_index, min(n.group_index) FROM recurring.cc AS c, e, cc AS n
   WHERE e.u = c.feature_index AND e.v = n.feature_index AND n.group_index < c.group_index GROUP BY c.feature_index)
)"""
_REPEATED = r"""
WITH w AS (
  SELECT doc_id, host, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, gram) AS first FROM g) WHERE i > first
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS repeated FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM again) GROUP BY doc_id
), judged AS (
  SELECT w.doc_id, host, len(ws) AS words, coalesce(repeated, 0) AS repeated FROM w LEFT JOIN covered USING (doc_id)
)"""
_RATES = """, ruled AS (
  SELECT *, CASE WHEN words > 0 THEN repeated / words END AS share, words > 0 AND repeated >= 0.30 * words AS fails FROM judged
), hosts AS (
  SELECT host, count(*)::double AS n, (count(*) FILTER (fails))::double AS x FROM ruled GROUP BY host
), sums AS (
  SELECT sum(n) AS total, sum(x) / sum(n) AS m, count(*) AS k, sum(x * x / n) AS sx, sum(n * n) AS nn FROM hosts
), spread AS (
  SELECT m, total, sx - total * m * m AS between_hosts, (k - 1) * m * (1 - m) AS noise, (total - nn / total) * m * (1 - m) AS possible FROM sums
), prior AS (
  SELECT m, CASE WHEN between_hosts > noise THEN greatest((possible - between_hosts) / (between_hosts - noise), 1.0) ELSE total END AS k FROM spread
), rated AS (
  SELECT host, n::bigint AS documents, x::bigint AS failures, (x + m * k) / (n + k) AS rate FROM hosts, prior
)"""
ORACLES: dict[str, str] = {
    "p3_found": _LINKED + " SELECT group_index, feature_index FROM cc",
    "p3_sizes": _LINKED + " SELECT features, count(*) AS groups FROM (SELECT group_index, count(*) AS features FROM cc GROUP BY 1) GROUP BY 1",
    "p9_found": _REPEATED + " SELECT doc_id FROM judged WHERE words > 0 AND repeated >= 0.30 * words",
    "p7_seams": f"SELECT count(*) AS documents, count(*) FILTER (length(text) > {SMALL_LEAF}) AS joined, 0 AS different FROM documents",
    "p9_hosts": _REPEATED + _RATES + " SELECT host, documents, failures, round(rate, 6) AS shrunk_rate, rate >= 0.5 AS bad_host FROM rated",
    "p9_documents": _REPEATED + _RATES + """ SELECT doc_id, r.host, words, repeated, round(share, 6) AS share, fails, round(rate, 6) AS shrunk_rate, rate >= 0.5 AS bad_host
FROM ruled r JOIN rated h ON r.host IS NOT DISTINCT FROM h.host""",
}
