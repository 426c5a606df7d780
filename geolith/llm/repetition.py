"""Repetition inside documents, judged by document and by host.

A document's measure is the share of its words that lie in a sequence of consecutive words that began earlier in
the same text.  The rule's failures are aggregated by host; a host's failure rate is shrunk towards the corpus by
a beta prior fitted to all hosts' rates by moments; verdicts go back to the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
RUN = 8
LEAST_SHARE = 0.30
_WORD = regex.compile(WORD)
BAD_HOST_RATE = 0.5


def repeated_words(text: str, run: int = RUN) -> tuple[int, int]:
    """(words, repeated words) of a text."""
    codes: dict[str, int] = {}
    ids = [codes.setdefault(w.lower(), len(codes)) for w in _WORD.findall(text)]
    n = len(ids)
    if n <= run or n == len(codes):
        return n, 0
    a = np.array(ids, dtype=np.int32)
    # A repeated run has only words that occur twice; most texts have no such stretch, and need no comparison of runs.
    often = np.bincount(a)[a] > 1
    whole = np.convolve(often, np.ones(run, dtype=np.int64), "valid") == run
    starts = np.flatnonzero(whole)
    if len(starts) < 2:
        return n, 0
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, run)[starts]).view(f"V{4 * run}").ravel()
    seen: set[bytes] = set()
    marks = np.zeros(n + 1, dtype=np.int64)
    for at, w in zip(starts.tolist(), windows.tolist()):
        if w in seen:
            marks[at] += 1
            marks[at + run] -= 1
        else:
            seen.add(w)
    return n, int((np.cumsum(marks[:-1]) > 0).sum())


def measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(0, 0) if not t else repeated_words(t) for t in texts], columns=["words", "repeated"], dtype="int64")


def host_rates(judged: DataFrame) -> DataFrame:
    """host, documents, failures, shrunk_rate, bad_host; judged has host and fails. Documents without host count as one host, null.

    The prior Beta(m k, (1 - m) k) has the corpus rate m as mean, and the k at which its variance with the binomial
    noise is the variance seen between hosts, hosts weighing by their documents; without excess variance k is the
    number of documents, so rates shrink to m, and k is never below one document.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("fails").cast("bigint")).alias("failures"))
    n, x = F.col("documents").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(F.sum(n).alias("total"), F.sum(x).alias("failed"), F.count(F.lit(1)).alias("hosts"), F.sum(x * x / n).alias("sx"), F.sum(n * n).alias("nn"))
    m = F.col("failed") / F.col("total")
    between = F.col("sx") - F.col("total") * m * m
    noise = (F.col("hosts") - 1) * m * (1 - m)
    spread = (F.col("total") - F.col("nn") / F.col("total")) * m * (1 - m) - between
    excess = between - noise
    prior = sums.select(m.alias("m"), F.when(excess > 0, F.greatest(spread / excess, F.lit(1.0))).otherwise(F.col("total")).alias("k"))
    rate = (x + F.col("m") * F.col("k")) / (n + F.col("k"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "documents", "failures", rate.alias("shrunk_rate"), (rate >= BAD_HOST_RATE).alias("bad_host"))  # prior: one row


def judge_repetition(documents: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "host", least: float = LEAST_SHARE) -> DataFrame:
    """doc_id, host, words, repeated, share, fails, shrunk_rate, bad_host for every document.

    share is null where a text has no words (null, empty, blank), which does not fail. Words are maximal runs of
    Unicode letters or digits, lower-cased; the text is read whole. Documents that repeat a doc_id are judged each.
    """
    seen = documents.select(documents[key].alias("doc_id"), documents[host].alias("host"), F.pandas_udf(measure, "words bigint, repeated bigint")(documents[text].cast("string")).alias("m"))
    judged = seen.select("doc_id", "host", "m.words", "m.repeated")
    share = F.when(F.col("words") > 0, F.col("repeated") / F.col("words"))
    judged = judged.withColumn("share", share).withColumn("fails", F.coalesce(F.col("repeated") >= F.col("words") * least - 1e-9, F.lit(False)) & (F.col("words") > 0))
    return judged


def with_host_verdicts(judged: DataFrame) -> DataFrame:
    """The judged documents with their host's shrunk failure rate and verdict."""
    rates = host_rates(judged).select(F.col("host").alias("of_host"), "shrunk_rate", "bad_host")
    return judged.join(rates, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
