"""Quality rules judged per document and per host.

Each document gets its counts and a verdict of its own. Failures are then summed by host,
the hosts' failure rates are shrunk towards an empirical beta prior, and the hosts' verdicts
are joined back: a document is kept if it passes itself and its host is not rejected.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 3

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the list."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (
        len(words),
        len(b"".join(words).decode()),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def text_counts(texts: pd.Series) -> pd.DataFrame:
    names = [part.split()[0] for part in COUNTS.split(", ")]
    return pd.DataFrame([count_text(t) for t in texts], columns=names)


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host``, the counts, and ``base_failed`` for each document.

    A null or empty text has no words and fails. Very long texts are counted whole.
    """
    counts = F.pandas_udf(text_counts, COUNTS)
    counted = docs.select("doc_id", F.col(host).alias("host"), counts("text").alias("c"))
    few = F.col("n_words") < MIN_WORDS
    repetitive = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return counted.select("doc_id", "host", "c.*").withColumn("base_failed", few | repetitive)


def host_rates(judged: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed, rate``: failure rates shrunk by an empirical beta prior.

    The prior's mean and strength come from the mean and variance of the hosts' raw rates
    (method of moments). Hosts that all agree give an infinitely strong prior, so each has
    the mean; a variance beyond that of any beta gives strength 0, so each keeps its own.
    A null host is a host of its own.
    """
    hosts = stored(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(F.col("base_failed").cast("long")).alias("n_failed"),
        ),
        "hosts",
    )
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v")).first()
    if not prior.v:
        return hosts.withColumn("rate", F.lit(prior.m))
    strength = max(0.0, prior.m * (1 - prior.m) / prior.v - 1)
    shrunk = (F.col("n_failed") + F.lit(prior.m * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", shrunk)


def quality(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """All of ``document_rules`` plus ``host_rate`` and ``kept``, a row for each input row.

    Hosts with a shrunk rate above ``max_rate`` are rejected whole. An empty table gives an
    empty result; other columns of ``docs`` are not looked at. Only counts are shuffled:
    rows of a hot host are added up before they move, and the verdicts join back to rows
    of a few numbers, where adaptive execution splits a hot host.
    """
    judged = stored(document_rules(docs, host), "judged")
    verdicts = host_rates(judged).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"))
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
