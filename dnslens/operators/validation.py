"""Checking answers against icons fetched from the real sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_favicons(fetched: DataFrame) -> DataFrame:
    """Icon hash per host from a local fetch (``host, status, hash, seq``); last good one wins."""
    good = fetched.filter(F.col("status") == 200)
    return good.groupBy("host").agg(F.max_by("hash", "seq").alias("hash"))


def favicon_match(favicons: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each address served the expected icon, for hosts with an expectation."""
    want = expected.select("host", F.col("hash").alias("_want"))
    same = F.coalesce(F.col("hash") == F.col("_want"), F.lit(False))
    return favicons.join(want, "host").select("ip", "host", same.alias("matched"))


def favicon_carry_forward(favicons: DataFrame) -> DataFrame:
    """After the first connection failure of an address, later hosts get that result.

    The failure is found by an aggregate and joined back, so an address with very many
    hosts is never ordered in one task.
    """
    result = ["status", "length", "hash", "ctype"]
    stop = (
        favicons.filter(F.col("status") < 0)
        .groupBy("ip")
        .agg(F.min("seq").alias("_stop"), F.min_by(F.struct(*result), "seq").alias("_last"))
    )
    joined = favicons.join(stop, "ip", "left")
    carried = F.col("seq") > F.col("_stop")
    return joined.select(
        "ip",
        "host",
        "seq",
        *[F.when(carried, F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) for c in result],
    )


def score_validation(matches: DataFrame, scores: DataFrame, cut: float) -> tuple[DataFrame, DataFrame]:
    """How well scores split at ``cut`` agree with icon matches: (per domain, overall).

    A match should score above the cut, a mismatch below it; a score on the cut is never
    right, and addresses without a score (or scoring 0) are skipped.
    """
    rows = matches.select("ip", F.col("host").alias("domain"), "matched").join(
        scores.filter("score <> 0"), ["domain", "ip"]
    )
    right = F.when(F.col("matched"), F.col("score") > cut).otherwise(F.col("score") < cut)
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("correct"),
        F.count_if(F.col("matched")).alias("matches"),
        F.count_if(F.col("matched") & right).alias("matches_correct"),
    ]
    per_domain = rows.groupBy("domain").agg(*measures)
    share = F.col("correct") / F.col("n")
    overall = per_domain.agg(
        *[F.sum(c).alias(c) for c in ("n", "correct", "matches", "matches_correct")]
    )
    return per_domain.withColumn("accuracy", share), overall.withColumn("accuracy", share)
