"""Shared by the operators: the word class, table access, stored steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize as stored
from ..session import scratch_path

# A word is a run of anything but the six ASCII blanks; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "stored", "scratch_path", "table", "n_words", "spread"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(spark: SparkSession, factor: int = 1) -> int:
    """How many groups to deal work into: follows the session's shuffle partitions."""
    return factor * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
