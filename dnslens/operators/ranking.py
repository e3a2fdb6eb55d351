"""Ordering operators that never hold a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import as_col
from ..session import materialize


def row_numbers(
    df: DataFrame,
    order: str,
    keys: list[str] | None = None,
    out: str = "rn",
    slices: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` by ``order`` (unique, such as a file position) inside ``keys``.

    Rows are range partitioned by key and order, so a huge group is cut into many evenly
    filled slices. Sorted slices are stored with their row positions; a number is then the
    position in the slice plus the rows of the group in earlier slices, taken from one
    small row per group and slice.
    """
    keys = keys or []
    by = [*keys, order]
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    # The upper bits of the position are the number of the slice.
    stored = materialize(placed, "numbered").withColumn("_slice", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        stored.groupBy(*keys, "_slice")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    numbered = _null_safe_join(stored, runs, [*keys, "_slice"])
    number = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return numbered.withColumn(out, number).drop("_at", "_slice", "_first", "_before")


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner"):
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def top_k_by_weight(df: DataFrame, keys: list[str], value: str, weight: str, k: int) -> DataFrame:
    """The ``k`` heaviest values per group with their rank; ties go to the smaller value.

    The rank filter is pushed below the shuffle (window group limit), so at most ``k``
    rows per group and input partition move.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(weight), F.asc_nulls_first(value))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def heaviest(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: the value with the largest weight, ties to the smaller value."""
    v, w = as_col(value), as_col(weight)
    return F.min_by(F.struct(v.alias("value"), w.alias("n")), F.struct((-w).alias("w"), v.alias("v")))


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mode of ``value`` per group and how often it occurs."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy(*keys)
        .agg(heaviest(value, "n").alias("_top"))
        .select(*keys, F.col("_top.value").alias(value), F.col("_top.n").alias("n"))
    )


def cumulative_cliff(
    counts: DataFrame,
    key: str,
    value: str,
    weight: str,
    share: float = 0.75,
    max_values: int = 4,
    ratio: float = 1.5,
) -> DataFrame:
    """Shortest head (at most ``max_values`` values) holding more than ``share`` of a group.

    The head counts only if its last value outweighs the next one by ``ratio``. Returns
    one row per value in the head: ``key, value, weight, rank``.
    """
    totals = counts.groupBy(key).agg(F.sum(weight).alias("_total"))
    head = top_k_by_weight(counts, [key], value, weight, max_values + 1).join(totals, key)
    w = Window.partitionBy(key).orderBy("rank")
    head = head.withColumn(
        "_cum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("_next", F.lead(weight).over(w))
    reached = (F.col("_cum") > F.col("_total") * F.lit(share)) & (F.col("rank") <= max_values)
    clear = F.col("_next").isNull() | (F.col(weight) >= F.col("_next") * F.lit(ratio))
    whole = Window.partitionBy(key)
    head = head.withColumn("_stop", F.min(F.when(reached, F.col("rank"))).over(whole))
    head = head.withColumn(
        "_clear", F.bool_or((F.col("rank") == F.col("_stop")) & clear).over(whole)
    )
    return head.filter((F.col("rank") <= F.col("_stop")) & F.col("_clear")).select(
        key, value, weight, "rank"
    )
