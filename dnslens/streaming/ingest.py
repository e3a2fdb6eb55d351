"""Counting the responses of a scan while its files, and the lists of its shards, are still arriving.

Counts add up, so every micro-batch is aggregated on its own and stored as one folder of
partial counts; no state grows with the stream. A repeated batch overwrites its folder,
which makes the result exact after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollups import aggregate_listed_responses
from ..session import materialize
from ..sources.readers import asked_domains, read_shard_domains, scan_fields

LISTS = ".json"


def stream_scan_counts(
    spark: SparkSession,
    scans: str,
    prefixes: DataFrame,
    whitelist: DataFrame,
    out: str,
    checkpoint: str,
    pattern: str = "*.csv",
    **trigger,
) -> StreamingQuery:
    """Start counting scan files under ``scans`` into ``out``; see ``read_scan_counts``.

    The domain list of a shard is a ``<shard>.json`` there, and may arrive before its scan file or after
    it. Lists are read anew for each batch. Rows of shards without a list are kept beside ``out`` and
    counted by the batch in which their list is there; an arriving list is reason enough for a batch. Packets
    of shards that have their list never move. ``trigger`` is passed on, e.g. ``availableNow=True`` or
    ``processingTime="1 minute"``.
    """
    text = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{{{pattern},*{LISTS}}}")
        .text(scans)
    )
    rows = scan_fields(text.filter(~F.col("_metadata.file_path").endswith(LISTS)))
    waiting = f"{out.rstrip('/')}-waiting"

    def store(batch: DataFrame, batch_id: int) -> None:
        lists = materialize(read_shard_domains(spark, scans, f"*{LISTS}"), "lists")
        held = batch
        if batch_id:  # what the batch before could not count
            held = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{waiting}/batch={batch_id - 1}"))
        known = lists.select("shard").distinct()
        unlisted = held.join(known, "shard", "left_anti")
        unlisted.write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
        counts = aggregate_listed_responses(asked_domains(held, lists), lists, prefixes, whitelist)
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_scan_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts over all batches so far, in the form ``aggregate_responses`` returns."""
    return (
        spark.read.parquet(out)
        .groupBy("failed", "domain", "resolver_asn", "answer_ip")
        .agg(F.sum("n").alias("n"))
    )
