"""Physical plans: no pair-producing joins, narrow scans, no forced broadcasts."""

from __future__ import annotations

import pathlib
import re

import pytest

import __spark_entry__ as entry
from dnslens import session
from dnslens.plans.adapter import Inputs

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent / "dnslens"


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables a query stores on the way."""
    seen = []

    def record(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, name)

    original = session.materialize
    for module in ("plans.adapter", "plans.queries", "operators.similarity", "operators.clusters", "operators.interference", "operators.ranking"):
        monkeypatch.setattr(f"dnslens.{module}.materialize", record)
    return seen


@pytest.mark.parametrize(
    "name",
    [
        "lpm_join", "asn_flow", "country_flow", "expected_queries_by_asn", "self_pair_join", "domain_similarity",
        "reweight_networks", "score_resolutions", "score_asn_ips", "cluster_footprint_similarity", "correlation_cluster",
        "country_anomalies", "drop_ubiquitous_anomalies", "anomaly_summary", "block_page_ips", "resolution_underflow",
        "asn_diversity_outliers", "http_scan_stats", "favicon_carry_forward", "shard_domains", "aggregate_responses",
    ],
)
def test_no_nested_loops(spark, plans, name):
    df = entry.queries()[name](spark, SF)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_read_only_the_needed_columns(spark):
    plan = Inputs(spark, SF).observations._jdf.queryExecution().executedPlan().toString()
    schemas = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == [
        "c_custkey:bigint,c_nationkey:int",
        "l_orderkey:bigint,l_partkey:bigint,l_linenumber:int",
        "o_orderkey:bigint,o_custkey:bigint",
        "p_partkey:bigint,p_brand:string",
    ]


def test_packets_are_never_shuffled(spark, monkeypatch):
    """Neither with a broadcast list nor without does an exchange carry ``data_hex``."""
    from dnslens.operators import rollups

    scan = spark.createDataFrame([("s", "d.example", "8.8.8.8", "00")], "shard string, domain string, resolver_ip string, data_hex string")
    shards = spark.createDataFrame([("s", 0, "d.example")], "shard string, idx int, domain string")
    prefixes = spark.createDataFrame([(134744064, 24, 7)], "network bigint, prefix_len int, asn bigint")
    listed = spark.createDataFrame([(134744072,)], "ip bigint")
    for most in (10, 0):
        monkeypatch.setattr(rollups, "_BROADCAST_RESOLVERS", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            df = rollups.aggregate_listed_responses(scan, shards, prefixes, listed)
            plan = df._jdf.queryExecution().executedPlan().toString()
            rows = [tuple(r) for r in df.collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert rows == [(True, "d.example", None, None, 1)]
        lines = plan.split("\n")
        moved = [lines[at + 1] for at, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert moved and not any("data_hex" in line for line in moved)


def test_top_k_is_limited_before_the_shuffle(spark):
    df = entry.queries()["top_k_by_weight"](spark, SF)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_library_never_forces_a_broadcast_or_a_local_cut():
    checked = "if listed.count() <= _BROADCAST_RESOLVERS:\n        return aggregate_responses(keyed.join(F.broadcast(listed)"
    for path in ROOT.rglob("*.py"):
        if path.parent.name == "llm":
            continue  # has rules and tests of its own
        text = path.read_text().replace(checked, "")
        for banned in ("broadcast(", "localCheckpoint", "crossJoin", ".toPandas(", ".collect()", ".rdd.map"):
            assert banned not in text, f"{path.name}: {banned}"


def test_scan_files_take_the_joins_once_and_no_sort(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    seen, write, setting = [], DataFrameWriter.text, "spark.sql.maxConcurrentOutputFileWriters"

    def text(self, *args, **kwargs):
        plan = self._df._jdf.queryExecution().optimizedPlan().toString()
        seen.append((plan.count("Join "), int(spark.conf.get(setting, "0"))))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "text", text)
    before = spark.conf.get(setting, None)
    rows = entry.queries()["read_domain_scan"](spark, SF)
    joins, writers = seen[0]
    assert joins == 1 and writers > 0  # the shards only; the order tables were joined and stored before
    assert spark.conf.get(setting, None) == before
    assert rows.count() > 0


def test_answers_meet_a_large_list_without_a_count_by_resolver(spark, monkeypatch):
    from dnslens.operators import rollups

    monkeypatch.setattr(rollups, "_BROADCAST_RESOLVERS", -1)
    scan = spark.createDataFrame([("s", "1.2.3.4", "d.example", "00")] * 2, "shard string, resolver_ip string, domain string, data_hex string")
    shards = spark.createDataFrame([("s", "d.example")], "shard string, domain string")
    prefixes = spark.createDataFrame([(16777216, 8, 7)], "network long, prefix_len int, asn int")
    listed = spark.createDataFrame([(16909060,)], "ip long")
    df = rollups.aggregate_listed_responses(scan, shards, prefixes, listed)
    assert "_resolver" not in "".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line)
    assert [tuple(r) for r in df.collect()] == [(True, "d.example", None, None, 2)]


def test_report_queries_move_without_what_their_entry_shares(spark):
    from dnslens.sources import sinks

    rows = spark.createDataFrame([("s", "d.example", 1, "1.2.3.4", ["5.6.7.8"])], "shard string, domain string, seq long, resolver_ip string, addrs array<string>")
    shards = spark.createDataFrame([("s", "d.example")], "shard string, domain string")
    df = sinks.ooni_records(rows, shards, {}, 0.0, 0.0, 1.0)
    collected = re.findall(r"collect_list\(struct\(([^()]*)", df._jdf.queryExecution().optimizedPlan().toString())
    assert collected and not any("query" in fields for fields in collected)
    assert [q["query"] for q in df.filter("record_type = 'entry'").first()["queries"]] == ["[Query('<d.example>',1,1)]"]
