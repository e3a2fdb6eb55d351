from __future__ import annotations

import json

from test_functions import a_record, packet
from test_sources import ip

from dnslens.operators.rollups import aggregate_responses, with_resolver_asn
from dnslens.sources import readers
from dnslens.streaming.ingest import read_scan_counts, stream_scan_counts


def counts(df):
    return sorted((r.failed, r.domain, r.resolver_asn or 0, r.answer_ip or 0, r.n) for r in df.collect())


def test_files_arriving_later_add_up_to_the_batch_result(spark, tmp_path):
    scans = tmp_path / "scan"
    scans.mkdir()
    good, empty = packet(a_record("08080808")), packet()
    (scans / "0a.json").write_text(json.dumps(["d0.example", "d1.example"]))
    (scans / "0a.csv").write_text(f"8.8.8.8,1,t,{good}\n8.8.8.8,0,t,{empty}\n9.9.9.9,1,t,{good}\n")
    prefixes = spark.createDataFrame([(ip("8.8.8.0"), 24, 7)], "network bigint, prefix_len int, asn bigint")
    whitelist = spark.createDataFrame([(ip("8.8.8.8"),), (ip("8.8.4.4"),)], "ip bigint")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        q = stream_scan_counts(spark, str(scans), prefixes, whitelist, out, state)
        assert q.awaitTermination(120)

    drain()
    assert counts(read_scan_counts(spark, out)) == [
        (False, "d1.example", 7, 0, 1), (False, "d1.example", 7, ip("8.8.8.8"), 1)
    ]
    (scans / "0b.json").write_text(json.dumps(["d1.example"]))
    (scans / "0b.csv").write_text(f"8.8.8.8,0,t,{good}\n8.8.4.4,0,t,{good[:-2]}\n")
    drain()
    batch = with_resolver_asn(readers.read_domain_scan(spark, str(scans)), prefixes, whitelist)
    whole = aggregate_responses(batch, readers.read_shard_domains(spark, str(scans)))
    assert counts(read_scan_counts(spark, out)) == counts(whole)
    assert (True, "d1.example", 0, 0, 1) in counts(whole)


def test_a_list_that_arrives_after_its_scan_in_a_running_query(spark, tmp_path):
    scans = tmp_path / "scan"
    scans.mkdir()
    good = packet(a_record("08080808"))
    # The list has as many entries as a scan line has fields.
    names = ["d0.example", "d1.example", "d2.example", "d3.example"]
    (scans / "0a.csv").write_text(f"8.8.8.8,1,t,{good}\n8.8.8.8,1,u,{good}\n9.9.9.9,1,t,{good}\n")
    (scans / "0b.csv").write_text(f"8.8.8.8,1,t,{good}\n")
    (scans / "0b.json").write_text(json.dumps(names))
    prefixes = spark.createDataFrame([(ip("8.8.8.0"), 24, 7)], "network bigint, prefix_len int, asn bigint")
    whitelist = spark.createDataFrame([(ip("8.8.8.8"),)], "ip bigint")
    out = str(tmp_path / "out")
    q = stream_scan_counts(
        spark, str(scans), prefixes, whitelist, out, str(tmp_path / "state"), processingTime="200 milliseconds"
    )
    try:
        q.processAllAvailable()
        assert counts(read_scan_counts(spark, out)) == [(False, "d1.example", 7, ip("8.8.8.8"), 1)]
        (scans / "0a.json").write_text(json.dumps(names))
        q.processAllAvailable()
        assert counts(read_scan_counts(spark, out)) == [(False, "d1.example", 7, ip("8.8.8.8"), 3)]
        (scans / "0a.csv.more.csv").write_text(f"8.8.8.8,1,t,{good}\n")
        q.processAllAvailable()
        assert counts(read_scan_counts(spark, out)) == [(False, "d1.example", 7, ip("8.8.8.8"), 3)]
    finally:
        q.stop()
    batch = aggregate_responses(
        with_resolver_asn(readers.read_domain_scan(spark, str(scans)), prefixes, whitelist),
        readers.read_shard_domains(spark, str(scans)),
    )
    assert counts(batch) == counts(read_scan_counts(spark, out))
