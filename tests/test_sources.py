from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_functions import a_record, packet

from dnslens.functions import ip_to_long
from dnslens.sources import readers, sinks


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def ip(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


GOOD = packet(a_record("08080808"))


def test_probe_scan_drops_bad_lines(spark, tmp_path):
    path = write(
        tmp_path, "local.csv",
        f"8.8.8.8,2015-04-25T00:00:00,{GOOD}", f"8.8.8.8,{GOOD}", f"1.1.1.1,a,b,{GOOD}", f"2.2.2.2,t,{GOOD[:-3]}", "",
    )
    write(tmp_path, "local.csv.ip", "8.8.8.8")
    scan = readers.read_probe_scan(spark, path)
    assert rows(scan, "resolver_ip", "qname") == [("8.8.8.8", "d1.example")]
    assert readers.read_probe_scan_raw(spark, path).count() == 2
    assert readers.read_expected_ip(spark, path + ".ip") == ip("8.8.8.8")


def test_domain_scan_needs_a_domain_list_and_a_known_probe(spark, tmp_path):
    write(tmp_path, "0a.csv", f"8.8.8.8,1,t,{GOOD}", f"8.8.8.8,2,t,{GOOD}", f"8.8.8.8,t,{GOOD}", f"8.8.8.8,x,t,{GOOD}")
    write(tmp_path, "0a.json", json.dumps(["d0.example", "d1.example"]))
    write(tmp_path, "0b.csv", f"8.8.8.8,0,t,{GOOD}")
    scan = readers.read_domain_scan(spark, str(tmp_path))
    assert rows(scan, "shard", "probe", "domain") == [("0a", 1, "d1.example")]


def test_observations_and_failures(spark, tmp_path):
    path = write(
        tmp_path, "asn.json",
        '{"name":"a.example","failed":2,"3356":{"20.0.0.10":5,"empty":2},"unknown":{"20.0.0.10":1}}',
        '{"name":"a.example","failed":1,"3356":{"20.0.0.10":1,"2001:db8::1":4,"undefined":3}}',
        '{"name":"b.example","failed":0,"ZZ":{}}', '{"name":"b.example","failed":"x","other":3}', "undefined", "", '{"name":"c.example","failed":0,"33',
    )
    got = rows(readers.read_observations(spark, path).na.fill(-1), "domain", "resolver_asn", "answer_ip", "n")
    assert got == [("a.example", -1, ip("20.0.0.10"), 1), ("a.example", 3356, -1, 2), ("a.example", 3356, ip("20.0.0.10"), 6)]
    assert rows(readers.read_failures(spark, path), "domain", "failed") == [("a.example", 3), ("b.example", 0)]


def test_observations_are_a_line_for_each_domain(spark, tmp_path):
    obs = spark.range(20000).select(
        F.when(F.col("id") % 50 == 0, 'b{"}.example').otherwise("a.example").alias("domain"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("resolver_asn"),
        (F.col("id") + 335544320).alias("answer_ip"), (F.col("id") + 1).alias("n"),
    )
    failures = spark.createDataFrame([("a.example", 7)], "domain string, failed bigint")
    domains = spark.createDataFrame([("a.example",), ("quiet.example",), ("quiet.example",)], "domain string")
    path = str(tmp_path / "out")
    sinks.write_observations(obs, failures, domains, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect() if r.value.strip()]
    assert sorted(x["name"] for x in lines) == ["a.example", 'b{"}.example', "quiet.example"]
    assert {x["name"]: sum(len(v) for k, v in x.items() if k not in ("name", "failed")) for x in lines} == {
        "a.example": 19600, 'b{"}.example': 400, "quiet.example": 0
    }
    back = readers.read_observations(spark, path)
    cols = ["domain", "resolver_asn", "answer_ip", "n"]
    assert rows(back.na.fill(-1), *cols) == rows(obs.na.fill(-1), *cols)
    assert rows(readers.read_failures(spark, path), "domain", "failed") == [("a.example", 7), ('b{"}.example', 0), ("quiet.example", 0)]


COUNTS = ("ip", "domain", "n")


def test_count_map_reads_one_object_or_many_lines(spark, tmp_path):
    lines = ['{"1":{"a":2,"b":3},"2":{"a":1}, "x":{}}', '{"3":{"c":1}}']
    want = [("1", "a", 2), ("1", "b", 3), ("2", "a", 1), ("3", "c", 1)]
    path = write(tmp_path, "m.json", *lines)
    assert rows(readers.read_count_map(spark, path, COUNTS), *COUNTS) == want
    whole = {k: v for line in lines for k, v in json.loads(line).items()}
    for indent in (None, 1, 4):
        path = write(tmp_path, f"f{indent}.json", json.dumps(whole, indent=indent))
        assert rows(readers.read_count_map(spark, path, COUNTS), *COUNTS) == want
    weights = write(tmp_path, "w.json", '{"a":{"1":-0.5}}')
    assert readers.read_count_map(spark, weights, ("domain", "net", "w"), "double").first()["w"] == -0.5
    assert readers.read_count_map(spark, write(tmp_path, "e.json", "{}"), COUNTS).count() == 0


def test_count_map_that_does_not_parse_is_an_error(spark, tmp_path):
    for i, bad in enumerate(["{bad", '{"1":{"a":2,"b', '{"1":{"a":x}}', '{"1":3}', '{"a}":{"b":1}}']):
        path = write(tmp_path, f"bad{i}.json", '{"9":{"z":1}}', bad)
        with pytest.raises(Exception, match="not a two-level object"):
            readers.read_count_map(spark, path, COUNTS).collect()
        assert ("9", "z", 1) in rows(readers.read_count_map(spark, path, COUNTS, malformed="drop"), *COUNTS)
    with pytest.raises(ValueError):
        readers.read_count_map(spark, path, COUNTS, malformed="keep")


def test_one_large_object_is_read_by_many_tasks(spark, tmp_path):
    whole = {f"d{i}": {str(j): i * j for j in range(i % 40)} for i in range(3000)}
    want = sorted((k, x, n) for k, m in whole.items() for x, n in m.items())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        for indent in (None, 2):
            path = write(tmp_path, f"big{indent}.json", json.dumps(whole, indent=indent))
            df = readers.read_count_map(spark, path, COUNTS)
            assert df.rdd.getNumPartitions() > 5
            assert rows(df, *COUNTS) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_count_map_is_a_line_for_each_key(spark, tmp_path):
    df = spark.range(5000).selectExpr("if(id % 10 = 0, 'q}{\"', 'hot') as k", "concat('n', id) as x", "id * 0.5 as v")
    path = str(tmp_path / "map")
    sinks.write_count_map(df, "k", "x", "v", path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect() if r.value.strip()]
    assert sorted((k, len(m)) for x in lines for k, m in x.items()) == [("hot", 4500), ('q}{"', 500)]
    assert rows(readers.read_count_map(spark, path, ("k", "x", "v"), "double"), "k", "x", "v") == rows(df, "k", "x", "v")
    empty = str(tmp_path / "empty")
    sinks.write_count_map(df.filter("false"), "k", "x", "v", empty)
    assert readers.read_count_map(spark, empty, ("k", "x", "v")).count() == 0


def test_keyed_lines_last_wins(spark, tmp_path):
    servers = write(tmp_path, "s.json", '["20.0.0.10",500,"old"]', "junk", '["20.0.0.12","up","x"]', '["20.0.0.10",200,"nginx"]', '["20.0.0.11",404,""]')
    assert rows(readers.read_keyed_jsonlines(spark, servers, "servers"), "ip", "status", "server") == [
        (ip("20.0.0.10"), 200, "nginx"), (ip("20.0.0.11"), 404, ""), (ip("20.0.0.12"), None, "x")
    ]
    ptrs = write(tmp_path, "p.json", '["20.0.0.10",["h1.cdn4.net","x"]]', '["20.0.0.99",["late.net"]]')
    assert readers.read_keyed_jsonlines(spark, ptrs, "ptrs").filter(F.col("ip") == ip("20.0.0.10")).first()["names"] == ["h1.cdn4.net", "x"]
    by_net = readers.read_keyed_jsonlines(spark, ptrs, "ptrs", by_network=True).collect()
    assert [(r.net, r.names) for r in by_net] == [(ip("20.0.0.0"), ["late.net"])]
    whois = write(tmp_path, "w.json", '["20.0.0.10","ACME"]', '["20.0.0.11",null]')
    assert readers.read_keyed_jsonlines(spark, whois, "whois").filter("org is not null").first()["org"] == "ACME"


def test_favicon_lines(spark, tmp_path):
    path = write(tmp_path, "f.json", '["20.0.0.10",{"a":[500,0,""]}]', '["20.0.0.10",{"a":[200,9,"h","t"],"b":[-1]}]')
    got = readers.read_favicons(spark, path).orderBy("host").collect()
    assert [(r.host, r.status, r.length, r.hash, r.ctype) for r in got] == [("a", 200, 9, "h", "t"), ("b", -1, None, None, None)]


def test_routing_sources(spark, tmp_path):
    zone = write(tmp_path, "zone", 'x IN TXT  "3356" "8.0.0.0" "9"', "x IN A 1.1.1.1", 'x IN TXT "1" "8.0.0.0" "9"')
    assert rows(readers.read_origin_prefixes(spark, zone), "network", "prefix_len", "asn") == [(ip("8.0.0.0"), 9, 1)]
    report = write(tmp_path, "report", "1 AS3356 EXAMPLE,US", "2 AS9 NONE", "3 AS3356 EXAMPLE,DE")
    assert rows(readers.read_asn_country_report(spark, report), "asn", "country") == [(3356, "DE")]


def test_resolver_lists(spark, tmp_path):
    path = write(tmp_path, "servers.txt", "8.8.8.8/32", "", "1.1.1.1/32")
    listed = readers.read_resolver_list(spark, path)
    assert rows(listed, "ip") == [(ip("1.1.1.1"),), (ip("8.8.8.8"),)]
    whitelist = write(tmp_path, "w.json", '{"8.8.8.8":true,"_done": true}')
    assert rows(readers.read_resolver_list(spark, whitelist, "json"), "ip") == [(ip("8.8.8.8"),)]
    with pytest.raises(ValueError):
        sinks.write_resolver_list(listed, str(tmp_path / "x"), fmt="xml")


def test_http_scans(spark, tmp_path):
    base = tmp_path / "http"
    base.mkdir()
    write(base, "80-syn.csv", "1.1.1.1", "2.2.2.2", "saddr")
    write(base, "443-syn.csv", "1.1.1.1")
    write(base, "other.csv", "9.9.9.9")
    manifest = write(tmp_path, "m.json", json.dumps([
        {"name": "runs/http/80-syn.csv", "port": 80, "mode": "syn"},
        {"name": "runs/http/443-syn.csv", "port": 443, "mode": "syn"},
    ], indent=1))
    scans = readers.read_http_scans(spark, manifest, str(base))
    assert rows(scans.ports(), "port") == [(80,), (443,)]
    assert rows(scans.modes(), "mode") == [("syn",)]
    assert rows(scans.with_port(80), "ip") == [(ip("1.1.1.1"),), (ip("2.2.2.2"),)]
    assert scans.with_mode("syn").count() == 3


META = {"software_name": "dnslens", "probe_ip": "1.2.3.4", "report_id": "r"}


def test_ooni_entries_are_cut_and_framed(spark, tmp_path):
    answers = spark.createDataFrame(
        [("s", "a.example", i, "8.8.8.8", ["1.1.1.1"]) for i in range(6)] + [("s", "b.example", 9, "8.8.4.4", ["2.2.2.2"])],
        "shard string, domain string, seq bigint, resolver_ip string, addrs array<string>",
    )
    shards = spark.createDataFrame([("s", 0, "a.example"), ("s", 1, "b.example"), ("s", 2, "c.example")], "shard string, idx int, domain string")
    records = sinks.ooni_records(answers, shards, META, 1.0, 2.0, 3.0, limit=2)
    sizes = sorted((r.input, r.chunk, len(r.queries or [])) for r in records.filter("record_type = 'entry'").collect())
    assert sizes == [("a.example", 0, 3), ("a.example", 1, 3), ("a.example", 2, 0), ("b.example", 0, 1), ("c.example", 0, 0)]
    path = str(tmp_path / "report")
    sinks.write_ooni(records, META, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {x["record_type"] for x in lines} == {"header", "entry", "footer"} and len(lines) == 7
    entry = next(x for x in lines if x["record_type"] == "entry" and x["input"] == "b.example")
    assert entry["queries"] == [{"resolver": ["8.8.4.4", 53], "query_type": "A", "query": "[Query('<b.example>',1,1)]", "addrs": ["2.2.2.2"]}]
    parts = sorted((tmp_path / "report").glob("part-*"))
    ordered = [json.loads(line) for p in parts for line in p.read_text().splitlines()]
    assert ordered[0]["record_type"] == "header" and ordered[-1]["record_type"] == "footer"


def test_report_entries_have_the_start_of_their_shard(spark):
    answers = spark.createDataFrame([], "shard string, domain string, seq bigint, resolver_ip string, addrs array<string>")
    shards = spark.createDataFrame([("s", 0, "a.example"), ("t", 0, "b.example")], "shard string, idx int, domain string")
    times = spark.createDataFrame([("s", 5.0), ("t", 6.5)], "shard string, start_time double")
    records = sinks.ooni_records(answers, shards, META, 1.0, times, 3.0)
    assert rows(records, "record_type", "start_time") == [("entry", 5.0), ("entry", 6.5), ("footer", 3.0), ("header", 1.0)]


def test_split_by_asn_keeps_known_addresses(spark, tmp_path):
    ips = spark.createDataFrame([("20.0.0.1",), ("20.0.1.1",), ("9.9.9.9",)], "t string").select(ip_to_long("t").alias("ip"))
    prefixes = spark.createDataFrame([(ip("20.0.0.0"), 24, 5), (ip("20.0.1.0"), 24, 6)], "network bigint, prefix_len int, asn bigint")
    path = str(tmp_path / "by-asn")
    sinks.split_by_asn(ips, prefixes, path)
    assert rows(spark.read.parquet(path), "asn", "ip") == [(5, ip("20.0.0.1")), (6, ip("20.0.1.1"))]
