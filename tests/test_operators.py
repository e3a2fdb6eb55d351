from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_sources import ip, rows

from dnslens.functions import ip_to_long
from dnslens.operators import filters, interference, joins, ranking, rollups, scoring, setops, validation

OBS = "domain string, resolver_asn bigint, answer_ip bigint, n bigint"
PREFIXES = "network bigint, prefix_len int, asn bigint"
COUNTRY = "asn bigint, country string"
DECODED = "ip bigint, seq bigint, ok boolean, qr int, ra int, ancount int, a_records array<bigint>, first_a bigint"


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_lpm_prefers_the_longest_of_9_to_24(spark):
    routes = [("20.0.0.0", 9, 1), ("20.4.0.0", 16, 2), ("20.4.1.0", 24, 3), ("20.4.1.128", 25, 9), ("20.0.0.0", 8, 8)]
    prefixes = frame(spark, [(ip(n), length, a) for n, length, a in routes], PREFIXES)
    asked = ["20.4.1.200", "20.4.2.1", "20.9.0.1", "20.200.0.1"]
    df = frame(spark, [(a,) for a in asked], "t string").withColumn("ip", ip_to_long("t"))
    got = {r.t: r.asn for r in joins.lpm_join(df, prefixes).collect()}
    assert [got[a] for a in asked] == [3, 2, 1, None]
    wide = {r.t: r.asn for r in joins.lpm_join(df, prefixes, min_len=8, max_len=32).collect()}
    assert [wide[a] for a in asked] == [9, 2, 1, 8]


def test_lpm_equals_brute_force(spark):
    rng = random.Random(3)
    routes = {}
    for _ in range(300):
        length = rng.randrange(6, 29)
        base = rng.randrange(2**32) >> (32 - length) << (32 - length) if rng.random() < 0.2 else (rng.randrange(2**16) << 12) >> (32 - length) << (32 - length)
        routes[(base, length)] = rng.randrange(1, 2**32)
    ips = [rng.randrange(2**28) for _ in range(400)] + [rng.randrange(2**32) for _ in range(100)]

    def best(a):
        hits = [(length, asn) for (base, length), asn in routes.items() if 9 <= length <= 24 and a >> (32 - length) << (32 - length) == base]
        return max(hits)[1] if hits else None

    prefixes = frame(spark, [(b, n, a) for (b, n), a in routes.items()], PREFIXES)
    got = joins.lpm_join(frame(spark, [(a,) for a in ips], "ip bigint"), prefixes).collect()
    assert sorted((r.ip, r.asn or 0) for r in got) == sorted((a, best(a) or 0) for a in ips)


def probe(spark):
    good, bad = [5], [6]
    data = [
        (ip("1.0.0.1"), 2, True, 1, 1, 1, good, 5),
        (ip("1.0.0.2"), 1, True, 1, 1, 2, [7, 5], 7),
        (ip("1.0.1.1"), 3, True, 1, 1, 1, bad, 6),
        (ip("1.0.2.1"), 4, True, 0, 1, 1, good, 5),
        (ip("1.0.3.1"), 5, True, 1, 0, 1, bad, 6),
        (ip("1.0.4.1"), 6, True, 1, 1, 0, [], None),
        (ip("1.0.5.1"), 7, False, None, None, None, [], None),
        (ip("1.0.6.1"), 8, True, 1, 1, 1, [], None),
    ]
    return frame(spark, data, DECODED)


def test_select_resolvers_and_funnel(spark):
    decoded = probe(spark)
    assert rows(filters.select_resolvers(decoded, 5), "ip") == [(ip("1.0.0.2"),)]
    funnel = filters.resolver_funnel(decoded, 5).first()
    assert tuple(funnel) == (8, 5, 4, 2, 1)


def test_resolver_lists_by_first_answer(spark):
    decoded = probe(spark).withColumnRenamed("ip", "resolver_ip").filter("ok")
    servers = decoded.select("resolver_ip").unionByName(frame(spark, [(77,)], "resolver_ip bigint"))
    kept = {r[0] for r in joins.surviving_resolvers(servers, decoded, 5).collect()}
    assert kept == {ip("1.0.0.1"), ip("1.0.2.1"), ip("1.0.4.1"), 77}
    kept = {r[0] for r in joins.blacklist_anti(servers, decoded, 5).collect()}
    assert kept == {ip("1.0.0.1"), ip("1.0.2.1"), ip("1.0.3.1"), ip("1.0.4.1"), 77}


def test_collapse_hosts_and_thresholds(spark):
    hosts = frame(spark, [(256,), (257,), (512,)], "ip bigint")
    got = filters.collapse_hosts(hosts, 4, seed=1)
    assert rows(got, "net", "ip") == [(256, 256), (512, 512)]
    assert all(0 <= r.bucket < 4 for r in got.collect())
    asns = frame(spark, [(1,), (1,), (2,), (None,), (None,)], "asn bigint")
    assert rows(filters.asns_above_threshold(asns, 1), "asn", "n") == [(1, 2)]


def test_networks_of_an_older_run_are_bitmaps_of_fixed_size(spark):
    import random

    draw = random.Random(4)
    before = [draw.randrange(1 << 32) for _ in range(3000)] + [0, 255, 256, (1 << 32) - 1, None]
    now = [draw.randrange(1 << 32) for _ in range(3000)] + [n ^ 7 for n in before[:500]] + [1, 511, 512, (1 << 32) - 200, None]
    old = {n >> 8 for n in before if n is not None}
    df, run = (frame(spark, [(n,) for n in x], "ip bigint") for x in (now, before))
    kept = joins.historic_intersection(df, run)
    assert rows(kept, "ip") == sorted((n,) for n in now if n is not None and n >> 8 in old)
    assert joins.network_bitmaps(run).count() <= 512
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert joins.historic_intersection(df, run.filter("false")).count() == 0


def test_rows_move_once_to_what_is_known_of_their_address(spark):
    df = spark.createDataFrame([(5, {"a": 1}), (5, {"b": 2}), (None, {}), (9, None)], "ip bigint, m map<string,int>")
    prefixes = frame(spark, [(0, 24, 7)], "network bigint, prefix_len int, asn bigint")
    ptrs = frame(spark, [(5, ["x.cdn.net"]), (9, [])], "ip bigint, names array<string>")
    servers = frame(spark, [(5, 504, "no"), (9, 200, "nginx")], "ip bigint, status int, server string")
    whois = frame(spark, [(5, "ACME"), (9, None)], "ip bigint, org string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.attach_ip_metadata(df, "ip", prefixes, ptrs, servers, whois)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(out.select("ip", "asn", "ptr", "server", "org").collect(), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [tuple(r) for r in got] == sorted(
        [(5, 7, "cdn", None, "ACME")] * 2 + [(9, 7, None, "nginx", None), (None, None, None, None, None)], key=repr
    )
    lines = plan.split("\n")
    moved = [lines[at + 1] for at, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert sum("m#" in line for line in moved) == 1
    assert joins.lpm_join(df, prefixes).count() == 4 and joins.attach_ip_metadata(df, "ip").columns == ["ip", "m"]


def test_historic(spark):
    now = frame(spark, [(256,), (512,), (769,)], "ip bigint")
    before = frame(spark, [(300,), (301,), (800,)], "ip bigint")
    assert rows(joins.historic_intersection(now, before), "ip") == [(256,), (769,)]
    share = joins.historic_share(now, before).first()
    assert (share.total, share.kept, round(share.share, 6)) == (3, 2, 0.666667)


def test_new_network_redirects(spark):
    redirects = frame(spark, [("a", "b"), ("a", "c"), ("b", "a"), ("z", "b"), ("a", "nowhere")], "domain string, host string")
    ips = frame(spark, [("a", 256), ("b", 257), ("b", 600), ("c", 300)], "domain string, ip bigint")
    assert rows(joins.new_network_redirects(redirects, ips), "domain", "host") == [("a", "b")]


def test_country_of_asn_takes_the_last_and_bag_join_keeps_all(spark):
    listed = frame(spark, [(1, "AA"), (1, "BB"), (1, "BB")], COUNTRY)
    obs = frame(spark, [("d", 1, 5, 2), ("d", None, 5, 1)], OBS)
    assert rows(joins.country_of_asn(obs, listed, "resolver_asn", how="inner"), "country", "n") == [("BB", 2)]
    assert rows(joins.observations_by_country(obs, listed), "country", "n") == [("AA", 2), ("BB", 2)]


def test_expected_queries(spark):
    shard = frame(spark, [("s", i, f"d{i}") for i in range(10)] + [("t", 0, "e")], "shard string, idx int, domain string")
    resolvers = frame(spark, [(134744072, 7)], "ip bigint, asn bigint")
    assert rows(rollups.expected_queries_by_asn(resolvers, shard), "domain", "asn", "n") == [("d2", 7, 1), ("e", 7, 1)]
    twice = shard.unionByName(frame(spark, [("u", 0, "d2")], "shard string, idx int, domain string"))
    placed = frame(spark, [(134744072, "AA"), (10, None)], "ip bigint, country string")
    assert rows(rollups.expected_queries_by_country(placed, twice), "domain", "country", "n") == [("d2", "AA", 1), ("e", "AA", 1)]


def test_asn_flow_counts_empty_in_the_total(spark):
    obs = frame(spark, [("a", 1, 2560, 6), ("a", 1, None, 4), ("a", 1, 99999, 90), ("a", None, 2560, 5), ("b", 1, 2560, 5)], OBS)
    prefixes = frame(spark, [(2560 - 2560 % 65536, 16, 50)], PREFIXES)
    clusters = frame(spark, [("a", 0), ("b", 1)], "domain string, cluster_id int")
    footprint = frame(spark, [(0, 2560)], "cluster_id int, net bigint")
    flow = rollups.asn_flow(obs, prefixes, clusters, footprint)
    assert [(r.domain, r.resolver_asn, r.answer_asn, round(r.share, 6)) for r in flow.collect()] == [("a", 1, 50, 0.06)]
    assert rollups.asn_flow(obs, prefixes, clusters, footprint, share=0.06).count() == 0
    assert rollups.domains_without_footprint(obs, clusters, footprint).first()[0] == 1


def test_rollups_conserve_counts(spark):
    rng = random.Random(5)
    data = {(f"d{rng.randrange(4)}", rng.choice([None, 1, 2, 3]), rng.choice([None, rng.randrange(5000)])): rng.randrange(1, 9) for _ in range(200)}
    obs = frame(spark, [(*k, v) for k, v in data.items()], OBS)
    total = sum(v for (d, a, i), v in data.items() if a is not None and i is not None)
    for df in (rollups.ip_domain_counts(obs), rollups.network_domain_counts(obs), rollups.pivot_asn_ip_domain(obs)):
        assert df.agg(F.sum("n")).first()[0] == total
    with_empty = sum(v for (d, a, i), v in data.items() if a is not None)
    assert rollups.pivot_asn_domain_ip(obs).agg(F.sum("n")).first()[0] == with_empty


def test_underrepresented(spark):
    base = frame(spark, [("A", 10), ("B", 10), ("C", 10), ("D", 10)], "country string, n bigint")
    test = frame(spark, [("A", 5), ("B", 4), ("C", 0)], "country string, n bigint")
    assert rows(rollups.underrepresented_countries(base, test), "country", "test") == [("B", 4), ("C", 0), ("D", 0)]


@pytest.mark.parametrize(
    ("counts", "head"),
    [([70, 20, 10], 2), ([50, 20, 15, 15], 0), ([30, 20, 20, 15, 15], 0), ([90, 10], 1), ([20, 20, 20, 20, 20], 0), ([40, 30, 25, 5], 3)],
)
def test_cumulative_cliff(spark, counts, head):
    df = frame(spark, [("d", 1000 + i, n) for i, n in enumerate(counts)], "domain string, ip bigint, n bigint")
    got = rows(ranking.cumulative_cliff(df, "domain", "ip", "n"), "rank", "ip")
    assert got == [(i + 1, 1000 + i) for i in range(head)]


def test_row_numbers_over_many_slices(spark):
    rng = random.Random(9)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), s) for s in rng.sample(range(100000), 500)]
    df = frame(spark, data, "k string, seq bigint")
    got = ranking.row_numbers(df, "seq", ["k"], slices=9).collect()
    want = {}
    for k, s in sorted(data, key=lambda t: t[1]):
        want.setdefault(k, []).append(s)
    assert {(r.k, r.seq, r.rn) for r in got} == {(k, s, i + 1) for k, ss in want.items() for i, s in enumerate(ss)}
    assert len(got) == 500
    overall = ranking.row_numbers(df, "seq", slices=7).collect()
    assert sorted(r.rn for r in overall) == list(range(1, 501))
    assert [r.seq for r in sorted(overall, key=lambda r: r.rn)] == sorted(s for _, s in data)


def test_top_k_and_most_frequent_ties(spark):
    df = frame(spark, [("a", 3, 5), ("a", 1, 5), ("a", 2, 9), ("b", 9, 1)], "g string, v bigint, n bigint")
    assert rows(ranking.top_k_by_weight(df, ["g"], "v", "n", 2), "g", "rank", "v") == [("a", 1, 2), ("a", 2, 1), ("b", 1, 9)]
    seen = frame(spark, [("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")], "g string, v string")
    assert rows(ranking.most_frequent(seen, ["g"], "v"), "g", "v", "n") == [("a", "x", 2), ("b", "z", 1)]


def test_signatures_count_empty_answers(spark):
    obs = frame(spark, [("a", 1, None, 80), ("a", 1, 2560, 20), ("b", 1, 2560, 9), ("b", None, 7, 500)], OBS)
    prefixes = frame(spark, [(0, 16, 50)], PREFIXES)
    ptrs = frame(spark, [(2560, ["h.cdn.net"])], "ip bigint, names array<string>")
    servers = frame(spark, [(2560, 200, "edge")], "ip bigint, status int, server string")
    got = interference.domain_signatures(obs, prefixes, ptrs, servers)
    assert sorted((r.domain, r.method, r.value) for r in got.collect()) == [
        ("a", "IP", ["empty"]), ("b", "ASN", ["50"]), ("b", "IP", ["0.0.10.0"]), ("b", "PTR", ["cdn"]), ("b", "SERVER", ["edge"])
    ]


@pytest.mark.parametrize(("good", "found"), [(5, True), (6, False)])
def test_country_anomaly_needs_a_quarter(spark, good, found):
    sig = frame(spark, [("a", "IP", ["0.0.10.0"])], "domain string, method string, value array<string>")
    obs = frame(spark, [("a", 1, 2560, good), ("a", 1, 9999, 21 - good), ("a", 1, None, 50)], OBS)
    empty = frame(spark, [], PREFIXES)
    ptrs = frame(spark, [], "ip bigint, names array<string>")
    servers = frame(spark, [], "ip bigint, status int, server string")
    listed = frame(spark, [(1, "AA")], COUNTRY)
    got = interference.country_anomalies(obs, listed, sig, empty, ptrs, servers).collect()
    assert bool(got) == found
    if found:
        check = got[0].checks[0]
        assert (got[0].total, check.good, check.top, check.top_n) == (21, 5, "0.0.39.15", 16)
    fewer = obs.filter("answer_ip <> 9999").unionByName(frame(spark, [("a", 1, 9999, 20 - good)], OBS))
    assert not interference.country_anomalies(fewer, listed, sig, empty, ptrs, servers).collect()


def test_drop_ubiquitous(spark):
    found = [(c, "x") for c in "ABC"] + [(c, "y") for c in "AD"]
    df = frame(spark, found, "country string, domain string")
    assert rows(interference.drop_ubiquitous_anomalies(df), "country", "domain") == [("A", "y"), ("D", "y")]
    summary = rows(interference.anomaly_summary(df), "country", "anomalies", "kept", "dropped_domains")
    assert summary == [("A", 2, 1, 1), ("B", 1, 0, 1), ("C", 1, 0, 1), ("D", 1, 1, 1)]


def test_underflow(spark):
    data = []
    for d, n, m in (("a", 1, 9), ("b", 8, 2), ("c", 6, 4)):
        data += [(d, 1, 5, n), (d, 1, None, m)]
    names = frame(spark, [(d,) for d in "abc"], "domain string")
    found = lambda names: interference.resolution_underflow(
        frame(spark, data, OBS), frame(spark, [(1, "AA")], COUNTRY), names
    )
    got = rows(found(names), "country", "domain", "answered", "empty", "average")
    assert got == [("AA", "a", 1, 9, 10.0)]
    silent = names.unionByName(frame(spark, [(f"silent{i}",) for i in range(27)], "domain string"))
    assert rows(found(silent), "country", "domain") == []


@pytest.mark.parametrize(("tops", "kept"), [("aaabcd", True), ("aaaabc", False)])
def test_block_page_ips_counts_related_pairs(spark, tops, kept):
    obs, candidates = [], []
    for i, top in enumerate(tops):
        obs += [(f"d{i}", 1, ord(top), 10), (f"d{i}", 1, 7, 1)]
        candidates.append(("AA", 7, f"d{i}"))
    got = interference.block_page_ips(frame(spark, candidates, "country string, ip bigint, domain string"), frame(spark, obs, OBS))
    assert rows(got, "ip", "domains") == ([(7, 6)] if kept else [])


def test_block_page_candidates_skip_foreign_hosts(spark):
    page, abroad, reserved = ip("60.0.0.1"), ip("61.0.0.1"), ip("10.0.0.1")
    obs = []
    for d, odd in (("a", page), ("b", abroad), ("c", reserved)):
        obs += [(d, 1, odd, 10), (d, 2, ip("62.0.0.1"), 90)]
    prefixes = frame(spark, [(ip("60.0.0.0"), 16, 1), (ip("61.0.0.0"), 16, 2)], PREFIXES)
    listed = frame(spark, [(1, "AA"), (2, "BB")], COUNTRY)
    got = interference.block_page_candidates(frame(spark, obs, OBS), prefixes, listed)
    assert rows(got.filter("country = 'AA'"), "ip", "domain") == sorted([(page, "a"), (reserved, "c")])


def test_block_page_candidates_with_huge_counts(spark):
    obs = frame(spark, [("a", 1, 7, 10**12), ("a", 2, 8, 10**15)], OBS)
    none = frame(spark, [], PREFIXES)
    got = interference.block_page_candidates(obs, none, frame(spark, [(1, "AA"), (2, "BB")], COUNTRY))
    assert rows(got, "country", "ip") == [("AA", 7)]


def test_local_resolutions(spark):
    obs = frame(spark, [("a", 1, ip("10.0.0.1"), 2), ("a", 1, 99999999, 7), ("b", 1, ip("10.0.0.1"), 1), ("b", 1, 99999999, 4), ("c", 1, None, 9)], OBS)
    got = interference.local_resolutions(obs, frame(spark, [(1, "AA"), (1, "AA")], COUNTRY), "AA")
    assert rows(got, "domain", "public", "reserved") == [("a", 7, 2)]


def test_diversity_outlier(spark):
    data = []
    for asn in range(20):
        data += [("a", asn, 65536 * 7 + i, 1) for i in range(20)]
    data += [("a", 99, 65536 * i + 9, 1) for i in range(30)]
    prefixes = frame(spark, [(65536 * i, 16, i + 1) for i in range(30)], PREFIXES)
    got = interference.asn_diversity_outliers(frame(spark, data, OBS), prefixes)
    assert [(r.domain, r.resolver_asn, r.total, r.ratio) for r in got.collect()] == [("a", 99, 30, 30.0)]


def test_threshold_expression_rejects_code(spark):
    df = frame(spark, [(4, 8)], "n bigint, m bigint")
    assert df.select(scoring.user_threshold_expression("n / 2 + m * 0.5")).first()[0] == 6.0
    for text in ("n; drop", "sqrt(n)", "x", "", "nm", "n.m", "'a'"):
        with pytest.raises(ValueError):
            scoring.user_threshold_expression(text)


def test_score_with_diversity(spark):
    counts = frame(spark, [("a", 1, 1), ("a", 2, 7)], "domain string, ip bigint, n bigint")
    scores = frame(spark, [("a", 1, 0.0)], "domain string, ip bigint, score double")
    got = scoring.score_with_diversity(counts, scores).collect()
    assert [(r.ip, round(r.score, 6)) for r in got] == [(1, 0.75)]


def test_score_asn_domains_drops_unscored(spark):
    counts = frame(spark, [(1, "a", 5, 3), (1, "a", 6, 1), (1, "a", None, 9), (1, "b", 7, 1), (2, "a", 5, 1)], "resolver_asn bigint, domain string, answer_ip bigint, n bigint")
    scores = frame(spark, [("a", 5, 0.5), ("a", 6, 0.9)], "domain string, ip bigint, score double")
    got = scoring.score_asn_domains(counts, scores, 0.55).select("resolver_asn", "domain", "score", "total", "ip", "n")
    assert rows(got, "*") == [(2, "a", 0.5, 1, 5, 1)]
    got = scoring.score_asn_domains(counts, scores, 0.6)
    assert rows(got, "resolver_asn", "score", "total", "ip") == [(1, 0.6, 4, 5), (1, 0.6, 4, 6), (2, 0.5, 1, 5)]


def test_favicons(spark):
    fetched = frame(spark, [("a", 200, "h1", 1), ("a", 200, "h2", 2), ("b", 404, "x", 3)], "host string, status int, hash string, seq bigint")
    expected = validation.expected_favicons(fetched)
    assert rows(expected, "host", "hash") == [("a", "h2")]
    schema = "ip bigint, host string, seq bigint, status int, length bigint, hash string, ctype string"
    seen = frame(spark, [(1, "a", 1, 200, 5, "h2", "t"), (1, "b", 2, -1, None, None, None), (1, "a2", 3, 200, 5, "h9", "t"), (2, "a", 1, 200, 5, None, "t")], schema)
    assert rows(validation.favicon_match(seen, expected), "ip", "host", "matched") == [(1, "a", True), (2, "a", False)]
    carried = {(r.ip, r.host): r.status for r in validation.favicon_carry_forward(seen).collect()}
    assert carried == {(1, "a"): 200, (1, "b"): -1, (1, "a2"): -1, (2, "a"): 200}


def test_score_validation(spark):
    matches = frame(spark, [(1, "a", True), (2, "a", False), (3, "a", True), (4, "b", False), (5, "a", True)], "ip bigint, host string, matched boolean")
    scores = frame(spark, [("a", 1, 0.9), ("a", 2, 0.2), ("a", 3, 0.5), ("b", 4, 0.7), ("a", 5, 0.0)], "domain string, ip bigint, score double")
    per_domain, overall = validation.score_validation(matches, scores, 0.5)
    assert rows(per_domain, "domain", "n", "correct") == [("a", 3, 2), ("b", 1, 0)]
    assert overall.first()["accuracy"] == 0.5


def test_ip_list_diff_is_one_for_one(spark):
    a = frame(spark, [(1,), (1,), (2,)], "ip bigint")
    b = frame(spark, [(1,), (3,)], "ip bigint")
    diff = setops.ip_list_diff(a, b)
    assert rows(diff, "side", "ip", "n") == [("a-b", 1, 1), ("a-b", 2, 1), ("b-a", 3, 1), ("both", 1, 1)]


def test_ip_list_diff_by_asn_covers_the_tail(spark):
    prefixes = frame(spark, [(0, 24, 5), (256, 24, 6)], PREFIXES)
    diff = setops.ip_list_diff_by_asn(frame(spark, [(1,), (300,)], "ip bigint"), frame(spark, [(1,)], "ip bigint"), prefixes)
    assert rows(diff, "asn", "ip", "side") == [(5, 1, "both"), (6, 300, "a-b")]


def test_http_scan_stats(spark):
    scans = frame(spark, [(80, "s", 1), (80, "s", 1), (80, "a", 1), (80, "a", 2), (443, "s", 300)], "port int, mode string, ip bigint")
    prefixes = frame(spark, [(0, 24, 5)], PREFIXES)
    got = rollups.http_scan_stats(scans, prefixes, [((80, "s"), (80, "a"))])
    assert rows(got, "asn", "pair", "only_first", "both", "only_second") == [(5, "80-s/80-a", 1, 1, 1)]


def test_domain_lists(spark):
    ranked = frame(spark, [(3, "c"), (1, "a"), (2, "b")], "rank bigint, domain string")
    extra = frame(spark, [("x",), ("a",)], "domain string")
    hosts = frame(spark, [("h",)], "host string")
    assert sorted(r[0] for r in setops.append_domains(ranked, extra, hosts, top=2).collect()) == ["a", "a", "b", "h", "x"]
    listed = frame(spark, [(i, f"d{i}/path" if i % 2 else f"d{i}") for i in range(23)] + [(99, ""), (100, None)], "rank bigint, domain string")
    shards = setops.shard_domains(listed, 10)
    import hashlib

    want = []
    names = [f"d{i}" for i in range(23)]
    for lo in range(0, 23, 10):
        part = names[lo : lo + 10]
        name = hashlib.md5(",".join(part).encode()).hexdigest()
        want += [(name, j, d) for j, d in enumerate(part)]
    assert rows(shards, "shard", "idx", "domain") == sorted(want)


def test_signature_type_counts(spark):
    domains = frame(spark, [("a",), ("b",), ("c",)], "domain string")
    sig = frame(spark, [("a", "IP"), ("a", "ASN"), ("b", "IP")], "domain string, method string")
    assert rows(rollups.signature_type_counts(domains, sig), "method", "domains") == [("ASN", 1), ("IP", 2), ("UNKNOWN", 1)]
