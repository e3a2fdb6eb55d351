from __future__ import annotations

import hashlib
import json
import random
from math import log

import pytest

from dnslens.operators import clusters

SIM = "a string, b string, sim double"


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def random_graph(seed, n=30, p=0.08):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(n)]
    sim = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if rng.random() < p:
                sim[(a, b)] = 0.5 + rng.random() / 2
            elif rng.random() < 0.2:
                sim[(a, b)] = rng.random() / 2
    return names, sim


def domains_frame(spark, names):
    return frame(spark, [(n,) for n in names], "domain string")


def sim_frame(spark, sim):
    return frame(spark, [(a, b, s) for (a, b), s in sim.items()], SIM)


def groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(r.domain)
    return sorted(sorted(g) for g in out.values())


def sequential_vote(names, sim):
    def odds(a, b):
        p = min(max(sim.get((min(a, b), max(a, b)), 0), 1e-6), 1 - 1e-6)
        return log(p / (1 - p))

    made = []
    for d in sorted(names):
        pull = [sum(odds(d, m) for m in c) for c in made]
        if pull and max(pull) > 0:
            made[pull.index(max(pull))].append(d)
        else:
            made.append([d])
    return sorted(sorted(c) for c in made)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    names, sim = random_graph(seed, p=0.05)
    edges = {e for e, s in sim.items() if s > 0.5}
    label = {n: n for n in names}
    for _ in names:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = clusters.connected_components(
        domains_frame(spark, names), frame(spark, list(edges), "a string, b string")
    )
    assert {r.domain: r.component for r in got.collect()} == label


def test_components_of_a_long_chain(spark):
    names = [f"n{i:03}" for i in range(60)]
    rng = random.Random(0)
    shuffled = names[:]
    rng.shuffle(shuffled)
    edges = [(min(a, b), max(a, b)) for a, b in zip(shuffled, shuffled[1:])]
    got = clusters.connected_components(domains_frame(spark, names), frame(spark, edges, "a string, b string"))
    assert {r.component for r in got.collect()} == {"n000"}


@pytest.mark.parametrize("seed, batch", [(3, 1024), (4, 7), (5, 3)])
def test_vote_equals_a_global_run_whatever_the_batch(spark, monkeypatch, seed, batch):
    names, sim = random_graph(seed, n=40, p=0.15)
    df = domains_frame(spark, names)
    whole = clusters.vote_clusters
    monkeypatch.setattr(clusters, "vote_clusters", lambda d, s: whole(d, s, batch))
    got = clusters.correlation_cluster(df, sim_frame(spark, sim), "vote").collect()
    assert groups(got, "cluster_id") == sequential_vote(names, sim)
    sizes = {}
    for r in got:
        sizes.setdefault(r.cluster_id, []).append(r.domain)
    order = [(-len(m), min(m)) for _, m in sorted(sizes.items())]
    assert sorted(sizes) == list(range(len(sizes))) and order == sorted(order)


def test_vote_on_dense_components_and_either_order_of_pairs(spark):
    rng = random.Random(9)
    names = [f"n{i:03}" for i in range(60)]
    sim = {(a, b): 0.9 if i % 3 == j % 3 else rng.random() * 0.7 for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    turned = {(b, a) if i % 2 else (a, b): s for i, ((a, b), s) in enumerate(sim.items())}
    got = clusters.vote_clusters(domains_frame(spark, names), sim_frame(spark, turned), batch=16).collect()
    assert groups(got, "leader") == sequential_vote(names, sim)
    assert clusters.correlation_cluster(domains_frame(spark, ["x"]).filter("false"), sim_frame(spark, {("a", "b"): 1.0}), "vote").count() == 0


def test_vote_gathers_only_batches(spark):
    """With batches of 8 no task gets more than 8 domains, their pairs and the clusters they may join."""
    names, sim = random_graph(8, n=50, p=0.3)
    seen = spark.sparkContext.accumulator(0)
    replay = clusters._replay

    def counted(rows):
        seen.add(rows.num_rows > 8 + 28 + 8 * 51 + 51)
        return replay(rows)

    clusters._replay = counted
    try:
        got = clusters.vote_clusters(domains_frame(spark, names), sim_frame(spark, sim), batch=8).collect()
    finally:
        clusters._replay = replay
    assert groups(got, "leader") == sequential_vote(names, sim) and seen.value == 0


def test_pivot_rounds_equal_a_sequential_run(spark):
    names, sim = random_graph(6, n=40, p=0.12)
    edges = {e for e, s in sim.items() if s > 0.5}
    near = {n: set() for n in names}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    df = domains_frame(spark, names)
    prio = {n: hashlib.md5(f"5:{n}".encode()).hexdigest() for n in names}
    leader = {}
    for n in sorted(names, key=lambda n: (prio[n], n)):
        if n not in leader:
            leader[n] = n
            for m in near[n]:
                leader.setdefault(m, n)
    got = clusters.pivot_clusters(df, frame(spark, list(edges), "a string, b string"), seed=5)
    assert {r.domain: r.leader for r in got.collect()} == leader


def test_the_method_does_not_depend_on_the_size(spark):
    """A chain of 2,500 domains in one component gives the clusters of its pivots, as a short one does."""
    for n in (6, 2500):
        names = [f"n{i:04}" for i in range(n)]
        chain = {(a, b): 0.9 for a, b in zip(names, names[1:])}
        leader = {}
        for d in sorted(names, key=lambda d: (hashlib.md5(f"0:{d}".encode()).hexdigest(), d)):
            if d not in leader:
                at = names.index(d)
                for m in names[max(0, at - 1) : at + 2]:
                    leader.setdefault(m, d)
        got = clusters.correlation_cluster(domains_frame(spark, names), sim_frame(spark, chain)).collect()
        wanted = {}
        for d, m in leader.items():
            wanted.setdefault(m, set()).add(d)
        assert groups(got, "cluster_id") == sorted(sorted(g) for g in wanted.values())
    with pytest.raises(ValueError):
        clusters.correlation_cluster(domains_frame(spark, ["a"]), sim_frame(spark, {("a", "b"): 1.0}), "best")


def test_footprints(spark):
    members = frame(spark, [(d, 0) for d in "abcd"] + [("e", 1)], "domain string, cluster_id int")
    cells = [("a", 256, 60), ("b", 256, 60), ("c", 256, 50), ("e", 256, 500)]
    cells += [("a", 512, 51), ("b", 512, 51), ("d", 512, 51), ("e", 512, 50), ("x", 512, 9999)]
    df = frame(spark, cells, "domain string, net bigint, n bigint")
    majority = {(r.cluster_id, r.net) for r in clusters.cluster_footprint_majority(df, members).collect()}
    assert majority == {(1, 256), (0, 512)}
    best = {(r.cluster_id, r.net) for r in clusters.cluster_footprint_max(df, members).collect()}
    assert best == {(1, 256), (0, 512)}


def test_metadata_tags_and_merge(spark):
    footprint = frame(spark, [(0, 256), (0, 512), (1, 768)], "cluster_id int, net bigint")
    names = [(256, ["server1.cdn.net", "server2.cdn.net"]), (512, ["b.org"]), (768, ["www.cdn.net"])]
    tags = clusters.cluster_metadata_tag(footprint, frame(spark, names, "net bigint, names array<string>"))
    got = {(r.cluster_id, r.tag, r.confidence) for r in tags.collect()}
    assert got == {(0, "cdn.net", 1.0), (1, "www.cdn.net", 1.0)}
    four = frame(spark, [(0, "x", 0.9), (1, "x", 0.85), (2, "x", 0.5), (3, "y", 0.9)], "cluster_id int, tag string, confidence double")
    members = frame(spark, [(f"d{i}", i) for i in range(4)], "domain string, cluster_id int")
    merged = clusters.merge_clusters_on_metadata(members, four, 0.8)
    assert groups(merged.collect(), "cluster_id") == [["d0", "d1"], ["d2"], ["d3"]]


def test_confidence_histogram(spark):
    values = [0.0, 0.1, 0.3, 0.35, 0.999, 1.0, 1.5, 25.0]
    tags = frame(spark, [(v,) for v in values], "confidence double")
    got = {r.bucket: r.n for r in clusters.confidence_histogram(tags).collect()}
    assert got == {0.0: 1, 0.1: 1, 0.3: 2, 0.9: 1, 1.0: 2, 20.0: 1}


def test_cluster_files_and_stats(spark, tmp_path):
    path = tmp_path / "clusters.json"
    path.write_text('[["a","b"],["c"]]')
    members = clusters.read_clusters(spark, str(path))
    assert {(r.domain, r.cluster_id) for r in members.collect()} == {("a", 0), ("b", 0), ("c", 1)}
    many = [[f"c{i}d{j}" for j in range(i % 4)] for i in range(500)]
    formatted = tmp_path / "formatted.json"
    formatted.write_text(json.dumps(many, indent=2))
    assert {(r.domain, r.cluster_id) for r in clusters.read_clusters(spark, str(formatted)).collect()} == {
        (d, i) for i, c in enumerate(many) for d in c
    }
    formatted.write_text('[["a"],["b]"]]')
    with pytest.raises(Exception, match="not a list of lists"):
        clusters.read_clusters(spark, str(formatted)).collect()
    scores = frame(spark, [("a", 256, 1.0), ("b", 256, 0.5), ("a", 600, 0.4), ("c", 256, 3.0)], "domain string, ip bigint, score double")
    prefixes = frame(spark, [(0, 16, 7)], "network bigint, prefix_len int, asn bigint")
    listed = frame(spark, [(7, "AA")], "asn bigint, country string")
    from dnslens.operators.scoring import user_threshold_expression

    stats = clusters.cluster_stats(members, scores, user_threshold_expression("n / m"), prefixes, listed)
    assert sorted((r.cluster_id, r.ip, r.score, r.n, r.m, r.asn, r.country) for r in stats.collect()) == [
        (0, 256, 1.5, 2, 2, 7, "AA"), (1, 256, 3.0, 1, 1, 7, "AA")
    ]
    summary = clusters.cluster_summary(stats).orderBy("cluster_id").collect()
    assert [tuple(r) for r in summary] == [(0, 1, 1, 1), (1, 1, 1, 1)]
