from __future__ import annotations

import random
import statistics
from collections import defaultdict
from math import sqrt

import pytest
from pyspark.sql import functions as F

from dnslens.operators import clusters, pairs, scoring, similarity

CELLS = "domain string, net bigint, n bigint"
SIM = "a string, b string, sim double"
TILINGS = [pairs.Tiling(), pairs.Tiling(4, 20), pairs.Tiling(9, 50)]


def random_cells(seed=1, domains=17, nets=40):
    rng = random.Random(seed)
    cells = {}
    for d in range(domains):
        for _ in range(rng.randrange(1, 12)):
            cells[(f"d{d:02}", 335544320 + 256 * rng.randrange(nets))] = rng.randrange(1, 30)
        cells[(f"d{d:02}", 335544320)] = rng.randrange(1, 9)  # one network all domains share
    return cells


def random_sim(cells, seed=2):
    rng = random.Random(seed)
    names = sorted({d for d, _ in cells})
    return {(a, b): rng.random() for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.6}


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def cells_frame(spark, cells):
    return frame(spark, [(d, e, n) for (d, e), n in cells.items()], CELLS)


def sim_frame(spark, sim):
    return frame(spark, [(a, b, s) for (a, b), s in sim.items()], SIM)


def on_net(cells):
    out = defaultdict(dict)
    for (d, e), n in cells.items():
        out[e][d] = n
    return out


@pytest.mark.parametrize("tiling", TILINGS)
def test_pair_dots_equal_brute_force(spark, tiling):
    cells = random_cells()
    want = defaultdict(lambda: [0.0, 0])
    for ds in on_net(cells).values():
        for a in ds:
            for b in ds:
                if a < b:
                    want[(a, b)][0] += ds[a] * ds[b]
                    want[(a, b)][1] += 1
    df = cells_frame(spark, cells).selectExpr("domain", "net as e", "cast(n as double) as y")
    got = {(r.a, r.b): [r.dot, r.shared] for r in pairs.pair_dots(df, tiling).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("tiling", TILINGS)
@pytest.mark.parametrize("kind", ["product", "overlap"])
def test_neighbour_mass_equals_brute_force(spark, tiling, kind):
    cells = random_cells()
    sim = random_sim(cells)
    want = {}
    for e, ds in on_net(cells).items():
        for a, n in ds.items():
            num = den = 0.0
            for b, m in ds.items():
                if a != b:
                    part = m if kind == "product" else min(n, m)
                    num += sim.get((min(a, b), max(a, b)), 0) * part
                    den += part
            want[(a, e)] = (num, den)
    df = cells_frame(spark, cells).selectExpr("domain", "net as e", "cast(n as double) as y")
    got = pairs.neighbour_mass(df, sim_frame(spark, sim), kind, tiling).collect()
    assert {(r.domain, r.e) for r in got} >= {key for key, (num, _) in want.items() if num > 0}
    for r in got:
        num, den = want[(r.domain, r.e)]
        assert r.num == pytest.approx(num)
        if kind == "overlap":
            assert r.den == pytest.approx(den)


def test_tiles_cost_much_the_same_beside_a_hot_network(spark):
    """3,000 domains, one network that all are on: its blocks and the packs of the others are of like cost."""
    cells = [(f"d{d:04}", 335544320, 1.0) for d in range(3000)]
    cells += [(f"d{d:04}", 335544320 + 256 * (1 + (d * 7 + j * 31) % 400), 1.0) for d in range(3000) for j in range(4)]
    df = frame(spark, list(set(cells)), "domain string, e bigint, y double")
    dealt = pairs.deal(df, pairs.Tiling(block=150, products=11000))
    cost = {}
    for r in dealt.groupBy(*pairs.TILE, "e").agg(F.count_if("second").alias("s"), F.count(F.lit(1)).alias("k")).collect():
        of = (r.k - r.s) * r.s if r.lo != r.hi else r.k * (r.k - 1) / 2
        cost[r.pack, r.lo, r.hi] = cost.get((r.pack, r.lo, r.hi), 0) + of
    assert len(cost) > 200 and sum(lo >= 0 for _, lo, _ in cost) == 20 * 21 / 2
    assert sum(cost.values()) == sum(k * (k - 1) / 2 for k in degrees(cells).values())
    assert max(cost.values()) < 3 * statistics.median(cost.values())


def degrees(cells):
    found = defaultdict(set)
    for d, e, _ in cells:
        found[e].add(d)
    return {e: len(ds) for e, ds in found.items()}


def rounds_by_force(cells, rounds):
    """Similarities after each round, every one from scratch."""
    norm = defaultdict(float)
    for (d, _), n in cells.items():
        norm[d] += n * n
    reserved = {e for _, e in cells if e >> 24 == 10}
    w = {c: -1.0 if c[1] in reserved else 0.0 for c in cells}
    out = []
    for _ in range(rounds + 1):
        sim = defaultdict(float)
        for e, ds in on_net(cells).items():
            for a in ds:
                for b in ds:
                    if a < b and w[a, e] > -1 and w[b, e] > -1:
                        sim[a, b] += ds[a] * (1 + w[a, e]) * ds[b] * (1 + w[b, e]) / sqrt(norm[a] * norm[b])
        sim = {pair: min(1.0, s) for pair, s in sim.items()}
        out.append(sim)
        for e, ds in on_net(cells).items():
            for a in ds:
                others = sum(n for d, n in ds.items() if d != a)
                near = sum(n * sim.get((min(a, b), max(a, b)), 0.0) for b, n in ds.items() if b != a)
                w[a, e] = -1.0 if e in reserved else 2 * near / others - 1 if others else 0.0
    return out


@pytest.mark.parametrize("tiling", TILINGS)
def test_rounds_equal_those_made_from_scratch(spark, tiling):
    cells = many_cells(6, 30)
    want = rounds_by_force(cells, 5)
    rounds = similarity.similarity_rounds(cells_frame(spark, cells), 5, tiling)
    for (sim, _), expected in zip(rounds, want, strict=True):
        got = {(r.a, r.b): r.sim for r in sim.collect()}
        assert {p: s for p, s in got.items() if s > 1e-9} == pytest.approx({p: s for p, s in expected.items() if s > 1e-9}, abs=1e-9)


def test_settled_similarities_end_the_rounds(spark, monkeypatch):
    """Two domains with the same counts settle at 1 at once; the rounds that are left make nothing."""
    made = []
    real = similarity._Rounds.advance
    monkeypatch.setattr(similarity._Rounds, "advance", lambda self: (made.append(1), real(self)))
    cells = frame(spark, [("a", 335544320, 3), ("b", 335544320, 3)], CELLS)
    rounds = list(similarity.similarity_rounds(cells, 6))
    assert len(rounds) == 7 and len(made) == 1
    assert [tuple(r) for r in rounds[-1][0].collect()] == [("a", "b", 1.0)]


HAND = [("A", 335544320, 3), ("A", 335544576, 4), ("B", 335544320, 3), ("C", 335544576, 1), ("C", 335544832, 1)]


def test_similarity_and_reweighting_by_hand(spark):
    cells = frame(spark, HAND, CELLS)
    sim = similarity.domain_similarity(cells)
    got = {(r.a, r.b): round(r.sim, 6) for r in sim.collect()}
    assert got == {("A", "B"): 0.6, ("A", "C"): 0.565685}
    weights = similarity.reweight_networks(cells, sim)
    w = {(r.domain, r.net): round(r.w, 6) for r in weights.collect()}
    assert w == {
        ("A", 335544320): 0.2, ("B", 335544320): 0.2, ("A", 335544576): 0.131371, ("C", 335544576): 0.131371, ("C", 335544832): 0.0,
    }
    again = similarity.domain_similarity(cells, weights)
    assert {(r.a, r.b): round(r.sim, 6) for r in again.collect()} == {("A", "B"): 0.864, ("A", "C"): 0.724077}


def many_cells(seed, domains=60):
    """Small groups on their own networks, a hoster, and two networks that everybody is on."""
    rng = random.Random(seed)
    cells = {}
    for d in range(domains):
        name = f"d{d:02}"
        for _ in range(rng.randrange(1, 20)):
            cells[(name, 335544320 + 256 * (d // 4 * 5 + rng.randrange(5)))] = rng.randrange(1, 30)
        cells[(name, 335544320 + 256 * (900 + d % 3))] = rng.randrange(1, 40) if d % 5 else 200
        cells[(name, 335544320 + 256 * (990 + d % 2))] = rng.randrange(1, 9)
        cells[(name, 10 * 2**24)] = rng.randrange(1, 9)
    return cells


@pytest.mark.parametrize("above", [0.5, 0.05, 0.99])
@pytest.mark.parametrize("reweighted", [False, True])
def test_similar_pairs_are_the_full_table_above_the_threshold(spark, above, reweighted):
    cells = many_cells(3)
    df = cells_frame(spark, cells)
    weights = None
    if reweighted:
        rng = random.Random(4)
        rows = [(d, e, -1.0 if e == 10 * 2**24 else rng.uniform(-1, 1)) for d, e in cells]
        weights = frame(spark, rows, "domain string, net bigint, w double")
    full = {(r.a, r.b): r.sim for r in similarity.domain_similarity(df, weights).collect()}
    got = {(r.a, r.b): r.sim for r in similarity.similar_pairs(df, above, weights, tiling=pairs.Tiling(5, 40)).collect()}
    assert got == pytest.approx({pair: s for pair, s in full.items() if s > above})
    assert got or above == 0.99


def test_pairs_below_the_threshold_are_not_added_up(spark):
    """All 400 domains meet on one network; only those of a group of four get as far as a sum."""
    cells = {(f"d{d:03}", 335544320): 1 for d in range(400)}
    cells |= {(f"d{d:03}", 335544320 + 256 * (1 + d // 4)): 20 for d in range(400)}
    split = similarity._indexed(similarity._scaled(cells_frame(spark, cells), None, None), 0.5)
    assert split.filter("indexed and e = 335544320").count() == 0
    got = similarity.similar_pairs(cells_frame(spark, cells)).collect()
    assert len(got) == 100 * 6
    with pytest.raises(ValueError):
        similarity.similar_pairs(cells_frame(spark, cells), 0.0)


def test_reserved_networks_count_in_the_norm_only(spark):
    ten = 10 * 2**24
    cells = frame(spark, [("A", ten, 3), ("A", 335544320, 4), ("B", ten, 5), ("B", 335544320, 1)], CELLS)
    sim = similarity.domain_similarity(cells)
    row = sim.first()
    assert row.sim == pytest.approx(4 / (5 * sqrt(26)))
    weights = {(r.domain, r.net): r.w for r in similarity.reweight_networks(cells, sim).collect()}
    assert weights[("A", ten)] == -1 and weights[("B", ten)] == -1


def test_iterations_stay_in_range(spark):
    cells = cells_frame(spark, random_cells(5))
    sim, weights = similarity.iterate_similarity(cells, 3)
    rows = sim.collect()
    assert rows and all(0 < r.sim <= 1 and r.a < r.b for r in rows)
    assert all(-1 <= r.w <= 1 for r in weights.collect())


def test_pair_lookup(spark):
    sim = frame(spark, [("a", "b", 0.5)], SIM)
    asked = frame(spark, [("b", "a"), ("a", "b"), ("a", "a"), ("a", "c")], "a string, b string")
    got = {(r.a, r.b): r.sim for r in pairs.pair_similarity_lookup(asked, sim).collect()}
    assert got == {("b", "a"): 0.5, ("a", "b"): 0.5, ("a", "a"): 1.0, ("a", "c"): 0.0}


@pytest.mark.parametrize("tiling", TILINGS)
def test_scores_equal_brute_force(spark, tiling):
    cells = random_cells(8)
    sim = random_sim(cells)
    by_ip = cells_frame(spark, cells).withColumnRenamed("net", "ip")
    want = {}
    for e, ds in on_net(cells).items():
        for a, n in ds.items():
            near = sum(m * (1 if a == b else sim.get((min(a, b), max(a, b)), 0)) for b, m in ds.items())
            want[(a, e)] = near / sum(ds.values()) * n
    got = scoring.score_resolutions(by_ip, sim_frame(spark, sim), tiling).collect()
    assert {(r.domain, r.ip): pytest.approx(r.score) for r in got} == want


@pytest.mark.parametrize("tiling", TILINGS)
def test_asn_ip_scores_equal_brute_force(spark, tiling):
    cells = random_cells(11)
    sim = random_sim(cells)
    rng = random.Random(4)
    data = [(rng.choice([5, 2**32 - 2]), e, d, n) for (d, e), n in cells.items()]
    df = frame(spark, data, "resolver_asn bigint, answer_ip bigint, domain string, n bigint")
    groups = defaultdict(dict)
    for asn, e, d, n in data:
        groups[(asn, e)][d] = n
    want = {}
    for key, ds in groups.items():
        names = sorted(ds)
        overlaps = [(min(ds[a], ds[b]), sim.get((a, b), 0)) for i, a in enumerate(names) for b in names[i + 1 :]]
        den = sum(o for o, _ in overlaps)
        want[key] = (sum(o * s for o, s in overlaps) / den if den else None, sum(ds.values()), len(ds))
    got = scoring.score_asn_ips(df, sim_frame(spark, sim), 1.0, tiling).collect()
    assert {(r.resolver_asn, r.ip) for r in got} == set(want)
    for r in got:
        score, total, domains = want[(r.resolver_asn, r.ip)]
        assert r.score == (None if score is None else pytest.approx(score))
        assert (r.total, r.domains) == (total, domains)


@pytest.mark.parametrize("tiling", TILINGS)
def test_similarity_footprint_equals_brute_force(spark, tiling):
    cells = random_cells(13)
    sim = random_sim(cells)
    cluster = {d: i % 4 for i, d in enumerate(sorted({d for d, _ in cells}))}
    want = {}
    for e, ds in on_net(cells).items():
        mass = defaultdict(float)
        names = sorted(ds)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w = sim.get((a, b), 0) * min(ds[a], ds[b])
                mass[cluster[a]] += w
                mass[cluster[b]] += w
        top = max(mass.items(), key=lambda kv: (round(kv[1], 9), -kv[0]), default=(None, 0))
        if top[1] > 0:
            want[e] = (top[0], pytest.approx(top[1]))
    members = frame(spark, list(cluster.items()), "domain string, cluster_id int")
    got = clusters.cluster_footprint_similarity(cells_frame(spark, cells), members, sim_frame(spark, sim), tiling)
    assert {r.net: (r.cluster_id, r.weight) for r in got.collect()} == want
