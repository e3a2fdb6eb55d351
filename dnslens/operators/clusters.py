"""Clusters of domains, the networks they live on, and their metadata."""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import country_of_asn, lpm_join
from .pairs import Tiling, neighbour_mass
from .ranking import heaviest, row_numbers

# Fixed value: probabilities are clipped this far from 0 and 1 before taking log odds.
CLIP = 1e-6
_ABSENT = log(CLIP / (1 - CLIP))

VOTE_BATCH = 1024
"""Domains of a component that VOTE replays in one task."""


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("domain"), F.col("b").alias("peer")).unionByName(
        edges.select(F.col("b").alias("domain"), F.col("a").alias("peer"))
    )


def connected_components(domains: DataFrame, edges: DataFrame) -> DataFrame:
    """``domain, component`` (the smallest member), by min-label rounds with label jumps."""
    links = materialize(_both_ways(edges), "links")
    state = materialize(
        domains.select("domain", F.col("domain").alias("component")).distinct(), "components"
    )
    while True:
        peers = state.select(F.col("domain").alias("peer"), F.col("component").alias("seen"))
        best = links.join(peers, "peer").groupBy("domain").agg(F.min("seen").alias("seen"))
        jump = state.select(F.col("domain").alias("component"), F.col("component").alias("jumped"))
        lower = F.least("component", F.coalesce("seen", "component"), F.coalesce("jumped", "component"))
        step = (
            state.join(best, "domain", "left")
            .join(jump, "component", "left")
            .select("domain", lower.alias("component"), (lower < F.col("component")).alias("moved"))
        )
        step = materialize(step, "components")
        state = step.select("domain", "component")
        if not step.filter("moved").take(1):
            return state


def _replay(rows: pa.Table) -> pa.Table:
    """VOTE over one batch of a component, given what earlier batches weigh on it.

    ``rows`` are of four kinds: members of the batch, gains between two of them, gains of a member with a
    cluster of earlier batches, and the sizes of those clusters. A gain is the log odds of a
    pair over those of a pair without similarity, so a cluster draws by its gains and its size.
    """
    kind = np.array(rows["kind"].to_pylist(), dtype=object)
    d, peer, value = (np.array(rows[c].to_pylist(), dtype=object) for c in ("domain", "peer", "value"))
    near: dict[str, list[tuple[str, float]]] = {}
    drawn: dict[str, dict[str, float]] = {}
    for at in np.flatnonzero(kind == "inside"):
        near.setdefault(d[at], []).append((peer[at], value[at]))
    for at in np.flatnonzero(kind == "cluster"):
        drawn.setdefault(d[at], {})[peer[at]] = value[at]
    size = {peer[at]: value[at] for at in np.flatnonzero(kind == "size")}
    leader: dict[str, str] = {}
    for name in sorted(d[kind == "member"]):
        gains = dict(drawn.get(name, {}))
        for other, gain in near.get(name, ()):
            gains[leader[other]] = gains.get(leader[other], 0.0) + gain
        pulls = {c: round(gain + _ABSENT * size.get(c, 0.0), 9) for c, gain in gains.items()}
        best = min(pulls, key=lambda c: (-pulls[c], c), default=None)
        leader[name] = best if best is not None and pulls[best] > 0 else name
        size[leader[name]] = size.get(leader[name], 0.0) + 1
    return pa.table({"domain": list(leader), "leader": list(leader.values())})


def vote_clusters(domains: DataFrame, sim: DataFrame, batch: int = VOTE_BATCH) -> DataFrame:
    """``domain, leader`` by VOTE in name order: a domain joins the cluster with the largest positive
    sum of log odds over all its members so far, the first made of equal ones, or else founds one.

    The members of a component of positive edges are numbered by name and cut into batches. Components
    never draw each other's domains, so each round replays one batch of every component; what earlier
    batches weigh on it is added up by domain and cluster before, and each pair of domains is
    used once. A task holds one batch: its domains, the pairs between them and the clusters that can
    still draw one of them. A cluster all of whose possible gains stay below zero is not among these.
    """
    sim = materialize(sim.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim"), "sim")
    state = connected_components(domains, sim.filter("sim > 0.5").select("a", "b"))
    turns = row_numbers(state, "domain", ["component"]).select(
        "domain", "component", F.floor((F.col("rn") - 1) / batch).alias("turn")
    )
    turns = materialize(turns, "turns")
    p = F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), F.col("sim")))
    earlier = turns.select(F.col("domain").alias("a"), F.col("component").alias("c"), F.col("turn").alias("earlier"))
    later = turns.select(F.col("domain").alias("b"), "component", "turn")
    pairs = sim.join(earlier, "a").join(later, "b").filter("c = component")
    pairs = pairs.select(
        "component", "turn", "earlier", F.col("b").alias("domain"), F.col("a").alias("peer"),
        (F.log(p / (1 - p)) - _ABSENT).alias("value"),
    )
    pairs = materialize(pairs, "pairs")
    last = turns.agg(F.max("turn").alias("turn")).first().turn
    done: list[DataFrame] = []
    for turn in range(0 if last is None else last + 1):
        now = pairs.filter(F.col("turn") == turn)
        inside = now.filter(F.col("earlier") == turn)
        parts = [
            turns.filter(F.col("turn") == turn).select(
                F.lit("member").alias("kind"), "component", "domain",
                F.lit(None).cast("string").alias("peer"), F.lit(None).cast("double").alias("value"),
            ),
            inside.select(F.lit("inside").alias("kind"), "component", "domain", "peer", "value"),
        ]
        if done:
            made = reduce(DataFrame.unionByName, done)
            sizes = made.groupBy("leader").agg(F.count(F.lit(1)).cast("double").alias("size"))
            joined = now.filter(F.col("earlier") < turn).join(made.withColumnRenamed("domain", "peer"), "peer")
            gains = joined.groupBy("component", "domain", "leader").agg(F.sum("value").alias("gain"))
            reach = inside.groupBy("domain").agg(F.sum("value").alias("reach"))
            best = F.col("gain") + F.coalesce("reach", F.lit(0.0)) + F.col("size") * _ABSENT
            drawing = gains.join(sizes, "leader").join(reach, "domain", "left").filter(best > -1e-6)
            drawing = materialize(drawing, "drawing")
            cluster = F.col("leader").alias("peer")
            parts.append(drawing.select(F.lit("cluster").alias("kind"), "component", "domain", cluster, F.col("gain").alias("value")))
            known = drawing.select("component", cluster, F.col("size").alias("value")).distinct()
            parts.append(known.select(F.lit("size").alias("kind"), "component", F.lit(None).cast("string").alias("domain"), "peer", "value"))
        replayed = reduce(DataFrame.unionByName, parts).groupBy("component").applyInArrow(_replay, "domain string, leader string")
        done.append(materialize(replayed, "voted"))
    if not done:
        return domains.select("domain", F.col("domain").alias("leader"))
    return reduce(DataFrame.unionByName, done)


def pivot_clusters(domains: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """``domain, leader`` by parallel pivoting over seeded hash priorities.

    A domain is a pivot once it precedes every linked domain still undecided; domains
    linked to a pivot follow it. This equals visiting the domains one by one in priority
    order, in about log(n) rounds.
    """
    prio = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), "domain")).alias("h"), F.col("domain").alias("d"))
    links = materialize(_both_ways(edges), "links")
    open_ = materialize(domains.select("domain", prio.alias("prio")).distinct(), "open")
    pivots = None
    while open_.take(1):
        peers = open_.select(F.col("domain").alias("peer"), F.col("prio").alias("peer_prio"))
        first = links.join(peers, "peer").groupBy("domain").agg(F.min("peer_prio").alias("first"))
        ahead = open_.join(first, "domain", "left").filter("first is null or prio < first")
        new = materialize(ahead.select("domain", "prio"), "pivots")
        pivots = new if pivots is None else pivots.unionByName(new)
        followers = links.join(new.select(F.col("domain").alias("peer")), "peer").select("domain")
        left = open_.join(new, "domain", "left_anti").join(followers, "domain", "left_anti")
        open_ = materialize(left, "open")
    if pivots is None:
        return domains.select("domain", F.col("domain").alias("leader"))
    lead = pivots.select(F.col("domain").alias("peer"), F.col("prio").alias("peer_prio"))
    follow = (
        links.join(lead, "peer")
        .groupBy("domain")
        .agg(F.min_by("peer", "peer_prio").alias("leader"))
        .join(pivots.select("domain"), "domain", "left_anti")
    )
    return pivots.select("domain", F.col("domain").alias("leader")).unionByName(follow)


def number_clusters(members: DataFrame) -> DataFrame:
    """``domain, leader`` to ``domain, cluster_id``: 0 is the largest, ties by first domain."""
    clusters = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("size"), F.min("domain").alias("first")
    )
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = clusters.groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    offsets = sizes.select("size", F.coalesce(F.sum("k").over(larger), F.lit(0)).alias("offset"))
    ids = row_numbers(clusters, "first", ["size"], out="pos").join(offsets, "size")
    ids = ids.select("leader", (F.col("offset") + F.col("pos") - 1).cast("int").alias("cluster_id"))
    return members.join(ids, "leader").select("domain", "cluster_id")


def correlation_cluster(
    domains: DataFrame, sim: DataFrame, method: str = "pivot", seed: int = 0
) -> DataFrame:
    """Correlation clustering: ``domain, cluster_id``. Every domain ends in one cluster.

    ``vote`` weighs all pairs by their log odds and visits domains by name. ``pivot`` (seeded) sees only
    which pairs are above 0.5, and needs no others in ``sim``; it takes fewer rounds. Both take any size.
    The caller chooses; sizes never do.
    """
    if method == "vote":
        members = vote_clusters(domains.select("domain").distinct(), sim)
    elif method == "pivot":
        attract = materialize(sim.filter("sim > 0.5").select("a", "b"), "attract")
        members = pivot_clusters(domains, attract, seed)
    else:
        raise ValueError(f"method is pivot or vote, not {method!r}")
    return number_clusters(materialize(members, "members"))


def domain_cluster_map(clusters: DataFrame) -> DataFrame:
    """Rows ``cluster_id, domains array`` to ``domain, cluster_id``."""
    return clusters.select(F.explode("domains").alias("domain"), "cluster_id")


_LIST = r"^\s*[\[,]\s*\[([\s\S]*)$"


def read_clusters(spark, path: str) -> DataFrame:
    """``[[domain, ...], ...]`` (position = id), formatted or not, to ``domain, cluster_id``.

    The file is cut at closing brackets, so that many tasks read it; text that doesn't parse is an error.
    """
    pieces = spark.read.text(path, lineSep="]").filter("value rlike '[^\\\\s]'")
    where = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    body = F.when(F.col("value").rlike(_LIST), F.concat(F.lit("["), F.regexp_extract("value", _LIST, 1), F.lit("]")))
    said = F.concat(F.lit("not a list of lists: "), F.substring("value", 1, 200))
    names = F.coalesce(F.from_json(body, "array<string>"), F.raise_error(said).cast("array<string>"))
    numbered = row_numbers(pieces.select(names.alias("domains"), where.alias("at")), "at")
    return domain_cluster_map(numbered.select("domains", (F.col("rn") - 1).cast("int").alias("cluster_id")))


def cluster_footprint_majority(
    net_domain: DataFrame, clusters: DataFrame, min_count: int = 50
) -> DataFrame:
    """Networks where more than half of a cluster's domains have over ``min_count`` answers."""
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    strong = net_domain.filter(F.col("n") > min_count).join(clusters, "domain")
    hits = strong.groupBy("cluster_id", "net").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "cluster_id").filter(2 * F.col("hits") > F.col("size")).select(
        "cluster_id", "net"
    )


def _best_cluster(weighted: DataFrame) -> DataFrame:
    best = weighted.groupBy("net").agg(heaviest("cluster_id", "weight").alias("best"))
    return best.select(F.col("best.value").alias("cluster_id"), "net", F.col("best.n").alias("weight"))


def cluster_footprint_max(net_domain: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every network goes to the cluster with most resolutions on it."""
    mass = net_domain.join(clusters, "domain").groupBy("net", "cluster_id").agg(
        F.sum("n").alias("weight")
    )
    return _best_cluster(mass).select("cluster_id", "net")


def cluster_footprint_similarity(
    net_domain: DataFrame, clusters: DataFrame, sim: DataFrame, tiling: Tiling = Tiling()
) -> DataFrame:
    """Every network goes to the cluster with the largest similarity mass on it.

    Each pair of domains on a network credits ``sim * min(counts)`` to the clusters of both,
    so a cluster's mass is the sum over its domains of what their neighbours contribute.
    """
    cells = net_domain.select("domain", F.col("net").alias("e"), F.col("n").cast("double").alias("y"))
    mass = neighbour_mass(cells, sim, "overlap", tiling).filter("num > 0")
    credit = mass.join(clusters, "domain").groupBy(F.col("e").alias("net"), "cluster_id").agg(
        F.round(F.sum("num"), 9).alias("weight")
    )
    return _best_cluster(credit)


def cluster_metadata_tag(footprint: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per cluster the commonest cleaned tag of its networks and its confidence.

    ``metadata`` holds ``net, names``; confidence is occurrences over networks and can pass
    1, since a network may carry several names.
    """
    from ..functions.text import clean_metadata_tag

    sizes = footprint.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    names = footprint.join(metadata, "net").select("cluster_id", F.explode("names").alias("name"))
    tags = names.select("cluster_id", clean_metadata_tag("name").alias("tag")).filter("tag is not null")
    counts = tags.groupBy("cluster_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("cluster_id").agg(heaviest("tag", "n").alias("top"))
    return top.join(sizes, "cluster_id").select(
        "cluster_id",
        F.col("top.value").alias("tag"),
        (F.col("top.n") / F.col("size")).alias("confidence"),
    )


def merge_clusters_on_metadata(
    clusters: DataFrame, tags: DataFrame, threshold: float = 0.8
) -> DataFrame:
    """Unite clusters that share a tag with confidence above ``threshold``."""
    sure = tags.filter(F.col("confidence") > threshold).select("cluster_id", "tag")
    target = sure.groupBy("tag").agg(F.min("cluster_id").alias("merged"))
    moved = sure.join(target, "tag").select("cluster_id", "merged")
    return clusters.join(moved, "cluster_id", "left").select(
        "domain", F.coalesce("merged", "cluster_id").alias("cluster_id")
    )


def confidence_histogram(tags: DataFrame, value: str = "confidence") -> DataFrame:
    """Log-linear histogram: decades split into nine equal steps; ``bucket`` is its lower end."""
    x = F.col(value)
    decade = F.floor(F.log10(x)).cast("double")
    base = F.pow(F.lit(10.0), decade)
    step = F.floor(F.round(x / base, 9))
    bucket = F.when(x > 0, F.round(step * base, 9)).otherwise(F.lit(0.0))
    return tags.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cluster_stats(
    clusters: DataFrame,
    scores: DataFrame,
    threshold,
    prefixes: DataFrame,
    asn_country: DataFrame,
) -> DataFrame:
    """Addresses of each cluster whose summed score passes a threshold.

    ``threshold`` is a column over ``n`` (scores on the address) and ``m`` (domains of the
    cluster), see ``scoring.user_threshold_expression``. One row per kept address with its
    ASN and country, so no cluster is gathered into a list.
    """
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
    per_ip = scores.join(clusters, "domain").groupBy("cluster_id", "ip").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")
    )
    kept = per_ip.join(sizes, "cluster_id").filter(F.col("score") > threshold)
    placed = country_of_asn(lpm_join(kept, prefixes, "ip", "asn"), asn_country)
    return placed.select("cluster_id", "ip", "score", "n", "m", "asn", "country")


def cluster_summary(stats: DataFrame) -> DataFrame:
    """Kept addresses, ASNs and countries per cluster."""
    return stats.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("ips"),
        F.count_distinct("asn").alias("asns"),
        F.count_distinct("country").alias("countries"),
    )
