"""The stages of a measurement run over its folder.

    python -m dnslens.plans.run <stage> <run folder>

A run folder holds the scans (``zmap/``), the resolver whitelist, the prefix and country
tables and the looked-up metadata; each stage adds its results as folders beside them.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from dnslens.operators import clusters, interference, rollups, scoring, similarity
from dnslens.session import materialize
from dnslens.sources import readers, sinks

MERGE_CONFIDENCE = 0.8
ROUNDS = 6


class Run:
    """Inputs and results of one run by their file names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def prefixes(self) -> DataFrame:
        return readers.read_prefix_map(self.spark, self.path("lookup.json"))

    def countries(self) -> DataFrame:
        return readers.read_country_asns(self.spark, self.path("countries.json"))

    def observations(self) -> DataFrame:
        return readers.read_observations(self.spark, self.path("asn.json"))

    def keyed(self, name: str, kind: str, **options) -> DataFrame:
        return readers.read_keyed_jsonlines(self.spark, self.path(name), kind, **options)

    def store(self, df: DataFrame, name: str) -> None:
        df.write.parquet(self.path(name))

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def aggregate(run: Run) -> None:
    """Scans to observations, and those to counts per address and per network."""
    shards = readers.read_shard_domains(run.spark, run.path("zmap"))
    whitelist = readers.read_resolver_list(run.spark, run.path("whitelist.json"), "json")
    scan = readers.read_domain_scan(run.spark, run.path("zmap"))
    counts = materialize(
        rollups.aggregate_listed_responses(scan, shards, run.prefixes(), whitelist), "counts"
    )
    sinks.write_observations(
        rollups.observations_of(counts), rollups.failures_of(counts), shards, run.path("asn.json")
    )
    obs = rollups.observations_of(counts)
    run.store(rollups.ip_domain_counts(obs), "ip-domain")
    run.store(rollups.network_domain_counts(obs), "net-domain")


def list_addresses(run: Run) -> None:
    """All answer addresses, one ``ip/32`` line each, to be looked up elsewhere."""
    ips = readers.distinct_keys(run.stored("ip-domain"), "ip")
    sinks.write_resolver_list(ips, run.path("all-ips"))


def group_domains(run: Run) -> None:
    """Similarity, clusters with their networks, merged clusters, answer scores, country flow."""
    cells = run.stored("net-domain")
    rounds = list(similarity.similarity_rounds(cells, ROUNDS))
    sim, weights = rounds[-1]
    run.store(sim, "similarity")
    run.store(weights, "weights")
    # Clusters come from the similarity before the last reweighting.
    members = clusters.correlation_cluster(cells.select("domain").distinct(), rounds[-2][0])
    run.store(members, "clusters")
    members = run.stored("clusters")
    run.store(clusters.cluster_footprint_majority(cells, members), "footprint")
    names = run.keyed("ptrs.json", "ptrs", by_network=True)
    tags = clusters.cluster_metadata_tag(run.stored("footprint"), names)
    run.store(clusters.merge_clusters_on_metadata(members, tags, MERGE_CONFIDENCE), "clusters-merged")
    run.store(scoring.score_resolutions(run.stored("ip-domain"), run.stored("similarity")), "scores")
    flow = rollups.country_flow(run.observations(), run.prefixes(), run.countries())
    run.store(flow, "country-country")


def find_anomalies(run: Run) -> None:
    """Signatures, anomalies without the domains odd everywhere, block pages, underflow."""
    obs = materialize(run.observations(), "observations")
    prefixes, countries = run.prefixes(), run.countries()
    ptrs, servers = run.keyed("ptrs.json", "ptrs"), run.keyed("serverheaders.json", "servers")
    run.store(interference.domain_signatures(obs, prefixes, ptrs, servers), "signatures")
    found = interference.country_anomalies(
        obs, countries, run.stored("signatures"), prefixes, ptrs, servers
    )
    found = materialize(found, "anomalies")
    interference.drop_ubiquitous_anomalies(found).write.json(run.path("anomalies.json"))
    candidates = interference.block_page_candidates(obs, prefixes, countries)
    run.store(interference.block_page_ips(candidates, obs), "block-pages")
    domains = readers.read_shard_domains(run.spark, run.path("zmap"))
    run.store(interference.resolution_underflow(obs, countries, domains), "underflow")


STAGES = {
    "aggregate": aggregate,
    "list-addresses": list_addresses,
    "group-domains": group_domains,
    "find-anomalies": find_anomalies,
}


def main(argv: list[str]) -> int:
    if len(argv) != 2 or argv[0] not in STAGES:
        print(f"usage: run {{{','.join(STAGES)}}} <run folder>", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"dnslens {argv[0]}").getOrCreate()
    STAGES[argv[0]](Run(spark, argv[1]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
