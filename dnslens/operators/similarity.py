"""Cosine similarity of domains over networks, with iterative reweighting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import is_reserved
from ..session import materialize
from .pairs import TILE, Tile, Tiling, deal, neighbour_mass, pair_dots

_MARGIN = 1e-9  # room for rounding in bounds
_MOVED = 1e-12  # a similarity that changes by a smaller part of it has settled

def domain_norms(net_domain: DataFrame) -> DataFrame:
    """Length of each domain's count vector, stored: one small row per domain.

    Read back with its true size, it joins the far larger pair table without a shuffle
    as long as it fits the planner's broadcast threshold.
    """
    square = F.col("n").cast("double") * F.col("n")
    norms = net_domain.groupBy("domain").agg(F.sqrt(F.sum(square)).alias("norm"))
    return materialize(norms, "norms")


def _weighted(net_domain: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Cells ``domain, e, y`` that count for similarity: ``n * (1 + w)``, without reserved networks and zeros."""
    weighted = net_domain
    if weights is None:
        weighted = weighted.withColumn("w", F.lit(0.0))
    else:
        weighted = weighted.join(weights.select("domain", "net", "w"), ["domain", "net"], "left")
    weight = F.coalesce("w", F.lit(0.0))
    return (
        weighted.filter(~is_reserved("net"))
        .select("domain", F.col("net").alias("e"), (F.col("n") * (1 + weight)).alias("y"))
        .filter("y <> 0")
    )


def domain_similarity(
    net_domain: DataFrame,
    weights: DataFrame | None = None,
    tiling: Tiling = Tiling(),
    norms: DataFrame | None = None,
) -> DataFrame:
    """Similarity of domains as ``a, b, sim`` with a < b; pairs not listed have 0.

    A cell counts as ``n * (1 + w)``; without weights ``w`` is 0. Reserved networks always
    have weight -1, so they add nothing, but they still count in a domain's norm.
    """
    return _listed(pair_dots(_scaled(net_domain, weights, norms), tiling)).select("a", "b", "sim")


def _listed(dots: DataFrame) -> DataFrame:
    return dots.withColumn("sim", F.least(F.lit(1.0), "dot"))


def _scaled(net_domain: DataFrame, weights: DataFrame | None, norms: DataFrame | None) -> DataFrame:
    """Cells over the length of their domain's counts, so that sums of products are similarities."""
    scaled = _weighted(net_domain, weights).join(norms or domain_norms(net_domain), "domain")
    return scaled.select("domain", "e", (F.col("y") / F.col("norm")).alias("y"))


def _indexed(cells: DataFrame, above: float) -> DataFrame:
    """Cells ``domain, e, y, indexed, rest`` split by what a domain's commonest networks can reach.

    Networks are put in one order for all domains, the ones with most domains first. From there on, a
    domain's cells stay out of the index as long as the similarity they could give with *any* other
    domain is not above the threshold: at most the sum of ``y`` times the largest value on each network, and at
    most the length of those cells times the longest vector of all (lengths pass 1, as weights count
    in ``y`` but not in the norm). ``rest`` is that bound. Two domains above the threshold share a network that
    is indexed for both: were their least common shared network out of one's index, so were all.
    """
    networks = cells.groupBy("e").agg(F.count(F.lit(1)).alias("degree"), F.max("y").alias("top"))
    lengths = cells.groupBy("domain").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    longest = lengths.agg(F.max("length").alias("longest")).first().longest or 0.0
    commonest = Window.partitionBy("domain").orderBy(F.desc("degree"), "e")
    by_network = F.sum(F.col("y") * F.col("top")).over(commonest)
    by_length = F.sqrt(F.sum(F.col("y") * F.col("y")).over(commonest)) * longest
    bounded = cells.join(networks, "e").withColumn("bound", F.least(by_network, by_length))
    return bounded.select("domain", "e", "y", "bound", (F.col("bound") > above - _MARGIN).alias("indexed"))


def similar_pairs(
    net_domain: DataFrame,
    above: float = 0.5,
    weights: DataFrame | None = None,
    tiling: Tiling = Tiling(),
    norms: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``domain_similarity`` with ``sim > above`` (above 0), without making the others.

    Pairs meet on indexed cells only (see ``_indexed``); popular networks are indexed for hardly any domain. A
    pair's sum over them plus what either domain has outside its index bounds its similarity, and the
    pairs that can still pass are added up in full, from the domain with fewer cells.
    """
    if not above > 0:
        raise ValueError("a threshold above 0 is needed; domain_similarity lists all pairs")
    scaled = materialize(_scaled(net_domain, weights, norms), "scaled")
    split = materialize(_indexed(scaled, above), "indexed")
    met = materialize(split.filter("indexed").select("domain", "e", "y"), "index")
    outside = split.groupBy("domain").agg(
        F.coalesce(F.max(F.when(~F.col("indexed"), F.col("bound"))), F.lit(0.0)).alias("rest"),
        F.count(F.lit(1)).alias("cells"),
    )
    outside = materialize(outside, "outside")
    left, right = (
        outside.select(F.col("domain").alias(d), F.col("rest").alias(f"rest_{d}"), F.col("cells").alias(f"n_{d}"))
        for d in "ab"
    )
    can_pass = F.col("dot") + F.col("rest_a") + F.col("rest_b") > above - _MARGIN
    pairs = pair_dots(met, tiling).join(left, "a").join(right, "b").filter(can_pass)
    fewer = F.col("n_a") <= F.col("n_b")
    asked = pairs.select(
        "a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("z")
    )
    mine = scaled.select(F.col("domain").alias("x"), "e", F.col("y").alias("yx"))
    theirs = scaled.select(F.col("domain").alias("z"), "e", F.col("y").alias("yz"))
    dots = asked.join(mine, "x").join(theirs, ["z", "e"]).groupBy("a", "b").agg(F.sum(F.col("yx") * F.col("yz")).alias("dot"))
    return _listed(dots).select("a", "b", "sim").filter(F.col("sim") > above)


def _reweighted(net_domain: DataFrame, mass: DataFrame) -> DataFrame:
    """Weights of all cells from what their neighbours add up to, ``domain, e, num``."""
    reserved = net_domain.filter(is_reserved("net")).select("domain", "net", F.lit(-1.0).alias("w"))
    public = net_domain.filter(~is_reserved("net"))
    mass = mass.select("domain", F.col("e").alias("net"), "num")
    totals = public.groupBy("net").agg(F.sum("n").alias("total"))
    others = F.col("total") - F.col("n")
    weight = F.when(others > 0, 2 * F.coalesce("num", F.lit(0.0)) / others - 1).otherwise(F.lit(0.0))
    scored = (
        public.join(totals, "net")
        .join(mass, ["domain", "net"], "left")
        .select("domain", "net", weight.alias("w"))
    )
    return scored.unionByName(reserved)


def reweight_networks(
    net_domain: DataFrame, sim: DataFrame, tiling: Tiling = Tiling()
) -> DataFrame:
    """Weight in [-1, 1] of each cell: how similar the other domains on its network are.

    Twice the count-weighted mean similarity minus one; 0 where a domain is alone.
    """
    public = net_domain.filter(~is_reserved("net"))
    cells = public.select("domain", F.col("net").alias("e"), F.col("n").cast("double").alias("y"))
    return _reweighted(net_domain, neighbour_mass(cells, sim, "product", tiling))


_PARTS = "pack bigint, lo int, hi int, a string, b string, part double, shared bigint, old double"


def _parts(tile: Tile, x: np.ndarray, sims: pa.Table | None) -> pa.Table:
    """The tile's part of each pair's dot product, with the similarity of the pair before."""
    product = x[tile.at] * x[tile.to]
    met, (part, shared) = tile.sums(product, product != 0)
    old = np.full(len(met), np.nan)
    if sims is not None:
        old[np.searchsorted(met, tile.pair)] = tile.similarity(sims)
    return pa.table(tile.named(met) | {"part": part, "shared": shared.astype(np.int64), "old": old})


def _first_parts(cells: pa.Table) -> pa.Table:
    tile = Tile(cells)
    return _parts(tile, tile.column(cells, "x"), None)


def _whole_round(cells: pa.Table, sims: pa.Table) -> pa.Table:
    """A round of a tile of whole entities: weights of its cells, then the parts they give.

    All domains of an entity are here, so its weights need no other tile. If no similarity in the
    tile has moved, neither would its parts.
    """
    if not sims["moved"].to_numpy(zero_copy_only=False).any():
        kept = sims.select([*TILE, "a", "b", "part", "shared"])
        return kept.append_column("old", sims["sim"])
    tile = Tile(cells)
    n, x = tile.column(cells, "n"), tile.column(cells, "x")
    near = tile.neighbours(tile.similarity(sims), n)
    others = np.bincount(tile.ent, n)[tile.ent] - n
    weight = 2 * near / others - 1
    return _parts(tile, x * (1 + weight), sims)


def _block_mass(cells: pa.Table, sims: pa.Table) -> pa.Table:
    tile = Tile(cells)
    return tile.cells(num=tile.neighbours(tile.similarity(sims), tile.column(cells, "n")))


def _block_round(cells: pa.Table, sims: pa.Table) -> pa.Table:
    tile = Tile(cells)
    return _parts(tile, tile.column(cells, "x"), sims)


class _Rounds:
    """Similarity rounds over cells that are dealt once.

    The state is one row for each pair of domains in each tile where they meet: the tile's part of the dot
    product, and the pair's similarity. A round is: tiles make new parts from their cells and
    similarities; parts are added up by pair, which gives each row its new similarity. So
    similarities come to the tiles that need them, and nothing is joined.
    """

    def __init__(self, net_domain: DataFrame, tiling: Tiling):
        self.cells = materialize(net_domain.select("domain", "net", "n"), "cells")
        count = F.col("n").cast("double")
        public = self.cells.filter(~is_reserved("net")).join(domain_norms(self.cells), "domain")
        public = public.select("domain", F.col("net").alias("e"), count.alias("n"), (count / F.col("norm")).alias("x"))
        self.dealt = materialize(deal(public, tiling), "dealt")
        self.whole = self.dealt.filter("lo < 0")
        self.cut = self.dealt.filter("lo >= 0")
        self.any_cut = bool(self.cut.take(1))
        self.state = self._settled(self.dealt.groupBy(*TILE).applyInArrow(_first_parts, _PARTS))

    def _settled(self, parts: DataFrame) -> DataFrame:
        pair = Window.partitionBy("a", "b")
        sim = F.least(F.lit(1.0), F.sum("part").over(pair))
        moved = F.col("old").isNull() | F.isnan("old") | (F.abs(F.col("sim") - F.col("old")) > _MOVED * F.col("old"))
        summed = parts.withColumn("sim", sim).withColumn("listed", F.sum("shared").over(pair) > 0)
        return materialize(summed.withColumn("moved", moved), "similarity")

    def similarity(self) -> DataFrame:
        return self.state.filter("listed").groupBy("a", "b").agg(F.max("sim").alias("sim"))

    def weights(self) -> DataFrame:
        """The weights of the next round; made when they are read."""
        mass = self._together(self.dealt, _block_mass, "domain string, e bigint, num double")
        return _reweighted(self.cells, mass.groupBy("domain", "e").agg(F.sum("num").alias("num")))

    def moved(self) -> int:
        """Pairs whose similarity is another one than a round before."""
        return self.state.filter("moved").select("a", "b").distinct().count()

    def _together(self, cells: DataFrame, step, columns: str) -> DataFrame:
        return cells.groupBy(*TILE).cogroup(self._state_of(cells).groupBy(*TILE)).applyInArrow(step, columns)

    def _state_of(self, cells: DataFrame) -> DataFrame:
        if cells is self.dealt:
            return self.state
        return self.state.filter("lo < 0" if cells is self.whole else "lo >= 0")

    def advance(self) -> None:
        parts = self._together(self.whole, _whole_round, _PARTS)
        if self.any_cut:
            near = self._together(self.cut, _block_mass, "domain string, e bigint, num double")
            near = near.groupBy("domain", "e").agg(F.sum("num").alias("num"))
            # Each cell once: of an entity's blocks, those tiles that hold one block alone.
            totals = self.cut.filter("lo = hi").groupBy("e").agg(F.sum("n").alias("total"))
            weighted = self.cut.join(near, ["domain", "e"]).join(totals, "e")
            weight = 2 * F.col("num") / (F.col("total") - F.col("n")) - 1
            weighted = weighted.withColumn("x", F.col("x") * (1 + weight)).select(*self.cut.columns)
            blocks = weighted.groupBy(*TILE).cogroup(self._state_of(self.cut).groupBy(*TILE))
            parts = parts.unionByName(blocks.applyInArrow(_block_round, _PARTS))
        self.state = self._settled(parts)


def similarity_rounds(
    net_domain: DataFrame, rounds: int = 6, tiling: Tiling = Tiling()
) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """The first similarity, then that of each round with the weights it was computed with.

    Every round is one job whose result is written to the shared folder, so the plan does
    not grow with rounds and a lost executor only repeats the current one. Tiles in which no
    similarity moved by more than a 1e-12th keep their sums; when none moved at all, the rounds
    that are left are the same as the last one.
    """
    state = _Rounds(net_domain, tiling)
    yield state.similarity(), None
    for r in range(rounds):
        weights = state.weights()
        if r == 0 or state.moved():
            state.advance()
        yield state.similarity(), weights


def iterate_similarity(
    net_domain: DataFrame, rounds: int = 6, tiling: Tiling = Tiling()
) -> tuple[DataFrame, DataFrame | None]:
    """The last of ``similarity_rounds``."""
    return list(similarity_rounds(net_domain, rounds, tiling))[-1]
