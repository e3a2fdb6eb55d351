"""Domain-pair arithmetic without listing the pairs of a group.

Domains that share a network (or an address) interact pairwise, and a network of a large
host carries very many domains. Instead of joining the table to itself on the network, cells are
dealt to tiles by what their pairs cost. An entity (network, address) of few domains goes whole to a
tile that it shares with others, about as many as make a task's worth of pairs. The domains of
a crowded entity are cut into blocks, and any two blocks meet in a tile of their own. A task combines the
cells of a tile as arrays, and what leaves it is already summed.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TILE = ["pack", "lo", "hi"]
"""Key of a tile; ``lo`` is -1 for entities that are dealt whole."""

_KEY_COLUMNS = "pack bigint, lo int, hi int"


@dataclass(frozen=True)
class Tiling:
    """An entity with more domains than ``block`` is cut into blocks; others fill tiles of ``products`` pairs."""

    block: int = 1024
    products: int = 2_000_000


def deal(cells: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """Cells (``domain, e``, others are kept) with their tiles and ``second``, the side of a tile of two blocks.

    The degrees of the entities decide: light ones are packed by a hash, each at most a fraction of a tile, so
    tiles cost much the same; of a heavy one a cell is copied once for each block. An entity with a
    single domain has no pairs and goes nowhere.
    """
    degrees = materialize(cells.groupBy("e").agg(F.count(F.lit(1)).alias("degree")).filter("degree > 1"), "degrees")
    k = F.col("degree")
    light = k <= tiling.block
    cost = degrees.filter(light).agg(F.sum(k * (k - 1) / 2).alias("cost")).first().cost or 0
    packs = max(1, ceil(cost / tiling.products))
    blocks = F.ceil(k / tiling.block).cast("int")
    block = F.pmod(F.xxhash64("domain", "e"), blocks).cast("int")
    other = F.when(light, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1))
    met = cells.join(degrees, "e").withColumn("block", F.when(light, -1).otherwise(block))
    return met.withColumn("other", F.explode(other)).select(
        F.when(light, F.pmod(F.xxhash64("e"), F.lit(packs))).otherwise(F.col("e")).alias("pack"),
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        (F.col("block") > F.col("other")).alias("second"),
        *cells.columns,
    )


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings in order, and the position of every value among them."""
    encoded = column.combine_chunks().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    names = np.array(encoded.dictionary.to_pylist(), dtype=object)
    order = np.argsort(names)
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    return names[order], place[encoded.indices.to_numpy()]


class Tile:
    """Cells of one tile as arrays, those of an entity together; ``at`` and ``to`` are the pairs of cells."""

    def __init__(self, cells: pa.Table):
        self.names, dom = codes(cells["domain"])
        self.entities, ent = np.unique(cells["e"].to_numpy(), return_inverse=True)
        self.order = np.argsort(ent, kind="stable")
        self.dom, self.ent = dom[self.order], ent[self.order]
        end = np.cumsum(np.bincount(ent))[self.ent]
        later = end - np.arange(len(end)) - 1
        first = np.repeat(np.cumsum(later) - later, later)
        self.at = np.repeat(np.arange(len(end)), later)
        self.to = self.at + 1 + np.arange(len(self.at)) - first
        if cells["lo"][0].as_py() != cells["hi"][0].as_py():
            second = cells["second"].to_numpy()[self.order]
            across = second[self.at] != second[self.to]
            self.at, self.to = self.at[across], self.to[across]
        a, b = self.dom[self.at], self.dom[self.to]
        self.pair = np.minimum(a, b) * len(self.names) + np.maximum(a, b)
        self.key = [cells[c][0].as_py() for c in TILE]

    def column(self, cells: pa.Table, name: str) -> np.ndarray:
        return cells[name].to_numpy()[self.order]

    def sums(self, *products: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The pairs of domains that meet, and sums over the pairs of their cells."""
        met, which = np.unique(self.pair, return_inverse=True)
        return met, [np.bincount(which, p, len(met)).astype(np.float64) for p in products]

    def named(self, met: np.ndarray) -> dict[str, pa.Array]:
        names = pa.array(self.names, pa.string())
        key = {c: pa.array(np.full(len(met), v), t) for c, v, t in zip(TILE, self.key, (pa.int64(), pa.int32(), pa.int32()))}
        return key | {"a": names.take(pa.array(met // len(self.names))), "b": names.take(pa.array(met % len(self.names)))}

    def cells(self, **values: np.ndarray) -> pa.Table:
        domain = pa.array(self.names, pa.string()).take(pa.array(self.dom))
        return pa.table({"domain": domain, "e": self.entities[self.ent]} | values)

    def similarity(self, sims: pa.Table) -> np.ndarray:
        """The similarity of each pair of cells, 0 where ``sims`` doesn't have it."""
        if sims.num_rows == 0:
            return np.zeros(len(self.pair))
        place = {name: i for i, name in enumerate(self.names)}
        known_a, a = codes(sims["a"])
        known_b, b = codes(sims["b"])
        a = np.array([place.get(n, -1) for n in known_a], dtype=np.int64)[a]
        b = np.array([place.get(n, -1) for n in known_b], dtype=np.int64)[b]
        keep = (a >= 0) & (b >= 0)
        pair = (np.minimum(a, b) * len(self.names) + np.maximum(a, b))[keep]
        sim = sims["sim"].to_numpy()[keep]
        order = np.argsort(pair)
        pair, sim = np.append(pair[order], -1), np.append(sim[order], 0.0)
        found = np.searchsorted(pair[:-1], self.pair)
        return np.where(pair[found] == self.pair, sim[found], 0.0)

    def neighbours(self, like: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each cell the sum of ``like`` times ``y`` of the cells it meets."""
        there = np.bincount(self.at, like * y[self.to], len(self.dom))
        return np.add(there, np.bincount(self.to, like * y[self.at], len(self.dom)), dtype=np.float64)


def _dots(cells: pa.Table) -> pa.Table:
    tile = Tile(cells)
    y = tile.column(cells, "y")
    met, (dot, shared) = tile.sums(y[tile.at] * y[tile.to], np.ones(len(tile.at)))
    return pa.table(tile.named(met) | {"dot": dot, "shared": shared.astype(np.int64)})


def _met(cells: pa.Table) -> pa.Table:
    tile = Tile(cells)
    return pa.table(tile.named(np.unique(tile.pair)))


def pair_dots(cells: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """For domains sharing an entity: ``a, b, dot`` (sum of products) and ``shared`` entities.

    ``cells`` holds ``domain, e (bigint), y (double, not 0)``, one row per domain and entity.
    """
    partial = deal(cells, tiling).groupBy(*TILE).applyInArrow(
        _dots, f"{_KEY_COLUMNS}, a string, b string, dot double, shared bigint"
    )
    return partial.groupBy("a", "b").agg(F.sum("dot").alias("dot"), F.sum("shared").alias("shared"))


def _mass(kind: str):
    def run(cells: pa.Table, sims: pa.Table) -> pa.Table:
        if cells.num_rows == 0:
            empty = {"domain": pa.array([], pa.string()), "e": pa.array([], pa.int64())}
            return pa.table(empty | {"num": np.empty(0), "den": np.empty(0)})
        tile = Tile(cells)
        y, like = tile.column(cells, "y"), tile.similarity(sims)
        if kind == "product":
            return tile.cells(num=tile.neighbours(like, y), den=np.zeros(len(y)))
        overlap = np.minimum(y[tile.at], y[tile.to])
        one = np.ones(len(y))
        return tile.cells(num=tile.neighbours(like * overlap, one), den=tile.neighbours(overlap, one))

    return run


def neighbour_mass(
    cells: DataFrame, sim: DataFrame, kind: str, tiling: Tiling = Tiling()
) -> DataFrame:
    """What the other domains on an entity contribute to each cell: ``domain, e, num, den``.

    ``kind='product'``: ``num`` = sum of similarity x count of the others (``den`` unused).
    ``kind='overlap'``: ``num`` = sum of similarity x min(counts), ``den`` = sum of min(counts).
    Cells alone on their entity may be missing from the result. A similarity goes to the tiles where
    its domains meet, and to no other.
    """
    dealt = materialize(deal(cells, tiling), "dealt")
    met = dealt.groupBy(*TILE).applyInArrow(_met, f"{_KEY_COLUMNS}, a string, b string")
    near = met.join(sim.select("a", "b", "sim"), ["a", "b"])
    partial = (
        dealt.groupBy(*TILE)
        .cogroup(near.groupBy(*TILE))
        .applyInArrow(_mass(kind), "domain string, e bigint, num double, den double")
    )
    return partial.groupBy("domain", "e").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def self_pair_join(
    net_domain: DataFrame, entity: str = "net", tiling: Tiling = Tiling()
) -> DataFrame:
    """Domain pairs that meet on at least one network, with the number of networks."""
    cells = net_domain.select(
        "domain", F.col(entity).cast("bigint").alias("e"), F.lit(1.0).alias("y")
    ).distinct()
    return pair_dots(cells, tiling).select("a", "b", "shared")


def pair_similarity_lookup(pairs: DataFrame, sim: DataFrame) -> DataFrame:
    """Similarity of given ``(a, b)`` pairs in either order: 1 to itself, 0 if unknown."""
    stored = sim.select(F.col("a").alias("_lo"), F.col("b").alias("_hi"), F.col("sim").alias("_s"))
    looked_up = pairs.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b")).join(
        stored, (F.col("_x") == F.col("_lo")) & (F.col("_y") == F.col("_hi")), "left"
    )
    value = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.coalesce("_s", F.lit(0.0)))
    return looked_up.select(*pairs.columns, value.alias("sim"))
