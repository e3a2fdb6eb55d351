"""Links between alike things: comparing groups in tiles, and uniting what is linked."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, stored

TILE = 1024
ROWS = 256  # of a tile, compared at once
HELD = 4096  # rows of tiles that a task reads at a time
PERCENT = 80  # of the union of two sets, in common
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table of a few numbers a row for broadcast if its size is proven small.

    A larger one is left to the planner, which shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``edges`` (``a, b``): root is the smallest id it is linked with.

    Distributed union-find: each round hooks every root below its smallest neighbour, shortens the paths by
    two jumps, and carries the edges over to the new roots; edges inside a tree go. Rounds end when no
    edge is left, after about log(n). A hub with many edges is added up before the shuffle.
    """
    nodes, forests = None, []
    edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
        forest = stored(hooked.select("id", F.least("id", "b").alias("up")), "forest")
        for _ in range(2):
            higher = forest.select(F.col("id").alias("up"), F.col("up").alias("higher"))
            forest = forest.join(higher, "up").select("id", F.col("higher").alias("up"))
        forest = stored(forest, "forest")
        forests.append(forest)
        left = forest.select(F.col("id").alias("a"), F.col("up").alias("x"))
        right = forest.select(F.col("id").alias("b"), F.col("up").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x != y")
        moved = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = stored(moved.distinct(), "edges")
    if not forests:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))

    def climb(found: DataFrame, forest: DataFrame) -> DataFrame:
        higher = forest.select(F.col("id").alias("root"), "up")
        return found.join(higher, "root", "left").select("id", F.coalesce("up", "root").alias("root"))

    nodes = forests[0].select("id", F.col("up").alias("root"))
    return stored(reduce(climb, forests[1:], nodes), "components")


def tiles(members: DataFrame, group: str, order: Column, size: int = TILE) -> DataFrame:
    """Deals the pairs of a flagged member with any other of its group to tiles of bounded size.

    ``members`` has ``group``, ``id`` and ``flagged``. The result repeats its rows with ``i, j`` and
    ``as_flagged``, ``as_other``: tile (i, j) holds the i-th part of the flagged members and the j-th part of
    all members, so each such pair meets in one tile, and a group without flagged members is in none. In a
    group of one tile a row stands for both. Parts are cut by ``order`` (a hash, or a size band first): no
    group is sorted or gathered whole.
    """
    totals = members.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.col("flagged").cast("long")).alias("n_flagged")
    )
    totals = stored(totals.filter("n_flagged > 0 and n_all > 1"), "tile-counts")
    part = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(n) / size))
    sized = members.join(totals, group).withColumn("parts_all", part("n_all")).withColumn("parts_flagged", part("n_flagged"))
    one, zero = F.col("parts_all") == 1, F.lit(0).cast("long")
    whole = sized.filter(one).withColumns({"i": zero, "j": zero, "as_flagged": F.col("flagged"), "as_other": F.lit(True)})
    sized = sized.filter(~one)
    every = sized.withColumn("j", F.pmod(order, F.col("parts_all")))
    every = every.withColumn("i", F.explode(F.sequence(zero, F.col("parts_flagged") - 1)))
    asked = sized.filter("flagged").withColumn("i", F.pmod(order, F.col("parts_flagged")))
    asked = asked.withColumn("j", F.explode(F.sequence(zero, F.col("parts_all") - 1)))
    role = lambda df, asks: df.withColumns({"as_flagged": F.lit(asks), "as_other": F.lit(not asks)})
    return whole.unionByName(role(every, False)).unionByName(role(asked, True)).drop("n_all", "n_flagged", "parts_all", "parts_flagged")


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Positions of the pairs that join two trees, taken in order: a spanning forest of them."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    keep = []
    for at, (a, b) in enumerate(pairs.tolist()):
        if (x := find(a)) != (y := find(b)):
            parent[max(x, y)] = min(x, y)
            keep.append(at)
    return np.array(keep, dtype=np.int64)


class Relation:
    """When two bodies are linked. ``prepare`` reads bodies once; ``matches`` compares one with others."""

    tile = TILE  # members a tile

    def prepare(self, bodies: list[bytes]):
        raise NotImplementedError

    def matches(self, prepared, one: int, others: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def table(self, prepared, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """``matches`` for each of ``some``, a row each."""
        return np.array([self.matches(prepared, one, others) for one in some], dtype=bool).reshape(len(some), len(others))

    def beside_hubs(self, hubs: np.ndarray, hub_bodies: list, bodies: list) -> np.ndarray:
        """Which rows are linked with their hub."""
        linked = np.zeros(len(hubs), dtype=bool)
        order = np.argsort(hubs, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
            if len(rows):
                held = self.prepare([hub_bodies[rows[0]]] + [bodies[r] for r in rows])
                linked[rows] = self.matches(held, 0, np.arange(1, len(rows) + 1))
        return linked

    def inside_tiles(self, ids: np.ndarray, flagged: np.ndarray, other: np.ndarray, bodies: list, cuts: list[int]) -> np.ndarray:
        """Linked pairs of a flagged row and an other one of its tile; tiles begin at 0 and at ``cuts``."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for first, last in zip([0, *cuts], [*cuts, len(ids)]):
            here = slice(first, last)
            others, asked = np.flatnonzero(other[here]), np.flatnonzero(flagged[here])
            if not len(asked) or not len(others):
                continue
            held = self.prepare(bodies[here])
            for part in (asked[i : i + ROWS] for i in range(0, len(asked), ROWS)):
                i, j = np.nonzero(self.table(held, part, others))
                pairs = np.stack([ids[here][part[i]], ids[here][others[j]]], axis=1)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                found.append(pairs[spanning(pairs)])
        return np.concatenate(found)


def linked_sizes(common, a, b):
    return 100 * common >= PERCENT * (a + b - common)


def bitmap(found: np.ndarray) -> tuple[int, bytes]:
    """Number of bits, a power of two no less than the set, and the bits of the hashed shingles."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(found >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return bits, np.packbits(flags, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several sets, folded to every length among them, and the bits set in each."""

    def __init__(self, sizes: list[int], bits: list[int], maps: list[bytes]):
        self.sizes, self.bits = np.array(sizes), np.array(bits)
        self.words: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        for length in sorted(set(bits)):
            words = np.zeros((len(maps), length // 64), dtype=np.uint64)
            for row, (own, data) in enumerate(zip(bits, maps)):
                if own >= length:  # a longer bitmap is folded: bits at the same place modulo the length meet
                    words[row] = np.bitwise_or.reduce(np.frombuffer(data, np.uint64).reshape(-1, length // 64), axis=0)
            self.words[length] = words
            self.counts[length] = np.bitwise_count(words).sum(axis=1, dtype=np.int64)

    def most_common(self, one: int, others: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps: each bit that only one sets is a shingle that the other lacks."""
        most = np.zeros(len(others), dtype=np.int64)
        length = np.minimum(self.bits[one], self.bits[others])
        for own in np.unique(length):
            at = np.flatnonzero(length == own)
            rows, count = others[at], self.counts[own]
            both = np.bitwise_count(self.words[own][rows] & self.words[own][one]).sum(axis=1, dtype=np.int64)
            lacked = self.sizes[one] - (count[one] - both)
            most[at] = np.minimum(lacked, self.sizes[rows] - (count[rows] - both))
        return most

    def may_link(self, one: int, others: np.ndarray) -> np.ndarray:
        return linked_sizes(self.most_common(one, others), self.sizes[one], self.sizes[others])

    def table(self, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """``may_link`` for each of ``some``: bits in common are counted by matrix products."""
        most = np.zeros((len(some), len(others)))
        flags = lambda rows, own: np.unpackbits(self.words[own][rows].view(np.uint8), axis=1).astype(np.float32)
        for a in np.unique(self.bits[some]):
            for b in np.unique(self.bits[others]):
                own = min(a, b)
                i, j = np.flatnonzero(self.bits[some] == a), np.flatnonzero(self.bits[others] == b)
                left, right, count = some[i], others[j], self.counts[own]
                both = flags(left, own) @ flags(right, own).T
                lacked = (self.sizes[left] - count[left])[:, None] + both
                most[np.ix_(i, j)] = np.minimum(lacked, (self.sizes[right] - count[right])[None, :] + both)
        return linked_sizes(most, self.sizes[some][:, None], self.sizes[others][None, :])


class AlikeSets(Relation):
    """Exact similarity of sets of hashes, after the bound by bitmaps."""

    def sets(self, bodies: list) -> list[np.ndarray]:
        """The sorted distinct hashes of each body."""
        raise NotImplementedError

    def prepare(self, bodies: list) -> tuple[Bitmaps, list[np.ndarray]]:
        sets = self.sets(bodies)
        bits, maps = zip(*map(bitmap, sets))
        return Bitmaps([len(s) for s in sets], list(bits), list(maps)), sets

    def matches(self, prepared: tuple, one: int, others: np.ndarray) -> np.ndarray:
        bound, sets = prepared
        linked = bound.may_link(one, others)
        for at in np.flatnonzero(linked):
            found, theirs = sets[one], sets[others[at]]
            common = len(np.intersect1d(found, theirs, assume_unique=True))
            linked[at] = linked_sizes(common, len(found), len(theirs))
        return linked

    def table(self, prepared: tuple, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        bound, sets = prepared
        linked = bound.table(some, others)
        for i, j in np.argwhere(linked):
            found, theirs = sets[some[i]], sets[others[j]]
            common = len(np.intersect1d(found, theirs, assume_unique=True))
            linked[i, j] = linked_sizes(common, len(found), len(theirs))
        return linked


def distinct_groups(members: DataFrame) -> DataFrame:
    """``group, id`` of groups of two or more ids, each set of ids under one group only."""
    signs = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("sign"))
    chosen = signs.filter("n > 1").groupBy("n", "sign").agg(F.min("group").alias("group"))
    return members.join(stored(chosen.select("group"), "groups"), "group", "left_semi")


def _verified(pairs: DataFrame, payload: DataFrame, relation: Relation) -> DataFrame:
    """``hub, id, linked`` for pairs of ids; bodies of a hub are shared by the rows of a batch."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, ids = batch.column("hub").to_numpy(), batch.column("id").to_numpy()
            linked = relation.beside_hubs(hubs, batch.column("hub_body").to_pylist(), batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(ids), pa.array(linked)], names=["hub", "id", "linked"])

    heads = payload.select(F.col("id").alias("hub"), F.col("body").alias("hub_body"))
    joined = pairs.join(heads, "hub").join(payload, "id").select("hub", "id", "hub_body", "body")
    return joined.mapInArrow(check, "hub long, id long, linked boolean")


def connect(members: DataFrame, payload: DataFrame, relation: Relation) -> DataFrame:
    """Edges ``a, b`` that unite all ids linked inside any group, and nothing else.

    ``members`` (``group, id``, distinct) says which ids may be linked, ``payload`` (``id, body``) what they
    are. First every member is compared with the smallest of its group, so a group of near copies, however
    large, takes one comparison a member. Those that differ from it are then compared with all others of
    their group in tiles, where only edges that join two trees leave a task; the smallest itself, and so a
    group of two, is in no tile. Two members either are both linked with the smallest, or one of them is
    compared with the other: no link is lost.
    """
    members = stored(distinct_groups(members), "members")
    hubs = members.groupBy("group").agg(F.min("id").alias("hub"))
    star = stored(members.join(hubs, "group").filter("id != hub"), "star")
    known = stored(_verified(star.select("hub", "id").distinct(), payload, relation), "known")
    differ = star.join(known.filter("not linked"), ["hub", "id"], "left_semi")
    differ = differ.select("group", "id", F.lit(True).alias("flagged"))
    marked = star.select("group", "id").join(differ, ["group", "id"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    tiled = tiles(stored(marked, "marked"), "group", F.xxhash64("id"), relation.tile).join(payload, "id")

    def compare(table: pa.Table) -> pa.RecordBatch:
        place = np.stack([table[c].to_numpy() for c in ("group", "i", "j")], axis=1)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        flagged, other = (table[c].to_numpy().astype(bool) for c in ("as_flagged", "as_other"))
        pairs = relation.inside_tiles(table["id"].to_numpy(), flagged, other, table["body"].to_pylist(), cuts.tolist())
        pairs = pairs[spanning(pairs)]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in (0, 1)], names=["a", "b"])

    def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole tiles of a sorted partition, some thousand rows at a time; most tiles are small."""
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = pa.Table.from_batches([batch.slice(at, HELD)])
                held = part if held is None else pa.concat_tables([held, part])
                last = [held[c][held.num_rows - 1].as_py() for c in ("group", "i", "j")]
                same = np.all([held[c].to_numpy() == v for c, v in zip(("group", "i", "j"), last)], axis=0)
                whole = int(np.argmax(same))  # rows before the tile that may go on
                if whole:
                    yield compare(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield compare(held)

    place = ["group", "i", "j"]
    dealt = tiled.select(*place, "id", "as_flagged", "as_other", "body").repartition(spread(members.sparkSession, 4), *place)
    inside = dealt.sortWithinPartitions(*place).mapInArrow(compare_tiles, "a long, b long")
    direct = known.filter("linked").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    return direct.unionByName(inside)
