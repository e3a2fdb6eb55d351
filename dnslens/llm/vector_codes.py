"""Vector compression by product codes, with codebooks refined over trees of anchors.

Vectors are cut into parts, and each part position has its codebook. Rows are taken in chunks; a chunk's
parts at one position make a metric tree, built from the middle: anchors, about the root of the number of
points, take the points nearest to them, passing over those that the triangle inequality rules out; an
anchor with many points gets a tree of its own; then balls are merged upwards, the smallest union first.
Every ball caches the sum and number of its points. To assign points, a list of candidate
entries is handed down the tree, and each ball drops those that are certainly farther than the
nearest one, until it is wholly owned by one entry, or is a leaf, where exact distances decide.

Trees are stored once and read in every round. What a round brings together is a sum and a count for
each entry of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .links import bounded

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 24  # components are held within this, so that squared distances fit 64 bits

CHUNK = 4096
CHUNK_VALUES = 1 << 19  # components of a chunk, at most
LEAF = 64


class Ball(NamedTuple):
    pivot: np.ndarray
    radius: float
    members: np.ndarray
    halves: tuple = ()


def ball(points: np.ndarray, pivot: np.ndarray, members: np.ndarray, halves: tuple = ()) -> Ball:
    away = ((points[members] - pivot) ** 2).sum(axis=1)
    return Ball(pivot, float(np.sqrt(away.max())), members, halves)


def anchors(points: np.ndarray, number: int) -> np.ndarray:
    """The anchor that each point goes to, by number.

    A new anchor starts at the point farthest from its own one. It can only win points that are more than half
    as far from their anchor as the two anchors are from each other, so only those are looked at.
    """
    owner = np.zeros(len(points), dtype=np.int64)
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    heads = points[:1]
    for k in range(1, number):
        head = points[away.argmax()]
        apart = np.sqrt(((heads - head) ** 2).sum(axis=1))
        asked = np.flatnonzero(away > apart[owner] / 2)
        there = np.sqrt(((points[asked] - head) ** 2).sum(axis=1))
        won = there < away[asked]
        owner[asked[won]], away[asked[won]] = k, there[won]
        heads = np.vstack([heads, head])
    return owner


def grown(points: np.ndarray, members: np.ndarray) -> Ball:
    """The ball of some different points, middle out."""
    if len(members) <= LEAF:
        return ball(points, points[members].mean(axis=0), members)
    owner = anchors(points[members], int(np.ceil(np.sqrt(len(members)))))
    return merged(points, [grown(points, members[owner == k]) for k in np.unique(owner)])


def merged(points: np.ndarray, balls: list[Ball]) -> Ball:
    """Balls united two by two, always the pair whose union has the smallest radius (by its bound)."""
    pivots = np.stack([b.pivot for b in balls]).astype(np.float64)
    radii, sizes = np.array([b.radius for b in balls]), np.array([float(len(b.members)) for b in balls])

    def middles(i: int) -> np.ndarray:
        return (pivots[i] * sizes[i] + pivots * sizes[:, None]) / (sizes[i] + sizes)[:, None]

    def unions(i: int) -> np.ndarray:
        mid = middles(i)
        mine = np.sqrt(((mid - pivots[i]) ** 2).sum(axis=1)) + radii[i]
        theirs = np.sqrt(((mid - pivots) ** 2).sum(axis=1)) + radii
        return np.maximum(mine, theirs)

    cost = np.stack([unions(i) for i in range(len(balls))])
    np.fill_diagonal(cost, np.inf)
    gone = np.zeros(len(balls), dtype=bool)
    last = 0
    for _ in range(len(balls) - 1):
        last, other = divmod(int(cost.argmin()), len(balls))
        members = np.concatenate([balls[last].members, balls[other].members])
        pivot = middles(last)[other]
        balls[last] = ball(points, pivot, members, (balls[last], balls[other]))
        pivots[last], radii[last], sizes[last] = pivot, balls[last].radius, len(members)
        gone[other] = True
        row = unions(last)
        row[gone] = row[last] = np.inf
        cost[last], cost[:, last] = row, row
        cost[other], cost[:, other] = np.inf, np.inf
    return balls[last]


class Tree(NamedTuple):
    """Balls as arrays, the root first. A ball's points are ``points[start:stop]``; leaves have ``left`` -1."""

    points: np.ndarray
    weights: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    count: np.ndarray
    total: np.ndarray


def tree_of(values: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over the different rows of ``values``, with their numbers, and the point of each row."""
    points, row, weights = np.unique(values, axis=0, return_inverse=True, return_counts=True)
    nodes, links, order, placed = [], [], [], 0
    rest = [(grown(points, np.arange(len(points))), -1)]
    while rest:
        node, above = rest.pop()
        links.append((above, len(nodes)))
        nodes.append((node.pivot, node.radius, placed, placed + len(node.members)))
        if node.halves:
            rest += [(node.halves[1], len(nodes) - 1), (node.halves[0], len(nodes) - 1)]
        else:
            order.append(node.members)
            placed += len(node.members)
    children = np.full((len(nodes), 2), -1, dtype=np.int64)
    for above, below in links[1:]:
        children[above, int(children[above, 0] >= 0)] = below
    order = np.concatenate(order)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    points, weights = points[order], weights[order].astype(np.int64)
    start, stop = (np.array([n[k] for n in nodes], dtype=np.int64) for k in (2, 3))
    counts = np.concatenate([[0], np.cumsum(weights)])
    totals = np.vstack([np.zeros_like(points[:1]), np.cumsum(points * weights[:, None], axis=0)])
    tree = Tree(
        points, weights, np.stack([n[0] for n in nodes]).astype(np.float64), np.array([n[1] for n in nodes]), start, stop,
        children[:, 0], children[:, 1], counts[stop] - counts[start], totals[stop] - totals[start],
    )
    return tree, place[row.ravel()]


def settle(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: balls wholly owned and their entries, then leaves and their candidates.

    Equal entries never compete: all but the first of them are no candidates. Bounds leave room for
    rounding, so no candidate is dropped that could own a point or tie for one.
    """
    candidates = np.zeros((1, len(entries)), dtype=bool)
    candidates[0, np.unique(entries, axis=0, return_index=True)[1]] = True
    balls = np.zeros(1, dtype=np.int64)
    while len(balls):
        away = np.sqrt(((tree.pivot[balls][:, None, :] - entries[None]) ** 2).sum(axis=2))
        away[~candidates] = np.inf
        reach = (away.min(axis=1) + 2 * tree.radius[balls]) * (1 + 1e-9) + 1e-6
        candidates = away <= reach[:, None]
        owned = candidates.sum(axis=1) == 1
        leaf = ~owned & (tree.left[balls] < 0)
        yield balls[owned], candidates[owned].argmax(axis=1), balls[leaf], candidates[leaf]
        inner = ~owned & ~leaf
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]])
        candidates = np.tile(candidates[inner], (2, 1))


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after the other."""
    sizes = stop - start
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else sizes
    return shift + np.arange(sizes.sum())


def nearest(points: np.ndarray, entries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The nearest candidate of each point, the first one of a tie."""
    away = np.zeros((len(points), len(entries)), dtype=np.int64)
    for k in range(points.shape[1]):
        away += (points[:, k, None] - entries[None, :, k]) ** 2
    return np.where(candidates, away, np.iinfo(np.int64).max).argmin(axis=1)


def owners(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """The entry of each point of the tree."""
    out = np.empty(len(tree.points), dtype=np.int64)
    for owned, entry, leaves, candidates in settle(tree, entries):
        out[spans(tree.start[owned], tree.stop[owned])] = np.repeat(entry, tree.stop[owned] - tree.start[owned])
        at = spans(tree.start[leaves], tree.stop[leaves])
        each = np.repeat(candidates, tree.stop[leaves] - tree.start[leaves], axis=0)
        out[at] = nearest(tree.points[at], entries, each)
    return out


def add_up(tree: Tree, entries: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> None:
    """Adds the points of each entry, whole balls by what they cache."""
    for owned, entry, leaves, candidates in settle(tree, entries):
        np.add.at(totals, entry, tree.total[owned])
        np.add.at(counts, entry, tree.count[owned])
        at = spans(tree.start[leaves], tree.stop[leaves])
        each = np.repeat(candidates, tree.stop[leaves] - tree.start[leaves], axis=0)
        entry = nearest(tree.points[at], entries, each)
        np.add.at(totals, entry, tree.points[at] * tree.weights[at, None])
        np.add.at(counts, entry, tree.weights[at])


# --- as rows of Spark ------------------------------------------------------------------

_KINDS = {
    "points": "int", "weights": "bigint", "pivot": "double", "radius": "double", "start": "int", "stop": "int",
    "left": "int", "right": "int", "count": "bigint", "total": "bigint", "rows": "int",
}
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
_TREES = "array<struct<" + ",".join(f"{n}:array<{k}>" for n, k in _KINDS.items()) + ">>"
_TREE_LIST = pa.list_(pa.struct([(n, pa.list_(_TYPES[k])) for n, k in _KINDS.items()]))


def _plant(width: int):
    """Rows to chunks: the ids, the labels, and a tree for each part position."""
    step = width // PARTS
    size = max(1, min(CHUNK, CHUNK_VALUES // width))

    def chunk(table: pa.Table) -> pa.RecordBatch:
        values = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width).astype(np.int64)
        trees = []
        for p in range(PARTS):
            tree, rows = tree_of(values[:, p * step : (p + 1) * step])
            trees.append({n: np.ravel(x) for n, x in zip(Tree._fields, tree)} | {"rows": rows})
        whole = pa.array([0, len(values)], pa.int32())
        ids, labels = (pa.ListArray.from_arrays(whole, table[c].combine_chunks()) for c in ("vec_id", "label"))
        return pa.record_batch([ids, labels, pa.array([trees], _TREE_LIST)], ["vec_ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while rows + batch.num_rows >= size:
                yield chunk(pa.Table.from_batches([*held, batch.slice(0, size - rows)]))
                batch, held, rows = batch.slice(size - rows), [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield chunk(pa.Table.from_batches(held))

    return run


def _trees(batch: pa.RecordBatch, row: int, width: int) -> Iterator[tuple[Tree, np.ndarray]]:
    parts = batch["trees"][row].values
    step = width // PARTS
    for p in range(len(parts)):
        flat = {n: parts.field(n)[p].values.to_numpy(zero_copy_only=False) for n in _KINDS}
        flat |= {n: flat[n].astype(np.int64) for n, k in _KINDS.items() if k == "int"}
        flat |= {n: flat[n].reshape(-1, step) for n in ("points", "pivot", "total")}
        rows = flat.pop("rows")
        yield Tree(**flat), rows


def _sums(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, (tree, _) in enumerate(_trees(batch, row, width)):
                    add_up(tree, books[p], totals[p], counts[p])
        part, entry = np.nonzero(counts)
        step = books.shape[2]
        columns = {
            "part": np.repeat(part, step), "entry": np.repeat(entry, step), "place": np.tile(np.arange(step), len(part)),
            "total": totals[part, entry].ravel(), "n": np.repeat(counts[part, entry], step),
        }
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns.values()], list(columns))

    return run


def _codes(books: np.ndarray, width: int):
    hexed = np.array([f"{k:02x}" for k in range(books.shape[1])], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = batch["vec_ids"][at].values, batch["labels"][at].values
                code, error = np.full(len(ids), "", dtype=object), np.zeros(len(ids), dtype=np.int64)
                for p, (tree, rows) in enumerate(_trees(batch, at, width)):
                    entry = owners(tree, books[p])
                    away = ((tree.points - books[p][entry]) ** 2).sum(axis=1)
                    code = code + hexed[entry[rows]]
                    error += away[rows]
                yield pa.record_batch(
                    [ids, labels, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
                )

    return run


def first_vectors(vectors: DataFrame, number: int) -> list[list[int]]:
    """Vectors of the smallest ids, of a repeated id the smallest one; null is the largest id.

    Each round asks for the ids after the last one found, so repeated rows cost a round and no memory.
    """
    found: dict = {}
    left = vectors.filter("vec_id is not null")
    while len(found) < number:
        rows = left.orderBy("vec_id", "v").limit(number).collect()
        for r in rows:
            if len(found) < number:
                found.setdefault(r.vec_id, r.v)
        if len(rows) < number:
            break
        left = vectors.filter(F.col("vec_id") > rows[-1].vec_id)
    if len(found) < number:
        for r in vectors.filter("vec_id is null").orderBy("v").limit(1).collect():
            found[None] = r.v
    return list(found.values())


class Compression:
    """Product codes of the vectors of ``vec_id, embedding, label``.

    Rows go if the vector is null or holds a null or a number that isn't finite. Others become integers,
    ``floor(256 x)``, held within 2^24. Vectors are filled up with zeros to the longest one's length, rounded up
    to a multiple of 16, so shorter and empty ones are compressed too. Repeated rows and ids are
    rows like others; equal parts in a chunk are one point of its trees with a weight, so a vector that is
    very common costs no more. An empty table gives an empty result and empty codebooks. Other
    columns are not looked at.
    """

    def __init__(self, vectors: DataFrame, rounds: int = ROUNDS):
        kept = vectors.filter(
            F.col("embedding").isNotNull()
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        )
        longest = kept.agg(F.max(F.size("embedding")).alias("n")).first().n
        self.width = PARTS * max(1, -(-(longest or 0) // PARTS))
        limit = LIMIT / SCALE
        scaled = F.transform(
            "embedding",
            lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), x.cast("double"))) * SCALE).cast("int"),
        )
        filled = F.slice(F.concat(scaled, F.array_repeat(F.lit(0), self.width)), 1, self.width)
        rows = kept.select("vec_id", "label", filled.alias("v"))
        types = dict(rows.dtypes)
        self.types = f"vec_id {types['vec_id']}, label {types['label']}"
        schema = f"vec_ids array<{types['vec_id']}>, labels array<{types['label']}>, trees {_TREES}"
        self.chunks = stored(rows.mapInArrow(_plant(self.width), schema), "trees")
        seeds = np.array(first_vectors(rows, ENTRIES), dtype=np.int64).reshape(-1, PARTS, self.width // PARTS)
        self.books = np.ascontiguousarray(seeds.transpose(1, 0, 2))
        for _ in range(rounds if len(seeds) else 0):
            self.books = self._moved()

    def _moved(self) -> np.ndarray:
        """Codebooks after one round: of each entry the floor of the mean of its parts, if it has any."""
        columns = "part bigint, entry bigint, place bigint, total bigint, n bigint"
        sums = self.chunks.mapInArrow(_sums(self.books, self.width), columns).groupBy("part", "entry", "place")
        books = self.books.copy()
        for r in sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r.place] = r.total // r.n
        return books

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """``vec_id, label, code, error`` of every row that is kept."""
        return self.chunks.mapInArrow(_codes(self.books, self.width), f"{self.types}, code string, error bigint")


def compressed(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; null labels count as one label.

    Errors are added up by label before they move, and the sums join back to the rows.
    """
    compression = Compression(vectors)
    codes = stored(compression.codes(), "codes")
    sums = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = codes.join(bounded(sums), F.col("label").eqNullSafe(F.col("of")))
    sha = F.lit(compression.codebooks_sha256()).alias("codebooks_sha256")
    return joined.select("vec_id", "code", "error", "label_error", sha)
