"""Fuzzy line deduplication by MinHash.

Lines get signatures over their runs of five characters, of which a change spoils five at most, so that short
lines are found as well as long ones. Lines are alike if the Jaccard similarity of their sets of runs is
0.8. Bands of the signatures bring lines together that may be alike, at a recall of over 0.998 for
a similarity of 0.8 and more above. Pairs whose sketches are far apart are no candidates; the others are
verified by the exact similarity, distributed union-find makes components of the links, and of all
occurrences of a component's lines the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored
from .links import Relation, bounded, components, connect, linked_sizes, spanning

SHINGLE = 5
BITS = 2048  # of a bitmap that bounds overlaps
PAIRS = 1 << 16  # compared at once
HUB_PAIRS = 1 << 11  # of a hub that come together
SEEN = 1 << 10  # bitmaps that are compared at once, few enough for a processor's cache
CODES = 1 << 20  # of pairs that are counted at once
BLOCK = 1 << 16  # characters that are hashed at once, few enough for a processor's cache
BANDS = 16
BAND_ROWS = 5
ROWS = 512
CELLS = 1 << 19  # cells (a band, a line and its sketch) that are dealt at once, and pairs that are made
PART = 1 << 24  # bytes of cells in a part
SKETCH = 64  # bits, one of each of so many minima and maxima
FAR = 19  # bits in which sketches differ; at a similarity of 0.8 each does with a probability of 0.1
CROWD = 128  # lines of one band that are compared two by two
BLANKS = " \t\n\v\f\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_SHORT = np.uint32(0x9E3779B1)


@lru_cache
def permutations(n: int) -> np.ndarray:
    """Odd factors of the hash functions, from a fixed seed."""
    return np.random.default_rng(4).integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def pieces(lines: list[str], size: int) -> list[tuple[int, int]]:
    """Bounds of pieces of ``lines`` that have less than ``size`` characters behind their first line."""
    ends = np.cumsum([len(line) + SHINGLE for line in lines])
    cuts = (np.flatnonzero(np.diff(ends // size)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(lines)])) if lines else []


def _mixed(codes: np.ndarray, n: int, size: int, held: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``n`` runs of ``size`` codes: three at once have 63 bits."""
    codes = codes.astype(np.uint64)
    gram = codes[:n].copy()
    for k in range(size):
        if k:
            more = codes[k : k + n]
            gram += np.left_shift(more, np.uint64(21 * (k % 3)), out=held) if k % 3 else more
        if k % 3 == 2 or k == size - 1:
            gram *= _MIX
            gram ^= np.right_shift(gram, np.uint64(31), out=held)
    return gram


def _mixed_short(codes: np.ndarray, n: int, size: int, held: np.ndarray) -> np.ndarray:
    """32-bit hashes: a polynomial, whose bits are mixed."""
    gram = codes[:n] * _MIX_SHORT
    for k in range(1, size):
        gram += codes[k : k + n]
        gram *= _MIX_SHORT
    for shift in (15, 13):
        gram ^= np.right_shift(gram, np.uint32(shift), out=held)
        gram *= _MIX_SHORT
    gram ^= np.right_shift(gram, np.uint32(16), out=held)
    return gram


def shingle_hashes(lines: list[str], size: int = SHINGLE, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` characters of all lines, and each line's number of them.

    A line under ``size`` characters is one run. A line's first run comes again in place of those beyond its
    end. 64 bits tell runs apart; 32 do where a few that agree by chance don't matter.
    """
    gap = "\0" * (size - 1)
    codes = np.frombuffer((gap.join(lines) + 2 * gap).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    counts = lengths + size - 1
    n = counts.sum()
    gram = (_mixed if kind is np.uint64 else _mixed_short)(codes, n, size, np.empty(n, kind))
    first = np.cumsum(counts) - counts
    beyond = np.maximum(lengths - size + 1, 1)[:, None] + np.arange(2 * (size - 1))
    gram[first[:, None] + np.minimum(beyond, counts[:, None] - 1)] = gram[first][:, None]
    return gram, counts


def signatures(
    lines: list[str], bands: int = BANDS, rows: int = BAND_ROWS, size: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray]:
    """Lines by bands: hashes of ``rows`` minima each. And sketches: a bit of each of the first minima.

    A quarter of the bands takes the minima of some permutations, the others the maxima, and minima and maxima
    with the sign bit turned, of the same ones. All agree with the probability of the similarity; those of one
    permutation are never in the same band.
    """
    factors = permutations(-(-bands // 4) * rows)
    ends = np.empty((4 * len(factors), len(lines)), dtype=np.uint32)
    quarters = [x.reshape(4, len(factors), len(lines)) for x in (ends, ends.view(np.int32))]
    for begin, end in pieces(lines, BLOCK):
        seen, counts = shingle_hashes(lines[begin:end], size, np.uint32)
        first = np.cumsum(counts) - counts
        drawn = np.empty_like(seen)
        for at, factor in enumerate(factors):
            np.multiply(seen, factor, out=drawn)
            for k, (values, out) in enumerate(zip((drawn, drawn.view(np.int32)), quarters)):
                np.minimum.reduceat(values, first, out=out[2 * k, at, begin:end])
                np.maximum.reduceat(values, first, out=out[2 * k + 1, at, begin:end])
    ends = ends[: bands * rows]
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for at in range(rows):
        keys = (keys ^ ends[at::rows]) * _MIX
        keys ^= keys >> np.uint64(29)
    flags = np.zeros((len(lines), SKETCH), dtype=np.uint8)
    flags[:, : len(ends)] = (ends[:SKETCH] * _MIX_SHORT >> np.uint32(31)).T
    return np.ascontiguousarray(keys.T), np.packbits(flags, axis=1).view(np.uint64).ravel()


def band_keys(lines: list[str], bands: int = BANDS, rows: int = BAND_ROWS, size: int = SHINGLE) -> np.ndarray:
    """Lines by bands: hashes of ``rows`` minima each."""
    return signatures(lines, bands, rows, size)[0]


class LineSets:
    """The sets of runs of some lines: sorted hashes in one array, sizes, and bitmaps that bound overlaps."""

    def __init__(self, lines: list[str]):
        parts, sizes, bits = [], [], []
        for start, stop in pieces(lines, BLOCK):
            gram, counts = shingle_hashes(lines[start:stop])
            first = np.cumsum(counts) - counts
            for begin, n in zip(first.tolist(), counts.tolist()):
                gram[begin : begin + n].sort()
            new = np.append(True, gram[1:] != gram[:-1])
            new[first] = True
            sizes.append(np.add.reduceat(new, first, dtype=np.int64))
            parts.append(gram[new])
            flags = np.zeros((stop - start, BITS), dtype=np.uint8)
            places = np.repeat(np.arange(0, flags.size, BITS), sizes[-1])
            places += (parts[-1] >> np.uint64(20) & np.uint64(BITS - 1)).view(np.int64)
            flags.ravel()[places] = 1
            bits.append(np.packbits(flags, axis=1).view(np.uint64))
        self.runs, self.sizes, self.bits = np.concatenate(parts), np.concatenate(sizes), np.concatenate(bits)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.n_bits = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)

    def _marked(self, lines: np.ndarray) -> np.ndarray:
        """The hashes of some lines, cut to 44 bits, each with the place of its line in ``lines`` above them."""
        sizes = self.sizes[lines]
        start = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.first[lines] - start, sizes)
        return np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(44), sizes) | self.runs[at] >> np.uint64(20)

    def _set(self, line: int) -> np.ndarray:
        return self.runs[self.first[line] : self.first[line] + self.sizes[line]]

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs have a similarity of 0.8; runs in common are counted where bitmaps allow that many.

        Cut hashes may agree by chance, so pairs that few runs decide are counted by whole ones.
        """
        one, two = self.sizes[a], self.sizes[b]
        out = linked_sizes(np.minimum(one, two), one, two)
        near = np.flatnonzero(out)
        for at in (near[k : k + SEEN] for k in range(0, len(near), SEEN)):
            both = np.bitwise_count(self.bits[a[at]] & self.bits[b[at]]).sum(axis=1, dtype=np.int64)
            most = both + np.minimum(one[at] - self.n_bits[a[at]], two[at] - self.n_bits[b[at]])
            out[at] = linked_sizes(most, one[at], two[at])
        left = np.flatnonzero(out)
        cost = np.cumsum(self.sizes[a[left]] + self.sizes[b[left]])
        for at in np.split(left, np.searchsorted(cost, np.arange(CODES, cost[-1], CODES))) if len(left) else ():
            one, two = self.sizes[a[at]], self.sizes[b[at]]
            keys = np.concatenate([self._marked(a[at]), self._marked(b[at])])
            keys.sort(kind="stable")  # two sorted runs are merged
            twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)
            common = np.bincount(twice.astype(np.int64), minlength=len(at))
            out[at] = linked_sizes(common, one, two)
            for k in np.flatnonzero(out[at] & ~linked_sizes(common - 4, one, two)):
                exact = len(np.intersect1d(self._set(a[at[k]]), self._set(b[at[k]]), assume_unique=True))
                out[at[k]] = linked_sizes(exact, one[k], two[k])
        return out


class Forest:
    """The links found between the lines of ``sets``, as far as they unite anything."""

    def __init__(self, sets: LineSets):
        self.sets, self.roots = sets, np.arange(len(sets.sizes))

    def unite(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of pairs that unite all that the pairs ``a, b`` link and was apart.

        Each line is compared with one partner first, with two next and so on: what earlier links unite
        needs no comparison.
        """
        left, found, some = np.arange(len(a)), [np.zeros(0, dtype=np.int64)], 1
        left = left[np.lexsort((a, b))]
        while len(left := left[self.roots[a[left]] != self.roots[b[left]]]):
            first = np.flatnonzero(np.append(True, b[left[1:]] != b[left[:-1]]))
            now = np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left)))) < some
            asked, left, some = left[now], left[~now], 2 * some
            asked = asked[self.sets.linked(a[asked], b[asked])]
            ends = np.stack([self.roots[a[asked]], self.roots[b[asked]]], axis=1)
            joins = spanning(ends)
            found.append(asked[joins])
            if len(joins):
                self._join(ends[joins])
        return np.concatenate(found)

    def _join(self, trees: np.ndarray) -> None:
        up = {}

        def top(x: int) -> int:
            while (higher := up.get(x, x)) != x:
                up[x] = x = up.get(higher, higher)
            return x

        for one, two in trees.tolist():
            one, two = top(one), top(two)
            up[max(one, two)] = min(one, two)
        moved = np.arange(len(self.roots))
        moved[list(up)] = [top(x) for x in up]
        self.roots = moved[self.roots]


class AlikeLines(Relation):
    """Exact Jaccard similarity of the sets of runs of characters. A body is the line."""

    def beside_hubs(self, hubs: np.ndarray, hub_bodies: list, bodies: list) -> np.ndarray:
        _, first, which = np.unique(hubs, return_index=True, return_inverse=True)
        held = LineSets([hub_bodies[k] for k in first] + bodies)
        return held.linked(which.ravel(), len(first) + np.arange(len(bodies)))

    def inside_tiles(self, ids: np.ndarray, flagged: np.ndarray, other: np.ndarray, bodies: list, cuts: list[int]) -> np.ndarray:
        """Small tiles at once, as many as have ``CODES`` characters; a larger one alone."""
        found, begin, held = [np.zeros((0, 2), dtype=np.int64)], 0, 0
        edges = [0, *cuts, len(ids)]
        for k, (first, last) in enumerate(zip(edges, edges[1:])):
            size = sum(map(len, bodies[first:last]))
            if held and held + size > CODES:
                inner = slice(edges[begin], first)
                found.append(self._some_tiles(ids[inner], flagged[inner], other[inner], bodies[inner], [c - edges[begin] for c in edges[begin + 1 : k]]))
                begin, held = k, 0
            held += size
        inner = slice(edges[begin], len(ids))
        found.append(self._some_tiles(ids[inner], flagged[inner], other[inner], bodies[inner], [c - edges[begin] for c in edges[begin + 1 : -1]]))
        return np.concatenate(found)

    def _some_tiles(self, ids: np.ndarray, flagged: np.ndarray, other: np.ndarray, bodies: list, cuts: list[int]) -> np.ndarray:
        names, first, which = np.unique(ids, return_index=True, return_inverse=True)
        which, held = which.ravel(), Forest(LineSets([bodies[k] for k in first]))
        found, some, n_some = [np.zeros((0, 2), dtype=np.int64)], [], 0

        def flush() -> None:
            pairs = np.concatenate(some)
            pairs = np.stack(np.divmod(np.unique(pairs[:, 0] * len(names) + pairs[:, 1]), len(names)), axis=1)
            found.append(names[pairs[held.unite(pairs[:, 0], pairs[:, 1])]])
            some.clear()

        for begin, end in zip([0, *cuts], [*cuts, len(ids)]):
            here = which[begin:end]
            asked, others = here[flagged[begin:end]], here[other[begin:end]]
            step = max(1, PAIRS // max(1, len(others)))
            for part in (asked[k : k + step] for k in range(0, len(asked) if len(others) else 0, step)):
                pairs = np.stack([np.repeat(part, len(others)), np.tile(others, len(part))], axis=1)
                some.append(np.sort(pairs[held.roots[pairs[:, 0]] != held.roots[pairs[:, 1]]], axis=1))
                n_some += len(some[-1])
                if n_some >= PAIRS:
                    flush()
                    n_some = 0
        if some:
            flush()
        return np.concatenate(found)


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line, id`` of the lines with a word; equal lines have equal ids."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(split).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.xxhash64("line"))


class FirstOwners:
    """Names each band's lines as they come: the first line of a band waits until another one shares the band.

    Only different bands are held, 17 bytes each, however many lines share one.
    """

    def __init__(self):
        self.keys, self.ids, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands and lines that are known to be shared with ``keys`` and ``ids`` added; some may come again."""
        keys, ids = np.concatenate([self.keys, keys]), np.concatenate([self.ids, ids])
        order = np.argsort(keys, kind="stable")  # the owner before those that come later
        told = np.append(self.told, np.zeros(len(keys) - len(self.told), bool))[order]
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        lengths = np.diff(np.append(first, len(keys)))
        others = ids != np.repeat(ids[first], lengths)
        shared = np.logical_or.reduceat(others, first) if len(first) else others
        others[first] = shared & ~told[first]
        self.keys, self.ids, self.told = keys[first], ids[first], told[first] | shared
        return keys[others], ids[others]


class SharedBands:
    """The different cells of a part. A band of more than ``CROWD`` lines is told as it grows, not held."""

    def __init__(self):
        self.cells, self.crowded = np.zeros((0, 3), np.uint64), np.zeros(0, np.uint64)

    def _bands(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.append(True, cells[1:, 0] != cells[:-1, 0])[: len(cells)])
        return first, np.diff(np.append(first, len(cells)))

    def add(self, cells: np.ndarray, last: bool = False) -> np.ndarray:
        """Takes ``cells`` in and gives back those of crowded bands; some may come again.

        With the ``last`` ones, lines that are alone in a band go.
        """
        told = np.isin(cells[:, 0], self.crowded)
        more, cells = cells[told], np.concatenate([self.cells, cells[~told]])
        order = np.argsort(keys := np.ascontiguousarray(cells[:, 0]))
        same = (keys := keys[order])[1:] == keys[:-1]
        met = np.flatnonzero(np.append(same, False) | np.append(False, same))[: len(cells)]  # most lines are alone in a band
        order[met] = order[met][np.lexsort((cells[order[met], 1], keys[met]))]
        cells = cells[order[met] if last else order]
        cells = cells[np.append(True, (cells[1:, :2] != cells[:-1, :2]).any(axis=1))[: len(cells)]]
        first, lengths = self._bands(cells)
        crowd = np.repeat(lengths > CROWD, lengths)
        self.crowded = np.append(self.crowded, cells[first[lengths > CROWD], 0])
        self.cells = cells[~crowd]
        return np.concatenate([more, cells[crowd]])

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of lines that share a held band and have sketches that are not far apart."""
        ids = self.ids()
        for a, b in self._near_places():
            yield ids[a], ids[b]

    def near_with_hubs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Those pairs, each with the smallest line of the band that either is near to, or is itself."""
        ids = self.ids()
        least = ids.copy()
        for a, b in self._near_places():
            np.minimum.at(least, a, ids[b])
            np.minimum.at(least, b, ids[a])
            yield ids[a], ids[b], np.minimum(least[a], least[b])

    def ids(self) -> np.ndarray:
        return np.ascontiguousarray(self.cells[:, 1]).view(np.int64)

    def _near_places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole bands at a time."""
        first, lengths = self._bands(self.cells)
        sketches = np.ascontiguousarray(self.cells[:, 2])
        for n in np.unique(lengths[lengths > 1]).tolist():
            i, j = np.triu_indices(n, 1)
            begins, step = first[lengths == n], max(1, CELLS // len(i))
            for some in (begins[k : k + step, None] for k in range(0, len(begins), step)):
                a, b = (some + i).ravel(), (some + j).ravel()
                close = np.bitwise_count(sketches[a] ^ sketches[b]) < FAR
                yield a[close], b[close]


def _dealt_cells(lines: DataFrame, n_lines: int | None) -> DataFrame:
    """``cells``: rows of three numbers (band, line, sketch), all those of a band in one partition.

    Cells move as numbers in pieces of many, dealt by the band into as many parts as ``PART`` bytes each need.
    """
    n_lines = lines.count() if n_lines is None else n_lines
    parts = max(spread(lines.sparkSession), -(-n_lines * BANDS * 24 // PART))

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(held)
        part = (cells[:, 0] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, cells = part[order], cells[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(first, len(part)).astype(np.int32) * np.int32(24)
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(cells)])
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), packed], names=["part", "cells"])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            ids, first = np.unique(batch.column("id").to_numpy(), return_index=True)
            for i in range(0, len(ids), ROWS):
                keys, sketches = signatures(batch.column("line").take(pa.array(first[i : i + ROWS])).to_pylist())
                names = ids[i : i + ROWS].astype(np.int64).view(np.uint64)
                each = [np.repeat(x, keys.shape[1]) for x in (names, sketches)]
                held.append(np.stack([keys.ravel(), *each], axis=1))
                n_held += keys.size
                if n_held >= CELLS:
                    yield dealt(held)
                    held, n_held = [], 0
        if held:
            yield dealt(held)

    pieces = lines.select("id", "line").mapInArrow(bands, "part int, cells binary")
    return pieces.repartitionById(parts, F.col("part")).select("cells")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The cells of a part, at once unless it has one and a half of ``PART``."""
    held, n_held = [], 0
    for batch in batches:
        for piece in batch.column("cells"):
            held.append(np.frombuffer(piece.as_buffer(), np.uint64).reshape(-1, 3))
            n_held += len(held[-1])
            if n_held * 16 >= PART:
                yield np.concatenate(held)
                held, n_held = [], 0
    if held:
        yield np.concatenate(held)


def candidates(lines: DataFrame, n_lines: int | None = None) -> DataFrame:
    """``group, id``: ids that share a band with another id. ``n_lines`` is the number of rows, if known."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = FirstOwners()
        for cells in _gathered(batches):
            keys, ids = owners.add(cells[:, 0], np.ascontiguousarray(cells[:, 1]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], names=["group", "id"])

    return _dealt_cells(lines, n_lines).mapInArrow(shared, "group long, id long").distinct()


def near_candidates(lines: DataFrame, n_lines: int | None = None) -> DataFrame:
    """``a, b, crowded, hub``: pairs of ids that share a band and are not far apart by their sketches.

    Unlike lines that share a band by chance, whose number grows with the square of the lines, so never leave
    the task that sees them. At a similarity of 0.8 one pair in 100,000 is far apart, above it fewer. Bands
    of more than ``CROWD`` ids are not paired: they come as ``a`` the band and ``b`` each id, ``crowded``.
    A pair's ``hub`` is an id near to it that shares a band with it, the same one for most pairs of near copies;
    as it is in ``BANDS`` bands, it has less than ``BANDS * CROWD`` ids.
    """

    def rows(a: np.ndarray, b: np.ndarray, hub: np.ndarray, crowded: bool) -> pa.RecordBatch:
        which = pa.array(np.full(len(a), crowded))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), which, pa.array(hub)], names=["a", "b", "crowded", "hub"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = SharedBands(), _gathered(batches)
        cells = next(gathered, None)
        while cells is not None:
            more = next(gathered, None)
            told, cells = held.add(cells, more is None), more
            if len(told):
                group, id = (np.ascontiguousarray(told[:, k]).view(np.int64) for k in (0, 1))
                yield rows(group, id, group, True)
        for a, b, hub in held.near_with_hubs():
            yield rows(a, b, hub, False)

    met = _dealt_cells(lines, n_lines).mapInArrow(shared, "a long, b long, crowded boolean, hub long")
    return met.groupBy("a", "b", "crowded").agg(F.min("hub").alias("hub"))


def _pieces_of_pairs(hubs: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of pieces of pairs, sorted by hub, whose lines have ``CODES`` characters or few more.

    Hubs of no more than that count each line once; pairs of others count the lines of each.
    """
    _, which, n = np.unique(hubs, return_inverse=True, return_counts=True)
    lines = np.unique(np.stack([np.tile(which, 2), np.concatenate([a, b])], axis=1), axis=0)
    whole = np.bincount(lines[:, 0], lengths[lines[:, 1]])
    cost = np.where(whole[which] <= CODES, whole[which] / n[which], lengths[a] + lengths[b])
    cuts = (np.flatnonzero(np.diff((np.cumsum(cost) - cost) // CODES)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(hubs)]))


def alike_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges ``a, b`` that unite the ids of ``pairs`` (``a, b, hub``) whose lines (``id, body``) are alike, and nothing else.

    The pairs of a hub come together with the lines they need, so that a line is sent and hashed once a hub
    and not once a pair. Those of a hub with more than ``HUB_PAIRS`` are cut by a hash of ``b``. They are looked
    at in pieces of bounded length. Without ``hub`` it is ``a``.
    """
    pairs = pairs if "hub" in pairs.columns else pairs.withColumn("hub", F.col("a"))
    large = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB_PAIRS)
    cut = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / HUB_PAIRS))
    pairs = pairs.join(bounded(stored(large, "large-hubs")), "hub", "left")
    pairs = pairs.select(F.when(F.col("n").isNull(), F.col("hub")).otherwise(F.xxhash64("hub", cut)).alias("hub"), "a", "b")

    def looked_at(table: pa.Table) -> pa.RecordBatch:
        asked = table["b"].is_valid().to_numpy()
        bodies = table.filter(pa.array(~asked))
        ids, first = np.unique(bodies["id"].to_numpy(), return_index=True)
        bodies = bodies["body"].take(pa.array(first)).combine_chunks()
        lengths = pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64)
        table = table.filter(pa.array(asked))
        hubs, a, b = (table[c].to_numpy() for c in ("hub", "id", "b"))
        a, b = np.sort(np.searchsorted(ids, np.stack([a, b])), axis=0)
        found = [np.zeros((0, 2), dtype=np.int64)]
        for begin, end in _pieces_of_pairs(hubs, a, b, lengths) if len(hubs) else ():
            some, which = np.unique(np.stack([a[begin:end], b[begin:end]]), return_inverse=True)
            one, two = which.reshape(2, -1)
            at = begin + Forest(LineSets(bodies.take(pa.array(some)).to_pylist())).unite(one, two)
            found.append(np.stack([ids[a[at]], ids[b[at]]], axis=1))
        edges = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, k])) for k in (0, 1)], names=["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            hubs = held["hub"].to_numpy()
            whole = int(np.searchsorted(hubs, hubs[-1])) if len(hubs) else 0  # the last one may go on
            if whole:
                yield looked_at(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield looked_at(held)

    members = pairs.select("hub", F.explode(F.array("a", "b")).alias("id")).distinct()
    members = members.join(texts, "id").select("hub", "id", F.lit(None).cast("long").alias("b"), "body")
    asked = pairs.select("hub", F.col("a").alias("id"), "b", F.lit(None).cast("string").alias("body"))
    dealt = members.unionByName(asked).repartition("hub").sortWithinPartitions("hub")
    return dealt.mapInArrow(check, "a long, b long")


def line_classes(lines: DataFrame, n_lines: int | None = None) -> DataFrame:
    """``id, root`` for the lines that are like another; the others are alone."""
    met = stored(near_candidates(lines, n_lines), "near")
    pairs = met.filter("not crowded").select("a", "b", "hub")
    crowds = met.filter("crowded").select(F.col("a").alias("group"), F.col("b").alias("id"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowds.select("id"))
    wanted = stored(wanted.distinct(), "wanted")
    texts = lines.select("id", "line").join(bounded(wanted), "id").groupBy("id").agg(F.min("line").alias("body"))
    texts = stored(texts, "texts")
    edges = alike_pairs(pairs, texts)
    if crowds.take(1):
        edges = edges.unionByName(connect(crowds, texts, AlikeLines()))
    return components(edges)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, id`` of every line to remove: all but the first of its class.

    First is by document id (null first), then place. Lines without a word are not looked at.
    """
    lines = lines_of(docs)
    places = stored(lines.select("doc_id", "line_no", "id"), "places")
    classes = line_classes(lines, places.count())
    placed = places.join(bounded(classes), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = stored(placed, "placed")
    at = F.struct("doc_id", "line_no")
    first = placed.groupBy("root").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = placed.join(bounded(stored(first, "firsts")), "root").filter(at != F.col("first"))
    return later.select("doc_id", "line_no", "id")


def _cut(text: str | None, removed: list[dict] | None) -> tuple[str | None, int, int]:
    """The text left of a document, its lines with a word, and how many lines went."""
    lines = (text or "").split("\n")
    worded = sum(1 for x in lines if x.strip(BLANKS))
    if not removed:
        return text, worded, 0
    # Rows of one id and different texts have different lines at one place.
    marks = {(r["line_no"], r["id"] % (1 << 64)) for r in removed}
    places = {line_no for line_no, _ in marks}
    unsigned = lambda line: xxhash.xxh64_intdigest(line.encode(), seed=42)  # noqa: E731  as Spark's xxhash64
    kept = [x for i, x in enumerate(lines) if i not in places or (i, unsigned(x)) not in marks]
    return None if text is None else "\n".join(kept), worded, len(lines) - len(kept)


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """``_cut`` of each row; ``ROWS`` texts are held as strings at a time."""
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])
    parts = [pa.array([], kind)]
    for at in range(0, len(texts), ROWS):
        some = zip(texts.slice(at, ROWS).to_pylist(), gone.slice(at, ROWS).to_pylist())
        columns = zip(*(_cut(text, removed) for text, removed in some))
        parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))
    return pa.concat_arrays(parts)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: all its columns as ``doc``, ``text`` left, ``n_lines, n_removed``.

    A null text stays null, an empty one empty; lines without a word stay where they are. Rows of the
    same id and text are one document and keep the same lines. An empty table gives an empty result.
    """
    gone = repeated_lines(docs).groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_set(F.struct("line_no", "id")).alias("gone")
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = whole.join(stored(gone, "gone"), F.col("doc.doc_id").cast("long").eqNullSafe(F.col("of")), "left")
    cut = F.arrow_udf(_without, "text string, n_lines long, n_removed long")
    return joined.select("doc", cut("doc.text", "gone").alias("c")).select("doc", "c.*")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines left in ``text``; documents that lose their last word go."""
    columns = docs.columns
    cut = without_repeated_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = {c: F.col(f"doc.`{c}`") for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(out["n_chars"])
    return cut.select(*[out[c].alias(c) for c in columns])
