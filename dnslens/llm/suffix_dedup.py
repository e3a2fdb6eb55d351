"""Removal of byte strings that occur earlier, found by a hash-compared suffix sort.

Every window of 100 bytes has a leading 40-byte gram, the one of least hash in it, so equal windows have the same
one at the same place. The windows of a text fall into runs with the same leading gram (its anchor). Only
anchors that occur twice matter; the bytes around them are dealt out by the gram, or by more of
the bytes that windows share where very many surround one gram. There the suffixes
from the anchors on, and the reversed ones before them, are sorted by mergesort. Two are compared through their longest
common extension, which a binary search over prefix polynomial hashes finds in a few steps;
the order is then verified byte by byte. Windows are equal where both extensions reach far enough, and
all but the first of equal windows are removed.

Texts move once; whole copies of a text are left out of the search, as their first one holds all they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stored
from .links import bounded

WINDOW = 100
GRAM = 40
SPAN = WINDOW - GRAM  # a window's anchor is 0 to SPAN bytes after its start
SEGMENT = 1 << 20
NO_ID = (1 << 63) - 1  # stands for a null id
_PLACE = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_CHECK = 1 << 17
REMEMBERED = 200_000
CROWD = 10_000  # contexts of one gram that are searched in one task


class Powers:
    """Powers of the hash's base and of its inverse modulo 2^64, as many as were asked for."""

    power = np.ones(1, dtype=np.uint64)
    inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.power) < n:
            grown = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            cls.power, cls.inverse = grown
        return cls.power[:n], cls.inverse[:n]


class Hashed:
    """Polynomial hashes of all substrings of a buffer, by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.data = data
        power, self.inverse = Powers.upto(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]

    def grams(self, size: int) -> np.ndarray:
        """Mixed hashes of all substrings of one size."""
        n = len(self.data) - size + 1
        h = (self.prefix[size:] - self.prefix[:n]) * self.inverse[:n]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at ``a`` and ``b``, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, anchor, first and last window start of every run in a buffer of texts that end at ``ends``."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < WINDOW:
        return none, none, none, none
    grams = Hashed(data).grams(GRAM)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.arange(len(least))
    inside = np.flatnonzero(starts + WINDOW <= ends[np.searchsorted(ends, starts, side="right")])
    if not len(inside):
        return none, none, none, none
    anchor = (least[inside] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    at = anchor[first]
    return grams[at].view(np.int64), at, inside[first], inside[last]


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of whole short texts or of a part of a long one: bytes, ends, text numbers, offsets in the text."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        for offset in range(0, len(text) - WINDOW + 1, SEGMENT):
            part = text[offset : offset + SEGMENT + WINDOW - 1]
            held.append((number, offset, part))
            size += len(part)
            if size >= SEGMENT:
                yield _buffer(held)
                held, size = [], 0
    if held:
        yield _buffer(held)


def _buffer(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    numbers, offsets, parts = zip(*held)
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends, np.array(numbers), np.array(offsets)


def suffix_order(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``data[at : at + size]`` sorted inside their groups, and each one's extension with the one before.

    Bottom-up mergesort: in each round an element's place is its place in its own run and its rank in the
    neighbouring run, found by binary search. The first of a group has -1.
    """
    hashed = Hashed(data)

    def below(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.minimum(size[x], size[y])
        common = hashed.extension(at[x], at[y], most)
        ended = common == most
        step = np.where(ended, 0, common)
        a, b = data[np.minimum(at[x] + step, len(data) - 1)], data[np.minimum(at[y] + step, len(data) - 1)]
        return np.where(ended, size[x] < size[y], a < b)

    order = np.argsort(group, kind="stable")
    _, first, counts = np.unique(group[order], return_index=True, return_counts=True)
    start = np.repeat(first, counts)
    end = start + np.repeat(counts, counts)
    local = np.arange(len(order)) - start
    width = 1
    while len(counts) and width < counts.max():
        run = local // width
        mine = start + run * width
        other = np.where(run % 2 == 0, mine + width, mine - width)
        act = np.flatnonzero(other < end)
        low, high = other[act], np.minimum(other[act] + width, end[act])
        begin, after = low.copy(), (run % 2 == 1)[act]
        x = order[act]
        while (open_ := low < high).any():
            mid = (low + high) // 2
            i = np.flatnonzero(open_)
            y = order[mid[i]]
            # An element of the right run goes after equal ones of the left run.
            lower = np.where(after[i], ~below(x[i], y), below(y, x[i]))
            low[i] = np.where(lower, mid[i] + 1, low[i])
            high[i] = np.where(lower, high[i], mid[i])
        place = np.minimum(mine[act], other[act]) + (act - mine[act]) + (low - begin)
        merged = order.copy()
        merged[place] = x
        order = merged
        width *= 2
    common = np.full(len(order), -1, dtype=np.int64)
    next_ = np.flatnonzero(local > 0)
    a, b = order[next_ - 1], order[next_]
    common[next_] = hashed.extension(at[a], at[b], np.minimum(size[a], size[b]))
    if not _verified(data, at, size, a, b, common[next_]):
        return _plain_order(data, at, size, group)
    return order, common


def _verified(data, at, size, a, b, common) -> bool:
    """Whether all neighbours agree on the extension found, and rightly differ after it."""
    for i in range(0, len(a), _CHECK):
        x, y, n = a[i : i + _CHECK], b[i : i + _CHECK], common[i : i + _CHECK]
        steps = np.arange(WINDOW)
        left = data[np.minimum(at[x][:, None] + steps, len(data) - 1)]
        right = data[np.minimum(at[y][:, None] + steps, len(data) - 1)]
        if ((left != right) & (steps < n[:, None])).any():
            return False
        rest = np.flatnonzero(n < np.minimum(size[x], size[y]))
        if (left[rest, n[rest]] >= right[rest, n[rest]]).any():
            return False
        whole = np.flatnonzero(n == np.minimum(size[x], size[y]))
        if (size[x][whole] > size[y][whole]).any():
            return False
    return True


def _plain_order(data, at, size, group) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing bytes; for the case that two different strings have one hash."""
    body = [data[p : p + n].tobytes() for p, n in zip(at, size)]
    order = np.array(sorted(range(len(at)), key=lambda i: (group[i], body[i])), dtype=np.int64)
    common = np.full(len(order), -1, dtype=np.int64)
    for k in range(1, len(order)):
        if group[order[k]] == group[order[k - 1]]:
            x, y = body[order[k - 1]], body[order[k]]
            common[k] = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    return order, common


def covered_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, around: list[bytes]) -> np.ndarray:
    """For each context, in order of occurrence, which windows also start at an earlier one.

    A context holds the bytes of the windows that start ``right`` to ``left`` bytes before its anchor. Column o
    of the result is the window that starts o bytes before.
    """
    data = np.frombuffer(b"".join(around), dtype=np.uint8)
    begin = np.cumsum([len(c) for c in around]) - [len(c) for c in around]
    at = begin + left
    right_order, right_common = suffix_order(data, at, WINDOW - right, group)
    left_order, left_common = suffix_order(data[::-1].copy(), len(data) - at, left, group)
    found = np.zeros((len(group), SPAN + 1), dtype=bool)
    after, before = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for o in range(SPAN + 1):
        able = np.flatnonzero((right <= o) & (o <= left))
        after[right_order] = np.cumsum(right_common < WINDOW - o)
        before[left_order] = np.cumsum(left_common < o)
        _, first = np.unique(after[able] * (len(group) + 1) + before[able], return_index=True)
        again = np.ones(len(able), dtype=bool)
        again[first] = False
        found[able[again], o] = True
    return found


def earlier_spans(rows: pd.DataFrame) -> pd.DataFrame:
    """``did, tie, span_from, span_to`` of the windows of one deal of contexts that occur earlier."""
    rows = rows.sort_values(["did", "tie", "at", "left"], ignore_index=True)
    known = rows["around"].isna().to_numpy()
    whole = known | rows.duplicated(["gram", "left", "around"]).to_numpy()
    left, right, at = (rows[c].to_numpy(np.int64) for c in ("left", "right", "at"))
    found = np.zeros((len(rows), SPAN + 1), dtype=bool)
    offsets = np.arange(SPAN + 1)
    found[whole] = (right[whole, None] <= offsets) & (offsets <= left[whole, None])
    rest = np.flatnonzero(~whole)
    _, group = np.unique(rows["gram"].to_numpy()[rest], return_inverse=True)
    if len(rest):
        found[rest] = covered_windows(group, left[rest], right[rest], list(rows["around"].to_numpy()[rest]))
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    return pd.DataFrame({
        "did": rows["did"].to_numpy()[row], "tie": rows["tie"].to_numpy()[row],
        "span_from": at[row] - high + 1, "span_to": at[row] - low + WINDOW,
    })


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        dids, ties = batch.column("did").to_numpy(), batch.column("tie").to_numpy()
        for data, ends, numbers, offsets in segments(_bytes(batch)):
            grams, at, first, last = anchor_runs(data, ends)
            part = np.searchsorted(ends, at, side="right")
            place = at - (ends - np.diff(ends, prepend=0))[part] + offsets[part]
            packed = (place << 12) | ((at - first) << 6) | (at - last)
            cells = [grams, dids[numbers[part]], ties[numbers[part]], packed]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["gram", "did", "tie", "place"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors, texts coming in order. ``around`` is null where this task had the same
    before: such windows are known to be repeated and need no search, so a string that very many
    texts share leaves a task once."""
    names = ["gram", "did", "tie", "at", "left", "right", "around"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    seen: set[tuple] = set()
    last = None
    for batch in _small(batches):
        if len(seen) > REMEMBERED:
            seen.clear()  # costs a search, no result
        cells: list[list] = [[] for _ in names]
        for did, tie, text, runs in zip(*(batch.column(c).to_pylist() for c in ("did", "tie", "text", "runs"))):
            if last == (last := (did, tie)):
                continue  # a row that is there twice
            body = (text or "").encode()
            for run in sorted(runs, key=lambda r: r["place"]):
                at, left, right = run["place"] >> 12, run["place"] >> 6 & 63, run["place"] & 63
                around = body[at - left : at - right + WINDOW]
                key = (left, xxhash.xxh3_128_digest(around))
                known = key in seen
                seen.add(key)
                for cell, value in zip(cells, (run["gram"], did, tie, at, left, right, None if known else around)):
                    cell.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)


def _halved(rows: DataFrame, width: int) -> DataFrame:
    """Contexts cut to windows that start in one range of ``width`` offsets; ``gram`` names the bytes such windows share."""
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("right") / width), F.floor(F.col("left") / width))))
    low = (F.col("part") * width).cast("int")
    rows = rows.withColumn("low", low).withColumn("high", F.least(F.col("low") + width - 1, F.lit(SPAN)))
    rows = rows.withColumn("was", F.col("left")).withColumn("left", F.least("left", "high")).withColumn("right", F.greatest("right", "low"))
    rows = rows.withColumn("around", F.expr(f"substring(around, was - left + 1, left - right + {WINDOW})"))
    core = F.expr(f"substring(around, left - low + 1, {WINDOW} - high + low)")
    return rows.withColumn("gram", F.xxhash64("low", "high", core)).drop("part", "low", "high", "was")


def uncrowded(near: DataFrame, often: DataFrame) -> DataFrame:
    """The contexts ``near``, with no more than CROWD different ones left under any gram.

    Contexts of a crowded gram are cut in two by the offsets of their windows, again and again. Those
    that are equal are settled at each step (``around`` null but for the first): this leaves one of all
    parts inside a shared passage. Windows of the other parts share more bytes than the gram, by which they are
    dealt instead. Parts of one window are equal if they share their bytes, so no crowd is left at the end.
    """

    def crowded(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {CROWD}").select("gram"), "crowded")

    hot = crowded(often)
    if not hot.take(1):
        return near
    near = stored(near, "contexts")
    parts = [near.filter("around is null"), near.filter("around is not null").join(bounded(hot), "gram", "left_anti")]
    rest = near.filter("around is not null").join(bounded(hot), "gram", "left_semi")
    columns, place = near.columns, ["did", "tie", "at"]
    salt = F.pmod(F.xxhash64("did"), F.lit(spread(near.sparkSession, 4)))
    for width in (64, 32, 16, 8, 4, 2, 1):
        rest = rest if width > SPAN else _halved(rest, width)
        # First of the equal ones with one salt, then of those that are left: a passage that all texts share is dealt too.
        nth = F.row_number().over(Window.partitionBy("left", "around", "salt").orderBy(*place))
        rest = stored(rest.withColumn("salt", salt).withColumn("nth", nth), "parts")
        again = F.row_number().over(Window.partitionBy("left", "around").orderBy(*place))
        firsts = stored(rest.filter("nth = 1").withColumn("nth", again), "firsts")
        for settled in (rest, firsts):
            parts.append(settled.filter("nth > 1").withColumn("around", F.lit(None).cast("binary")))
        firsts = firsts.filter("nth = 1")
        hot = crowded(firsts)
        parts.append(firsts.join(bounded(hot), "gram", "left_anti"))
        if not hot.take(1):
            break
        rest = firsts.join(bounded(hot), "gram", "left_semi")
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in KEPT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in _small(batches):
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "is_copy", "spans"))
        for body, doc_id, is_copy, spans in zip(_bytes(batch), *columns):
            gone = [[0, len(body)]] if is_copy and len(body) >= WINDOW else []
            for span in sorted((s["span_from"], s["span_to"]) for s in spans or []):
                if gone and span[0] <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], span[1])
                else:
                    gone.append(list(span))
            bounds = [0, *(x for span in gone for x in span), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            rows.append((doc_id, len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left), a row for each input row.

    Removed is every byte in a 100-byte string that also starts earlier: in a document of smaller id, or before
    in the same. A null text counts as empty; texts under 100 bytes stay whole. Null ids come last. Rows
    of the same id and text are one document and have the same result; of the same id and different
    texts, they are ordered by a hash of the text. An empty table gives an empty result.
    """
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(did.alias("did"), F.xxhash64("text").alias("tie"), "text")
    hashes = stored(rows.select("did", "tie", F.xxhash64(F.lit(1), "text").alias("more"), F.octet_length("text").alias("size")), "hashes")
    text = ["tie", "more", "size"]
    first = hashes.groupBy(*text).agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = hashes.join(first, text).filter(f"did > first and size >= {WINDOW}").select("did", "tie").distinct()
    copies = stored(copies, "copies")

    alone = rows.join(bounded(copies), ["did", "tie"], "left_anti")
    anchors = alone.mapInArrow(_anchors, "gram long, did long, tie long, place long")
    often = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("n > 1").drop("n")
    often = stored(often, "anchors")

    # Read twice with the same columns, so that texts are dealt out once.
    dealt = rows.repartition(spread(docs.sparkSession), "did", "tie")
    runs = often.groupBy("did", "tie").agg(F.collect_set(F.struct("gram", "place")).alias("runs"))
    near = dealt.join(runs, ["did", "tie"]).sortWithinPartitions("did", "tie").mapInArrow(
        _contexts, "gram long, did long, tie long, at long, left int, right int, around binary"
    )
    near = uncrowded(near, often)
    # What needs no search is dealt by document, so that a frequent gram stays small.
    by = F.when(F.col("around").isNull(), F.xxhash64("did", "at")).otherwise(F.col("gram"))
    deal = F.pmod(by, F.lit(spread(docs.sparkSession, 4)))
    spans = near.withColumn("deal", deal).groupBy("deal").applyInPandas(
        earlier_spans, "did long, tie long, span_from long, span_to long"
    )
    spans = spans.groupBy("did", "tie").agg(F.collect_set(F.struct("span_from", "span_to")).alias("spans"))
    copied = copies.withColumn("is_copy", F.lit(True))
    joined = dealt.join(spans, ["did", "tie"], "left").join(copied, ["did", "tie"], "left")
    doc_id = F.nullif(F.col("did"), F.lit(NO_ID)).alias("doc_id")
    return joined.select(doc_id, "text", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "spans").mapInArrow(_cut, KEPT)
