"""Exact Jaccard join of documents on five-word shingles.

Two sets with a similarity of 0.8 share one of the first fifth of their shingles in any fixed order
(here: by hash), so documents meet by those. Documents that meet are dealt to bands of similar size, cut
into tiles. In a tile, bitmaps of hashed shingles bound the overlap from above by counting bits; pairs
that pass are verified by intersecting the sorted arrays. Documents with equal sets are
one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stored
from .links import PERCENT, AlikeSets, Bitmaps, Relation, bitmap, bounded, components, connect

WORDS = 5
ROWS = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BAND = math.log(100 / PERCENT)


class Shingler:
    """Sorted arrays of the 64-bit hashes of a text's distinct five-word shingles."""

    limit = 200_000  # remembered words

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.array([known[w] for w in words], dtype=np.uint64)
        size = min(WORDS, len(words))
        gram = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            gram = (gram + hashes[k : k + len(gram)]) * _MIX
            gram ^= gram >> np.uint64(31)
        return np.unique(gram)


def signature(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


class BitmapBound(Relation):
    """Pairs that the bitmaps alone can't rule out. A body is the size, then the bits."""

    tile = 2048

    def prepare(self, bodies: list[bytes]) -> Bitmaps:
        sizes = [int.from_bytes(b[:8], "little") for b in bodies]
        return Bitmaps(sizes, [8 * (len(b) - 8) for b in bodies], [bytes(b[8:]) for b in bodies])

    def matches(self, prepared: Bitmaps, one: int, others: np.ndarray) -> np.ndarray:
        return prepared.may_link(one, others)

    def table(self, prepared: Bitmaps, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        return prepared.table(some, others)


class AlikeDocuments(AlikeSets):
    """A body is the sorted array itself."""

    def sets(self, bodies: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(b, dtype=np.uint64) for b in bodies]


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, id, tokens``: equal sets have equal ids; no words, no id.

    ``tokens`` are the first shingles of the set, once a batch for equal sets.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            done: set[int] = set()
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids, sizes, tokens = [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text)
                    own = signature(found) if len(found) else None
                    fresh = own is not None and own not in done
                    done.add(own)
                    ids.append(own)
                    sizes.append(len(found))
                    tokens.append(found[: prefix_size(len(found)) if fresh else 0])
                ends = np.cumsum([0, *map(len, tokens)])
                flat = pa.array(np.concatenate(tokens).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    names=["doc_id", "text_hash", "n_shingles", "id", "tokens"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, id long, tokens array<long>")


def banded_groups(sets: DataFrame) -> DataFrame:
    """``group, id``: ids that share a token of their prefixes and are in the same or the next band of sizes.

    Group k of a token has bands k - 1 and k; sizes that may be linked differ by one band at most.
    """
    rows = sets.select("id", F.col("n_shingles").alias("n"), F.explode("tokens").alias("token"))
    rows = rows.repartition(spread(sets.sparkSession), "token").groupBy("token", "id").agg(F.first("n").alias("n"))
    shared = rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("k > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(_BAND))
    twice = stored(shared.select("token", "id", band.alias("band")), "shared")
    twice = twice.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    return twice.select(F.xxhash64("token", "band").alias("group"), "id")


def bodies(docs: DataFrame, sets: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """``id, body`` of the wanted ids: sorted arrays, or sizes and bitmaps, from one document of each id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            if kind == "set":
                cells = [s.tobytes() for s in found]
            else:
                cells = [len(s).to_bytes(8, "little") + bitmap(s)[1] for s in found]
            ids = pa.array([signature(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(cells, pa.binary())], names=["id", "body"])

    one = sets.join(bounded(wanted), "id").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"))
    one = stored(one.select(F.col("d.doc_id").alias("of"), F.col("d.text_hash").alias("hash")), "holders")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash"))
    made = texts.join(bounded(one), same, "left_semi").select("text").mapInArrow(make, "id long, body binary")
    return made.groupBy("id").agg(F.min("body").alias("body")) if kind != "set" else made.dropDuplicates(["id"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, is_first``, a row for each input row.

    ``component_id`` is the smallest document id reachable by links of 0.8 or more; every link between
    different texts counts. A document without words is linked with nothing; its component is its
    own id. ``is_first`` marks the row that stands for its component (smallest id, then smallest hash of
    the text). Null ids are never the smallest. An empty table gives an empty result.
    """
    sets = stored(document_sets(docs), "sets")
    groups = stored(banded_groups(sets).distinct(), "banded")
    maybe = stored(groups.select("id").distinct(), "maybe")
    rough = connect(groups, stored(bodies(docs, sets, maybe, "bitmap"), "bitmaps"), BitmapBound())
    clusters = stored(components(rough).select(F.col("root").alias("group"), "id"), "clusters")
    exact = connect(clusters, stored(bodies(docs, sets, clusters.select("id"), "set"), "arrays"), AlikeDocuments())
    roots = components(exact)
    classes = sets.join(bounded(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = stored(classes.select("doc_id", "text_hash", "n_shingles", "root"), "classes")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = classes.filter("root is not null").groupBy("root").agg(F.min(row).alias("first"))
    joined = classes.join(stored(first, "firsts"), "root", "left")
    alone = F.col("root").isNull()
    return joined.select(
        "doc_id", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        "text_hash", (alone | (row == F.col("first"))).alias("is_first"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their components; of rows alike in id and text, one."""
    stays = near_duplicates(docs).filter("is_first").select(
        F.col("doc_id").alias("of"), F.col("text_hash").alias("hash")
    )
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    held = held.withColumn("own_id", F.col(names["doc_id"]).cast("long")).withColumn("own_hash", F.xxhash64(names["text"]))
    same = F.col("own_id").eqNullSafe(F.col("of")) & F.col("own_hash").eqNullSafe(F.col("hash"))
    kept = held.join(stored(stays.distinct(), "stays"), same, "left_semi")
    alike = Window.partitionBy("own_id", "own_hash").orderBy("own_hash")
    kept = kept.withColumn("copy", F.row_number().over(alike)).filter("copy = 1")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
