"""Language-model scores of documents by stupid backoff, from counts over all of them.

Documents are read once into blocks: word numbers and a block's own vocabulary of hashed
words. Each block sends its distinct n-grams with their counts to the count table, which is partitioned
by the n-gram's hash; a partition adds up and answers every block in the order it asked, so that
only counts travel back. A block then joins the answers to the n-grams of its documents and sums the
scores of each. A frequent n-gram is one entry a block, so no partition is hot.

A document is no evidence for itself: its own counts are taken off before it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, spread

ORDER = 2
BACKOFF = 0.4
ROWS = 2000
_MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()),
     ("vocabulary", pa.binary())]
)
SCORE = "doc_id long, n_words long, n_backed_off long, log_score double"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def packed(numbers: np.ndarray) -> bytes:
    """Small numbers in few bytes: their bytes place by place, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def blocks(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row for up to ``rows`` documents: ids, sizes, word numbers, hashes of the words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            seen: dict[bytes, int] = {}
            sizes, parts = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                sizes.append(len(words))
                parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint32))
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in seen], dtype=np.uint64)
            words = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            cells = [
                [number], [batch.column("doc_id").to_pylist()], [np.array(sizes, np.int64).tobytes()],
                [packed(words)], [hashes.tobytes()],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, BLOCK)], schema=BLOCK)
            number += 1

    schema = "block long, doc_ids array<long>, sizes binary, words binary, vocabulary binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, schema)


class Grams:
    """The n-grams of one block: for each order, a key per place and the block's distinct keys."""

    def __init__(self, sizes: bytes, words: bytes, vocabulary: bytes, order: int):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.words = unpacked(words, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(self.words)) - starts[self.doc]  # place of a word in its document
        hashes = np.frombuffer(vocabulary, np.uint64)
        self.number = [self.words]  # by order, the number of the n-gram that ends at a place
        self.keys = [_mixed(hashes + np.uint64(1))]
        self.counts = [np.bincount(self.words, minlength=len(hashes))]
        for n in range(2, order + 1):
            long_enough = self.at >= n - 1
            last = self.words[long_enough]
            before = self.number[-1][np.flatnonzero(long_enough) - 1]
            pairs, inverse, counts = np.unique(before * len(hashes) + last, return_inverse=True, return_counts=True)
            number = np.full(len(self.words), -1, np.int64)
            number[long_enough] = inverse
            width = max(1, len(hashes))
            key = _mixed(self.keys[-1][pairs // width] * _MIX + hashes[pairs % width] + np.uint64(n))
            self.number.append(number)
            self.keys.append(key)
            self.counts.append(counts)
        self.all_keys = np.concatenate(self.keys)
        self.all_counts = np.concatenate(self.counts).astype(np.uint32)

    def parts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending order of the distinct keys, and where each of ``n`` ranges of them ends."""
        places = np.argsort(self.all_keys)
        part = ((self.all_keys[places] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        return places, np.cumsum(np.bincount(part, minlength=n))

    def own(self, n: int) -> np.ndarray:
        """For each place, how often its document has the n-gram that ends there."""
        number = self.number[n - 1]
        width = len(self.keys[n - 1]) + 1
        _, inverse, counts = np.unique(self.doc * width + number + 1, return_inverse=True, return_counts=True)
        return counts[inverse]


def score_block(grams: Grams, totals: np.ndarray, n_tokens: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log scores and numbers of backed-off words, by document.

    The longest n-gram that other documents have decides, with a factor for each step back. A word
    that no other document has counts as a part of one occurrence.
    """
    others, at = [], 0
    for n in range(1, order + 1):
        size = len(grams.keys[n - 1])
        count = np.append(totals[at : at + size], 0)[grams.number[n - 1]]
        others.append(np.where(grams.number[n - 1] >= 0, count - grams.own(n), 0))
        at += size
    rest = n_tokens - grams.sizes[grams.doc]
    log = np.full(len(grams.words), np.nan)
    back = np.zeros(len(grams.words), np.int64)
    steps = 0.0
    for n in range(order, 0, -1):
        found = np.isnan(log) & (others[n - 1] > 0)
        where = np.flatnonzero(found)
        under = rest[where] if n == 1 else others[n - 2][where - 1]
        log[where] = steps + np.log(others[n - 1][where] / under)
        able = grams.at >= n - 1
        if n > 1:
            back += np.isnan(log) & able & (n == order)
        steps += np.log(BACKOFF)
    log[np.isnan(log)] = 0
    unseen = others[0] == 0
    log[unseen] = (np.log(BACKOFF) * order - np.log(rest + 1.0))[unseen]
    n_docs = len(grams.sizes)
    return np.bincount(grams.doc, log, n_docs), np.bincount(grams.doc, back, n_docs).astype(np.int64)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, n_backed_off, log_score`` (natural logarithm, summed over the words).

    A row for each input row. A null or empty text has no words and score 0. The first words of a document,
    which lack a context, start from shorter n-grams, at the same factor. Rows of the same id
    are documents of their own. An empty table gives an empty result. The number of the count table's
    partitions follows the shuffle partitions, and their size the input.
    """
    spark = docs.sparkSession
    parts = spread(spark, 2)
    n_tokens = docs.agg(F.sum(n_words("text")).alias("n")).first().n or 0
    # Both readers take all columns, so that the blocks are made and dealt out once.
    held = blocks(docs).repartition(spread(spark), "block")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                grams = Grams(row.sizes, row.words, row.vocabulary, order)
                places, ends = grams.parts(parts)
                keys, counts = grams.all_keys[places], grams.all_counts[places]
                cut = [slice(a, b) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
                yield pd.DataFrame({
                    "part": np.arange(parts, dtype=np.int32), "block": row.block,
                    "keys": [packed(np.diff(keys[c], prepend=np.uint64(0))) for c in cut],
                    "counts": [packed(counts[c]) for c in cut],
                })

    def add_up(asked: pd.DataFrame) -> pd.DataFrame:
        every = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in asked["keys"]]
        counts = np.concatenate([unpacked(c, np.uint32) for c in asked["counts"]])
        _, inverse = np.unique(np.concatenate(every), return_inverse=True)
        totals = np.bincount(inverse, counts)[inverse].astype(np.uint64) if len(counts) else np.zeros(0, np.uint64)
        ends = np.cumsum([len(k) for k in every])
        answers = [packed(totals[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
        return pd.DataFrame({"block": asked["block"], "part": asked["part"], "totals": answers})

    def answer(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        grams = Grams(row.sizes, row.words, row.vocabulary, order)
        places, _ = grams.parts(parts)
        totals = np.empty(len(places), np.int64)
        ordered = answers.sort_values("part")["totals"]
        totals[places] = np.concatenate([unpacked(t, np.uint64) for t in ordered]).astype(np.int64)
        logs, back = score_block(grams, totals, n_tokens, order)
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64"),
            "n_words": grams.sizes, "n_backed_off": back, "log_score": logs,
        })

    asked = held.mapInPandas(ask, "part int, block long, keys binary, counts binary")
    answers = asked.groupBy("part").applyInPandas(add_up, "block long, part int, totals binary")
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(answer, SCORE)
