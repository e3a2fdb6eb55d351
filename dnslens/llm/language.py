"""Language identification by string kernels.

The kernel of two texts is the number of distinct character n-grams (orders 1 to 4 blended)
that both contain, divided by the root of the product of their own numbers. Landmark texts
give Nyström features, on which one ridge regression per language (one against the rest) is
solved. As the kernel is a scalar product of presence vectors, landmarks and weights multiply
out to one table, n-grams by languages; documents are scored in batches, presence matrix
times that table.

n-grams are hashed to 2^16 places, so presence vectors are bitmaps of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PLACES = 1 << 16
ORDERS = 4
PER_LANGUAGE = 400
SAMPLE_ROWS = 2000
LANDMARKS = 256
RIDGE = 0.1
ROWS = 64
SLICE = 512  # rows of a batch whose texts are held as strings at a time
STRIP = 256  # bytes of bitmaps, unpacked at once
UNKNOWN = "und"
MIN_SCORE = 0.1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def presence(texts: list[str], out: np.ndarray | None = None) -> np.ndarray:
    """Rows of 0 and 1 over the hashed n-grams of the lower-cased texts."""
    flags = np.zeros((len(texts), PLACES), dtype=np.uint8) if out is None else out
    for row, text in zip(flags, texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        gram = np.zeros(len(codes), dtype=np.uint64)
        for order in range(min(ORDERS, len(codes))):
            size = len(codes) - order
            gram = (gram[:size] + codes[order:]) * _MIX
            gram ^= gram >> np.uint64(29)
            row[(gram >> np.uint64(48)).astype(np.intp)] = 1
    return flags


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that only test: crc32 of the id as text leaves 2 modulo 4 (null: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _strips(*maps: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Bitmaps as rows of 0 and 1, ``STRIP`` bytes of each at a time."""
    for at in range(0, PLACES // 8, STRIP):
        yield [np.unpackbits(m[:, at : at + STRIP], axis=1).astype(np.float32) for m in maps]


def _roots(maps: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.bitwise_count(maps).sum(axis=1, dtype=np.float64), 1))


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two sets of bitmaps; they are never unpacked whole."""
    common = np.zeros((len(a), len(b)))
    for one, two in _strips(a, b):
        common += one @ two.T
    return common / _roots(a)[:, None] / _roots(b)[None, :]


def fit(bits: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the table of weights, n-grams by languages."""
    names = sorted(set(langs))
    rows = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), PLACES // 8)
    marks = rows[:LANDMARKS]
    near = _kernel(rows, marks)
    values, vectors = np.linalg.eigh(near[: len(marks)])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = near @ root
    wanted = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(np.float64)
    share = 1 / wanted.sum(axis=0)[wanted.argmax(axis=1)]  # each language weighs the same
    share = (share / share.mean())[:, None]
    gram = features.T @ (features * share) + RIDGE * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(gram, features.T @ (wanted * share)) / _roots(marks)[:, None]
    return names, np.concatenate([(strip.T @ weights).astype(np.float32) for (strip,) in _strips(marks)])


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``lang, bits``: at most ``per_language`` rows a language and ``rows`` in all.

    The bound holds at every size of the input. Rows are picked by a hash of the id among those with a
    letter and a language that are not held out, so the pick follows neither order nor source.
    """
    able = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = able.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(8)).alias("pick"))
    # First thin every language to a few times its part, so that the ranking below sorts as little at any size.
    sizes = stored(keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    draw = F.pmod("pick", F.lit(1 << 32)) / float(1 << 32)
    keyed = keyed.join(sizes, "lang").filter(draw * F.col("n") <= 4 * per_language + 100).drop("n")
    first = Window.partitionBy("lang").orderBy("pick", "doc_id")
    ranked = keyed.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_language)
    chosen = stored(ranked.orderBy("rank", "lang").limit(rows).select("doc_id", "rank"), "lang-sample")
    chosen = chosen.groupBy("doc_id").agg(F.min("rank").alias("rank"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                bits = np.packbits(presence(list(part["text"])), axis=1)
                yield pd.DataFrame({"rank": part["rank"], "lang": part["lang"], "bits": [b.tobytes() for b in bits]})

    texts = able.select("doc_id", "lang", "text").join(chosen, "doc_id").drop("doc_id")
    packed = texts.mapInPandas(pack, "rank int, lang string, bits binary")
    return packed.orderBy("rank", "lang", "bits").limit(rows)


class Model:
    """A fitted table; without one nothing is named."""

    def __init__(self, names: list[str], weights: np.ndarray | None):
        self.names, self.weights = names, weights

    def classify(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text, in matrix products of ``ROWS`` texts."""
        label, best = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        able = [i for i, t in enumerate(texts) if self.names and has_letter(t)]
        flags = np.empty((min(ROWS, len(able)), PLACES), dtype=np.uint8)
        for i in range(0, len(able), ROWS):
            rows = able[i : i + ROWS]
            flags[:] = 0
            seen = presence([texts[r] for r in rows], flags[: len(rows)]).astype(np.float32)
            value = (seen @ self.weights) / np.sqrt(seen.sum(axis=1))[:, None]
            label[rows] = np.array(self.names, dtype=object)[value.argmax(axis=1)]
            best[rows] = np.clip(value.max(axis=1), 0, 1)
        return label, best


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> Model:
    """The model of ``docs``, fitted by the task that has the sample; only names and weights come to the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else []
        if len(sample):
            names, weights = fit(sample["bits"].to_pylist(), sample["lang"].to_pylist())
            columns = [pa.array(names), pa.array([np.ascontiguousarray(w).tobytes() for w in weights.T], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "weights"])

    sample = training_sample(docs, per_language, rows).select("lang", "bits")
    schema = pa.schema([("lang", pa.string()), ("bits", pa.binary())])
    learnt = sorted(sample.mapInArrow(learn, "name string, weights binary").collect())
    return Model([r.name for r in learnt], np.stack([np.frombuffer(r.weights, np.float32) for r in learnt], axis=1) if learnt else None)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, a row for each input row; texts are scored whole.

    A text that is null or has no letter is ``und`` with score 0, and so is all if nothing can be
    learnt from. The score is the winning regression's value, cut to 0..1; ties go to the first
    language by name. The model is one table of 2^16 rows, fitted on a sample of bounded
    size (``training_sample``), whose bitmaps are 8 KB a row, by one task. An empty table
    gives an empty result; columns other than ``doc_id, text, lang`` are not read.
    """
    model = fitted(docs, per_language, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            label, best = model.classify(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(label, pa.string()), pa.array(best)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows_in = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows_in.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a language that was recognised, all columns as they are.

    Rejected are texts without a letter and those that fit no language (a score under ``min_score``);
    a short clean text scores well above it.
    """
    model = fitted(docs)

    def keep(texts: pa.Array) -> pa.Array:
        """Only texts go to Python, ``SLICE`` as strings at a time; rows stay where they are."""
        parts = [np.zeros(0, dtype=bool)]
        for at in range(0, len(texts), SLICE):
            label, best = model.classify(texts.slice(at, SLICE).to_pylist())
            parts.append((label != UNKNOWN) & (best >= min_score))
        return pa.array(np.concatenate(parts))

    return docs.filter(F.arrow_udf(keep, "boolean")("text"))
