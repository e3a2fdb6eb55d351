"""Mixing sources to target weights.

The words of each source, documents in a pseudorandom order one after the other, are cut into
blocks of a fixed length. A source's target decides how many words the mix takes from it: some
full passes over its blocks and a part of one more. Each pass visits the blocks in an order of
its own, a pseudorandom permutation of their indexes, and the slots of all sources together are
permuted over the output shards. Given the totals, a shard's counts by source are therefore a
multinomial draw conditioned on those totals, which are met to the word. Slots and blocks are
joined by index.

Only built-in functions are used. Texts are read to count their words and do not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, spread, stored

MAX_PASSES = 3
BLOCK_WORDS = 512
SHARD_BLOCKS = 1024
ROUNDS = 16
CHUNK = 4096
WEIGHTS = (5, 2, 1)
ROW = ["doc_id", "source", "text_hash", "copy"]


def permuted(x: Column, n: Column, *key: Column | str) -> Column:
    """``x`` in 0..n-1 through a keyed pseudorandom permutation of that range.

    Swap-or-not rounds (Hoang, Morris, Rogaway 2012): each one pairs the indexes up and swaps a pair
    or not by a hash of it, so that it is one to one for every ``n``.
    """

    def swap(at: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("pair"), turn, *key), n) - at, n)
        heads = F.xxhash64(F.lit("coin"), turn, F.greatest(at, partner), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(heads, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_hash`` and ``copy``, which number rows that are alike from 1."""
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    alike = Window.partitionBy("doc_id", "source", "text_hash").orderBy("text_hash")
    return hashed.withColumn("copy", F.row_number().over(alike))


def repeating_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` with ``sid`` (place by code point, null last) and ``weight``.

    The numbering is one window over a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("sid", (F.row_number().over(order) - 1).cast("long"))
    cycle = F.array(*map(F.lit, weights))
    return numbered.withColumn("weight", F.get(cycle, (F.col("sid") % len(weights)).cast("int")).cast("double"))


def targets(weighted: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Adds ``target``: shares of all words by weight, none above ``max_passes`` times its source.

    What a capped source can't take is shared again by weight, in rounds, until none is above. A
    round takes two sums to the driver.
    """
    cap = F.col("source_size") * float(max_passes)
    total = weighted.agg(F.sum("source_size").alias("n")).first().n or 0
    level, at = None, 0.0
    while True:
        free = F.lit(True) if level is None else F.col("weight") * at <= cap
        sums = weighted.agg(
            F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(~free, cap)).alias("capped")
        ).first()
        if not sums.weight:
            break
        at = (total - (sums.capped or 0.0)) / sums.weight
        if at == level:
            break
        level = at
    return weighted.withColumn("target", F.least(F.col("weight") * F.lit(at), cap))


class Mix:
    """The mix of ``docs`` (``doc_id, text, source``; other columns are ignored).

    ``documents``: a row for each input row with ``size, source_size, target`` and its place
    in its source's words. ``sources``: a row for each source. ``spans``: the mix itself, a row
    for each part of a document in a slot of an output shard.

    Null and empty texts have size 0 and are in no span. A null source is a source. Rows that
    are alike are taken one by one. Empty tables give empty results. The order depends on
    hashes of the rows alone, so reruns agree.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS):
        self.block_words = block_words
        picked = docs.select("doc_id", "source", "text")
        sized = picked.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words("text").alias("size"))
        sized = stored(sized, "sizes")
        totals = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
        shared = targets(stored(repeating_weights(totals, weights), "weights"))
        words = F.least(F.round("target").cast("long"), F.col("source_size") * MAX_PASSES)
        self.sources = stored(
            shared.withColumn("words", words)
            .withColumn("passes", F.expr("CASE WHEN source_size > 0 THEN words DIV source_size ELSE 0 END"))
            .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
            .withColumn("full_blocks", F.expr(f"source_size DIV {block_words}"))
            .withColumn("tail", F.col("source_size") % block_words),
            "sources",
        )
        self.documents = stored(self._placed(sized), "placed")

    def _placed(self, sized: DataFrame) -> DataFrame:
        """Every row's ``start`` in its source's words: places in hashed buckets, shifted by what is before."""
        alike = Window.partitionBy("doc_id", "source", "text_hash").orderBy("size")
        rows = sized.withColumn("copy", F.row_number().over(alike))
        info = self.sources.select(F.col("source").alias("s"), "sid", "source_size", "target")
        rows = rows.join(info, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        rows = rows.withColumn("order", F.xxhash64("doc_id", "text_hash", "copy"))
        rows = rows.withColumn("bucket", F.pmod("order", F.lit(spread(sized.sparkSession, 4))))
        own = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "text_hash", "copy")
        inside = rows.withColumn("before", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        inside = stored(inside, "ordered")
        earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        shift = inside.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
        shift = shift.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
        placed = inside.join(shift, ["sid", "bucket"])
        return placed.select(
            *ROW, "size", "sid", "source_size", "target", (F.col("shift") + F.col("before")).alias("start")
        )

    def slots(self) -> DataFrame:
        """``sid, pass, block, length, shard, slot``: which block each slot takes, and how much of it."""
        b = self.block_words
        passes = self.sources.select(
            "sid", "full_blocks", "tail", F.posexplode(
                F.transform(
                    F.sequence(F.lit(0).cast("long"), F.col("passes").cast("long")),
                    lambda p: F.when(p < F.col("passes"), F.col("source_size")).otherwise(F.col("rest")),
                )
            ).alias("pass", "want"),
        ).filter("want > 0")
        passes = passes.withColumn("n", F.ceil(F.col("want") / b))
        before = Window.orderBy("sid", "pass").rowsBetween(Window.unboundedPreceding, -1)
        passes = passes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        passes = passes.withColumn("slots", F.sum("n").over(Window.partitionBy()))
        chunks = passes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
        chunks = chunks.repartition(spread(self.sources.sparkSession), "sid", "pass", "chunk")
        last = F.least(F.col("n") - 1, F.col("chunk") * CHUNK + CHUNK - 1)
        k = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
        turn = permuted(F.col("k"), F.col("full_blocks"), F.col("sid"), F.col("pass"))
        block = F.when(F.col("k") < F.col("full_blocks"), turn).otherwise(F.col("full_blocks"))
        place = permuted(F.col("first") + F.col("k"), F.col("slots"), F.lit("shard"))
        return k.select(
            "sid", "pass", block.alias("block"),
            F.least(F.col("want") - F.col("k") * b, F.lit(b)).alias("length"), place.alias("place"),
        ).select(
            "sid", "pass", "block", "length",
            F.floor(F.col("place") / SHARD_BLOCKS).alias("shard"), (F.col("place") % SHARD_BLOCKS).alias("slot"),
        )

    def spans(self) -> DataFrame:
        """``shard, slot, pass`` and the row's identity, with ``word_from, word_to`` inside its text."""
        b = self.block_words
        end = F.col("start") + F.col("size")
        parts = self.documents.filter("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b)))
        )
        base = F.col("block") * b
        joined = parts.join(self.slots(), ["sid", "block"])
        upto = F.least(end, base + F.col("length"))
        spans = joined.withColumn("word_from", F.greatest("start", base) - F.col("start"))
        spans = spans.withColumn("word_to", upto - F.col("start")).filter("word_to > word_from")
        return spans.select("shard", "slot", "pass", *ROW, "size", "word_from", "word_to")

    def taken(self) -> DataFrame:
        """``documents`` with ``taken``: the words of each row in the mix, repeats counted."""
        used = self.spans().groupBy(*ROW).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
        used = used.select(*[F.col(c).alias(f"u_{c}") for c in ROW], "taken")
        same = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in ROW]
        on = same[0] & same[1] & same[2] & same[3]
        return self.documents.join(used, on, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents, columns as in ``docs``: a row for each pass that takes words of a row.

    A row taken whole keeps its text; one taken in part keeps the taken words in order, each with the
    blanks after it. Rows without words are in no mix. ``n_chars``, where there is one, is set anew.
    """
    columns = docs.columns
    spans = Mix(docs, weights).spans()
    parts = spans.groupBy(*ROW, "pass").agg(
        F.first("size").alias("mix_size"),
        F.sum(F.col("word_to") - F.col("word_from")).alias("mix_taken"),
        F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("mix_ranges"),
    )
    parts = parts.select(*[F.col(c).alias(f"u_{c}") for c in ROW], "mix_size", "mix_taken", "mix_ranges")
    names = {c: f"in_{i}" for i, c in enumerate(columns)}  # own names, whatever the table's columns are called
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keyed = held.select("*", *[F.col(names[c]).alias(c) for c in ("doc_id", "source", "text")])
    keyed = numbered_rows(keyed)
    same = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in ROW]
    joined = keyed.join(parts, same[0] & same[1] & same[2] & same[3])
    whole = F.col("mix_taken") == F.col("mix_size")
    words = F.split(F.col("text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)  # blanks before the first word
    # A column of its own, and used twice below: inlined, the text would be split for every range.
    joined = joined.withColumn("mix_words", F.when(~whole, words)).withColumn("mix_lead", lead)
    most = F.size("mix_words")

    def cut(r: Column) -> Column:
        first, last = r.word_from + F.col("mix_lead"), F.least(r.word_to + F.col("mix_lead"), most)
        return F.slice("mix_words", (first + 1).cast("int"), (last - first).cast("int"))

    part = F.array_join(F.flatten(F.transform("mix_ranges", cut)), "")
    text = F.when(whole, F.col("text")).otherwise(part)
    joined = joined.withColumn("mix_text", text)
    out = {c: F.col(n) for c, n in names.items()} | {"text": F.col("mix_text")}
    if "n_chars" in columns:
        out["n_chars"] = F.length("mix_text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) for c in columns])
