"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs.

Every paragraph (line) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors modulo powers of two. So the order of paragraphs does not matter, and
a paragraph is inserted or deleted by adding or subtracting its vector, without the text.

A vector has two parts:

* 16 lanes modulo 2^32, cut from the paragraph's SHA-512: texts with the same multiset of paragraphs
  agree, others differ.
* 64 lanes modulo 2^32, each the number of the paragraph's five-word shingles with that bit set
  in their hash (fewer words: the paragraph is one shingle). Twice a lane less the number of shingles is
  a random projection of the shingle counts, so two fingerprints also tell how alike texts are.

Only built-in functions are used.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

SHINGLE = 5
EXACT = 16
PAIRS = 32  # a sum holds two lanes of 32 bits
LOW = 0x100000001
BLANKS = r"[\x20\x09-\x0D]+"


def _exact_lane(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def shingles(words: str) -> Column:
    """Hashes of all runs of five in a column of word hashes; fewer words count as one run.

    The column must be one of a projection of its own: an expression would be made anew for every run.
    """
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(none)


def lane_sums() -> list[Column]:
    """Aggregates over ``digest`` (null but at a paragraph's first row) and ``shingle``."""
    exact = [F.sum(F.coalesce(_exact_lane(F.col("digest"), i), F.lit(0))) for i in range(EXACT)]
    bits = [F.sum(F.shiftrightunsigned("shingle", i).bitwiseAND(F.lit(LOW))) for i in range(PAIRS)]
    named = [F.pmod(c, F.lit(1 << 32)).alias(f"e{i}") for i, c in enumerate(exact)]
    return named + [c.alias(f"b{i}") for i, c in enumerate(bits)] + [F.count("shingle").alias("n_shingles")]


def _lanes(prefix: str) -> list[Column]:
    exact = [F.col(f"{prefix}.e{i}") for i in range(EXACT)]
    pairs = [F.col(f"{prefix}.b{i}") for i in range(PAIRS)]
    halves = [h for p in pairs for h in (p.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(p, 32))]
    return exact + halves


def vector_of(prefix: str) -> Column:
    """The 80 lanes of an aggregated struct as ``array<bigint>``."""
    return F.array(*[F.coalesce(c, F.lit(0)) for c in _lanes(prefix)])


def added(a: Column, b: Column) -> Column:
    """Fingerprint vector of two multisets together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(1 << 32)))


def removed(a: Column, b: Column) -> Column:
    """Fingerprint vector of a multiset without another that it contains."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(1 << 32)))


def as_text(vector: Column) -> Column:
    """A vector as hexadecimal text, eight digits a lane."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """0 to 1: twice the common shingles over all shingles, as the projections estimate them.

    Equal vectors give 1, also those of texts without words.
    """
    wide = lambda v, n: F.transform(F.slice(v, EXACT + 1, 2 * PAIRS), lambda x: (2 * x - n).cast("double"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    va, vb = wide(a, na), wide(b, nb)
    apart = square(F.zip_with(va, vb, lambda x, y: x - y))
    whole = square(va) + square(vb)
    near = F.when(whole > 0, 1 - apart / whole).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and a struct ``print`` of lane sums, a row for each distinct ``keys``.

    Rows of the same keys are added up as one multiset. A null or empty text has no paragraph with
    words: its lanes come from one empty paragraph. Shingles are made and counted where the texts lie.
    """
    lines = texts.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line"))
    words = F.transform(F.filter(F.split("line", BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w))
    hashed = lines.select(*keys, F.sha2("line", 512).alias("digest"), words.alias("words"))
    hashed = hashed.select(*keys, "digest", shingles("words").alias("found"))
    rows = hashed.select(*keys, "digest", F.posexplode_outer("found").alias("at", "shingle"))
    first = F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("digest"))
    sums = rows.select(*keys, first.alias("digest"), "shingle").groupBy(*keys).agg(*lane_sums())
    return sums.select(*keys, F.struct(*[c for c in sums.columns if c not in keys]).alias("print"))


def _slice_bounds(ids: DataFrame, n: int) -> list[tuple[int, int]]:
    """Smallest and largest key of up to ``n`` consecutive ranges; two numbers a range reach the driver."""
    ranged = ids.repartitionByRange(n, "key")
    found = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return sorted((r.lo, r.hi) for r in found.collect())


def _slice_of(key: Column, lows: list[int]) -> Column:
    """Index of the last bound not above ``key``, by halving steps."""
    bounds = F.array(*[F.lit(x).cast("long") for x in lows])
    steps = F.sequence(F.lit(1), F.lit(max(1, len(lows)).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi + 1) / 2).cast("int")
        up = F.get(bounds, mid) <= key
        return F.struct(F.when(up, mid).otherwise(s.lo).alias("lo"), F.when(up, s.hi).otherwise(F.greatest(mid - 1, s.lo)).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(lows) - 1).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s.lo)


def with_next(docs: DataFrame) -> DataFrame:
    """``slice, key, tie, guard, doc_id, text, next_text``: every text beside that of the next document.

    Next is by descending id; after the last comes the first. Rows are dealt to id ranges, several to a shuffle
    partition, and each range also gets the last rows of the range below as guards, so texts move
    once and no range is larger than another. Null ids come last; equal ids follow a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = _slice_bounds(rows.select(key.alias("key")), spread(docs.sparkSession, 8))
    if not bounds:
        return rows.withColumns({"slice": F.lit(0), "key": key, "tie": F.lit(0), "guard": F.lit(False), "next_text": F.col("text")})
    keyed = rows.withColumn("key", key).withColumn("home", _slice_of(F.col("key"), [lo for lo, _ in bounds]))
    highs = F.array(*[F.lit(hi).cast("long") for _, hi in bounds])
    above = F.when(F.get(highs, F.col("home")) == F.col("key"), F.pmod(F.col("home") + 1, F.lit(len(bounds))))
    places = F.array(F.struct(F.col("home").alias("slice"), F.lit(False).alias("guard")), F.struct(above.alias("slice"), F.lit(True).alias("guard")))
    dealt = keyed.withColumn("place", F.explode(F.filter(places, lambda p: p.slice.isNotNull())))
    dealt = dealt.select(F.col("place.slice").alias("slice"), F.col("place.guard").alias("guard"), "key", "doc_id", "text")
    dealt = dealt.withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("slice").orderBy("guard", F.desc("key"), "tie")
    return dealt.withColumn("next_text", F.lead("text").over(order))


def edited_text(text: Column, other: Column) -> Column:
    """The last third of a text replaced by as many characters from the start of another."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: fingerprints of its text, of its edited text, and how alike.

    ``near_edited`` compares the text with the edited one, ``near_next`` with the next document. A null
    text counts as empty; an only document is its own next. An empty table gives an empty result.
    """
    beside = with_next(docs)
    digest = [f"sha{i}" for i in range(4)]  # as numbers, which are cheaper to group by than text
    row = ["slice", "guard", "turn", "doc_id", "n_chars", *digest]
    edited = edited_text(F.col("text"), F.coalesce("next_text", F.lit("")))
    order = Window.partitionBy("slice").orderBy("guard", F.desc("key"), "tie")
    both = beside.withColumn("turn", F.row_number().over(order)).withColumn("edited", edited)
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("sha", F.sha2("edited", 256))
    parts = {c: F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long") for i, c in enumerate(digest)}
    both = both.withColumns(parts)
    kinds = F.array(
        F.struct(F.lit(False).alias("changed"), F.col("text").alias("body")),
        F.struct(F.lit(True).alias("changed"), F.col("edited").alias("body")),
    )
    texts = both.withColumn("kind", F.explode(kinds)).select(*row, "kind.changed", "kind.body")
    prints = fingerprints(texts.filter("not (guard and changed)"), [*row, "changed"], "body")
    pick = lambda flag: F.first(F.when(F.col("changed") == flag, F.col("print")), ignorenulls=True)
    joined = prints.groupBy(*row).agg(pick(False).alias("own"), pick(True).alias("new"))
    lanes = joined.select(
        *row, vector_of("own").alias("own"), F.col("own.n_shingles").alias("own_n"),
        vector_of("new").alias("new"), F.col("new.n_shingles").alias("new_n"),
    )
    by_turn = Window.partitionBy("slice").orderBy("turn")
    lanes = lanes.withColumn("next", F.lead("own").over(by_turn)).withColumn("next_n", F.lead("own_n").over(by_turn))
    return lanes.filter("not guard").select(
        "doc_id", "n_chars", F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in digest]).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("own_n"), F.col("new"), F.col("new_n")).alias("near_edited"),
        likeness(F.col("own"), F.col("own_n"), F.col("next"), F.col("next_n")).alias("near_next"),
    )
