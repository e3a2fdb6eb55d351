"""Conversation repair: the cheapest audit of edits that makes a conversation's roles alternate.

A dynamic program walks a conversation's rows through the states of ``(s?(ua)+)?`` and keeps, for each
state, the cheapest edits that lead there. Edits so far are linked nodes that share their prefixes. A
node knows its ancestors 1, 2, 4, ... steps up and the rolling hash of its edits, so a tie between two
of them is settled at the end of their longest common prefix, found by binary lifting over hashes and
verified on the nodes themselves.

Rows of all conversations are sorted by ranges and cut into blocks. The program runs inside every
block from each state that it may begin in; then it runs over the blocks of each conversation as it does over
rows. So a conversation that holds a large part of all rows is worked on by many tasks, and what one
task then chains is a few strings a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored

# The blanks of the contract's word class, the costs of the edits.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
REROLE, DELETE, INSERT = 2, 3, 2

BLOCK = 512
_BATCH = 4096
_PRIME, _BASE = (1 << 61) - 1, 1_000_003

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
TAILS = ("", "II", "I", "")
ROLES = {USER: "user", ASSISTANT: "assistant"}

# A row's edits are one character: K, D, or the initial of its new role; in lower case after an insertion.
AUDIT = str.maketrans({"k": "IK", "U": "R", "A": "R", "u": "IR", "a": "IR"})


class Edits(NamedTuple):
    """Edits of a row or of a block: as codes and as the audit shows them, with the audit's hash."""

    codes: str
    audit: str
    power: int
    hash: int


def edits(codes: str) -> Edits:
    audit, power, value = codes.translate(AUDIT), 1, 0
    for c in audit:
        power, value = power * _BASE % _PRIME, (value * _BASE + ord(c)) % _PRIME
    return Edits(codes, audit, power, value)


class Trail:
    """Edits up to a row or block, the last of them in this node; ``ups[k]`` is 2**k steps up."""

    __slots__ = ("edits", "hash", "size", "ups")

    def __init__(self, parent: Trail | None = None, last: Edits | None = None):
        self.edits, self.ups, self.hash, self.size = last, [], 0, 0
        if parent is not None:
            self.hash = (parent.hash * last.power + last.hash) % _PRIME
            self.size = parent.size + len(last.audit)
            self.ups.append(parent)
            for k, up in enumerate(self.ups):
                if k < len(up.ups):
                    self.ups.append(up.ups[k])

    def steps(self) -> list[Edits]:
        node, back = self, []
        while node.ups:
            back.append(node.edits)
            node = node.ups[0]
        return back[::-1]

    def before(self, other: Trail) -> bool:
        """Whether these edits come first in the order of their audits; both have as many steps.

        Different trails of as many steps differ inside the step after their last common node: each step
        ends with what happens to its row, so none is the start of another one.
        """
        a, b = self, other
        for k in range(len(a.ups) - 1, -1, -1):
            if k < len(a.ups):
                x, y = a.ups[k], b.ups[k]
                if (x.hash, x.size) != (y.hash, y.size):
                    a, b = x, y
        if a.ups[0] is not b.ups[0]:  # equal hashes of different edits
            return "".join(s.audit for s in self.steps()) < "".join(s.audit for s in other.steps())
        return a.edits.audit < b.edits.audit


Moves = dict[tuple[int, int], tuple[int, Edits]]
Front = dict[int, tuple[int, Trail]]


@lru_cache(maxsize=4096)
def row_moves(initial: str, faulty: bool, cut: bool, copies: int) -> Moves:
    """Between any two states the cheapest edits of a row, and of the copies after it, which go."""
    found: dict[tuple[int, int], tuple[int, str, str]] = {}

    def offer(p: int, q: int, cost: int, code: str) -> None:
        codes = code + "D" * (copies - 1)
        option = (cost + DELETE * (copies - 1), codes.translate(AUDIT), codes)
        found[p, q] = min(found.get((p, q), option), option)

    for p in range(4):
        offer(p, p, DELETE, "D")
        if faulty:
            continue
        for inserted in (False, True):
            here = NEXT[p] if inserted else p
            cost = INSERT * inserted + cut
            if (initial, here) == ("s", START):
                offer(p, SYSTEM, cost, "K")
            elif initial and initial == ROLES[NEXT[here]][0]:
                offer(p, NEXT[here], cost, "k" if inserted else "K")
            new = ROLES[NEXT[here]][0]
            offer(p, NEXT[here], cost + REROLE, new if inserted else new.upper())
    return {pq: (cost, edits(codes)) for pq, (cost, _, codes) in found.items()}


def advance(front: Front, moves: Moves) -> Front:
    """The cheapest edits to each state after one more row or block, ties by audit."""
    after: Front = {}
    for (p, q), (cost, step) in moves.items():
        if p not in front:
            continue
        total = front[p][0] + cost
        if q in after and total > after[q][0]:
            continue
        trail = Trail(front[p][1], step)
        if q not in after or total < after[q][0] or trail.before(after[q][1]):
            after[q] = (total, trail)
    return after


def finish(front: Front) -> tuple[int, int, Trail]:
    """State, cost and trail of the cheapest whole repair; what the tail inserts is part of the cost."""
    best = None
    for q, (cost, trail) in front.items():
        total = cost + INSERT * len(TAILS[q])
        if best is None or total < best[1] or (total == best[1] and trail.before(best[2])):
            best = (q, total, trail)
    return best


def block_moves(rows: Iterable[Moves], first: bool) -> Moves:
    """The moves of a block of rows, from the start alone if it is the first one of its conversation."""
    rows, found = list(rows), {}
    for p in (START,) if first else range(4):
        front: Front = {p: (0, Trail())}
        for moves in rows:
            front = advance(front, moves)
        for q, (cost, trail) in front.items():
            found[p, q] = (cost, edits("".join(s.codes for s in trail.steps())))
    return found


def legal(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_LONGS = ", ".join(f"{c} bigint" for c in _COUNTS)
_LONG_FIELDS = [(c, pa.int64()) for c in _COUNTS]


def _block(conv_id, part: int, number: int, first: bool, rows: list[dict]) -> dict:
    """What the chain of blocks needs to know of one: counts, its ends, its moves, and where its rows' edits are."""
    counts, steps, units, at = dict.fromkeys(_COUNTS, 0), [], [], 0
    for before, r in zip([None, *rows], rows):
        n, faulty = r["n"], r["blank"] or r["again"]
        cut = r["cut"] and not faulty
        counts["blank"] += n * r["blank"]
        counts["duplicate"] += 0 if r["blank"] else n - (not faulty)
        counts["truncated"] += cut
        counts["illegal"] += n - 1 + (before is not None and not legal(before["initial"], r["initial"]))
        steps.append(row_moves(r["initial"], faulty, cut, n))
        units.append({"turn": r["turn"], "digest": r["digest"], "at": at})
        at += n
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return counts | {
        "conv_id": conv_id, "part": part, "block": number, "units": units,
        "first_role": rows[0]["initial"], "last_role": rows[-1]["initial"],
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "n_turns": len(set(turns)),
        "moves": [{"p": p, "q": q, "cost": c, "codes": e.codes} for (p, q), (c, e) in block_moves(steps, first).items()],
    }


_BLOCK_COLUMNS = (
    f"part int, block bigint, {_LONGS}, first_role string, last_role string, first_turn bigint, last_turn bigint, "
    "n_turns bigint, moves array<struct<p:int,q:int,cost:bigint,codes:string>>, "
    "units array<struct<turn:bigint,digest:binary,at:bigint>>"
)
_BLOCK_FIELDS = [
    ("part", pa.int32()), ("block", pa.int64()), *_LONG_FIELDS, ("first_role", pa.string()), ("last_role", pa.string()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()),
    ("moves", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("codes", pa.string())]))),
    ("units", pa.list_(pa.struct([("turn", pa.int64()), ("digest", pa.binary()), ("at", pa.int64())]))),
]


def _streamed(step, fields: list, size: int):
    """A function of Arrow batches from one of rows (dicts) to rows; the key keeps the type it comes with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows() -> Iterator[dict]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *fields])
                yield from batch.to_pylist()

        held = []
        for row in step(rows()):
            held.append(row)
            if len(held) == size:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _cut(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a sorted part of all rows. What a part begins with may go on from the part before."""
    part, number, held, first = TaskContext.get().partitionId(), 0, [], False
    for row in rows:
        ended = bool(held) and held[0]["conv_id"] != row["conv_id"]
        if ended or len(held) == BLOCK:
            yield _block(held[0]["conv_id"], part, number, first, held)
            number, held, first = number + 1, [], ended
        held.append(row)
    if held:
        yield _block(held[0]["conv_id"], part, number, first, held)


_CHOICE_COLUMNS = f"part int, block bigint, codes string, audit string, tail string, cost bigint, gaps bigint, {_LONGS}"
_CHOICE_FIELDS = [
    ("part", pa.int32()), ("block", pa.int64()), ("codes", pa.string()), ("audit", pa.string()), ("tail", pa.string()),
    ("cost", pa.int64()), ("gaps", pa.int64()), *_LONG_FIELDS,
]


class _Chain:
    """The blocks of one conversation so far."""

    def __init__(self, conv_id):
        self.conv_id, self.front, self.places = conv_id, {START: (0, Trail())}, []
        self.counts, self.last_role = dict.fromkeys(_COUNTS, 0), None
        self.low, self.high, self.n_turns = None, None, 0

    def add(self, block: dict) -> None:
        moves = {(m["p"], m["q"]): (m["cost"], edits(m["codes"])) for m in block["moves"]}
        self.front = advance(self.front, moves)
        self.places.append((block["part"], block["block"]))
        for c in _COUNTS:
            self.counts[c] += block[c]
        if self.last_role is not None:
            self.counts["illegal"] += not legal(self.last_role, block["first_role"])
        self.last_role = block["last_role"]
        if block["n_turns"]:
            self.n_turns += block["n_turns"] - (self.high == block["first_turn"])
            self.low = block["first_turn"] if self.low is None else self.low
            self.high = block["last_turn"]

    def rows(self) -> Iterator[dict]:
        """The edits of each block, and what holds for the whole conversation."""
        state, cost, trail = finish(self.front)
        steps = trail.steps()
        for (part, block), step in zip(self.places, steps):
            yield {"conv_id": self.conv_id, "part": part, "block": block, "codes": step.codes}
        yield self.counts | {
            "conv_id": self.conv_id,
            "audit": "".join(s.audit for s in steps) + TAILS[state],
            "tail": TAILS[state],
            "cost": cost,
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.n_turns,
        }


def _choose(blocks: Iterator[dict]) -> Iterator[dict]:
    chain = None
    for block in blocks:
        if chain is None or chain.conv_id != block["conv_id"]:
            if chain is not None:
                yield from chain.rows()
            chain = _Chain(block["conv_id"])
        chain.add(block)
    if chain is not None:
        yield from chain.rows()


def _apply(rows: Iterator[dict]) -> Iterator[dict]:
    """Repaired turns of a sorted stream in which the edit of a row comes before its text."""
    conv_id, place, code, started = None, 0, "D", False
    for row in rows:
        if not started or conv_id != row["conv_id"]:
            conv_id, place, code, started = row["conv_id"], 0, "D", True
        if row["code"] is not None and row["text"] is None:
            turns = []
            if row["last"]:
                turns = [(r, "") for r in ("user", "assistant")[2 - len(row["code"]) :]]
            else:
                code = row["code"]
        else:
            turns = turned(code, row["role"], row["text"])
            code = "D"  # the row's copies, if any, go
        for role, text in turns:
            yield {"conv_id": conv_id, "place": place, "role": role, "text": text}
            place += 1


def turned(code: str, role: str, text: str) -> list[tuple[str, str]]:
    """The turns that a row becomes."""
    if code == "D":
        return []
    if code in "UuAa":
        role = ROLES[USER if code in "Uu" else ASSISTANT]
    other = ROLES[ASSISTANT if role[:1] == "u" else USER]
    return [(other, "")] * code.islower() + [(role, text)]


class Repair:
    """Repair of the conversations in rows of ``conv_id, turn, role, text``.

    Null roles and texts count as one space, null keys as a conversation of their own, and null turns come
    first. Rows of one turn go by the SHA-256 of role and text. Repeated rows are counted before they move:
    all but the first of each role and text are deleted, wherever they stand. Texts of any length move
    once, when repairs are written. An empty table gives empty results; other columns are not looked at.
    """

    def __init__(self, rows: DataFrame):
        whole = rows.select(
            "conv_id",
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"),
        )
        name = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
        self.rows = whole.withColumn("digest", F.unhex(F.sha2(name, 256)))
        self.blocks = self._blocks(rows.sparkSession)
        self.choices = self._choices()

    def _blocks(self, spark) -> DataFrame:
        said = F.rtrim("text", F.lit(BLANKS))
        units = self.rows.select(
            "conv_id",
            "turn",
            "digest",
            F.substring("role", 1, 1).alias("initial"),
            (said == "").alias("blank"),
            (~F.substring(said, -1, 1).isin(*ENDS)).alias("cut"),
        )
        units = stored(units.groupBy(*units.columns).agg(F.count(F.lit(1)).alias("n")), "turns")
        rank = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        first = units.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(rank).alias("first"))
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
        flagged = units.join(first, same).withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn")))
        flagged = stored(flagged.drop("c", "d", "first"), "flagged")
        order = ["conv_id", "turn", "digest"]
        parts = flagged.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
        kind = dict(self.rows.dtypes)["conv_id"]
        blocks = parts.mapInArrow(_streamed(_cut, _BLOCK_FIELDS, 64), f"conv_id {kind}, {_BLOCK_COLUMNS}")
        return stored(blocks, "blocks")

    def _choices(self) -> DataFrame:
        kind = dict(self.rows.dtypes)["conv_id"]
        chained = self.blocks.drop("units").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
        chosen = chained.mapInArrow(_streamed(_choose, _CHOICE_FIELDS, 64), f"conv_id {kind}, {_CHOICE_COLUMNS}")
        return stored(chosen, "choices")

    def audits(self) -> DataFrame:
        """For each conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
        return self.choices.filter("audit is not null").select("conv_id", "gaps", *_COUNTS, "cost", "audit")

    def repaired(self) -> DataFrame:
        """The repaired turns, ``conv_id, place, role, text``.

        Rows of a conversation lie in one partition in order of ``place``, which starts from 0. They are
        streamed, so a task holds one row of them at a time.
        """
        none = F.lit(None).cast("string")
        nobody = [none.alias("role"), none.alias("text")]
        chosen = self.choices.filter("audit is null").select("part", "block", "codes")
        cut = self.blocks.select("conv_id", "part", "block", "units").join(chosen, ["part", "block"])
        edits_of = cut.select("conv_id", "codes", F.inline("units")).select(
            "conv_id",
            F.lit(False).alias("last"),
            "turn",
            "digest",
            F.expr("substring(codes, int(at + 1), 1)").alias("code"),
            *nobody,
        )
        tails = self.choices.filter("tail <> ''").select(
            "conv_id",
            F.lit(True).alias("last"),
            F.lit(None).cast("bigint").alias("turn"),
            F.lit(None).cast("binary").alias("digest"),
            F.col("tail").alias("code"),
            *nobody,
        )
        texts = self.rows.select("conv_id", F.lit(False).alias("last"), "turn", "digest", none.alias("code"), "role", "text")
        stream = edits_of.unionByName(tails).unionByName(texts).repartition("conv_id")
        stream = stream.sortWithinPartitions("conv_id", "last", "turn", "digest", F.col("code").asc_nulls_last())
        kind = dict(self.rows.dtypes)["conv_id"]
        fields = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        return stream.mapInArrow(
            _streamed(_apply, fields, _BATCH), f"conv_id {kind}, place bigint, role string, text string"
        )


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    conv_id, sha = None, None
    for row in rows:
        if sha is None or row["conv_id"] != conv_id:
            if sha is not None:
                yield {"conv_id": conv_id, "repaired_sha256": sha.hexdigest()}
            conv_id, sha = row["conv_id"], hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{row['role']}:{row['text']}".encode())
    if sha is not None:
        yield {"conv_id": conv_id, "repaired_sha256": sha.hexdigest()}


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text`` of the turns, straight from ``Repair.repaired``."""
    kind = dict(repaired.dtypes)["conv_id"]
    run = _streamed(_hashed, [("repaired_sha256", pa.string())], _BATCH)
    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the contract's damage, drawn by the CRC-32 of ``conv_id:turn``; nulls are one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *shown)) % 20).alias("damage"),
    )
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", "".join(ENDS), ""))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("damage <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """The contract's row of each conversation of ``conversations`` after damage and repair."""
    repair = Repair(damaged(conversations))
    audits = repair.audits().withColumnRenamed("conv_id", "a")
    hashes = digests(repair.repaired()).withColumnRenamed("conv_id", "h")
    found = (
        conversations.select("conv_id")
        .distinct()
        .join(audits, F.col("conv_id").eqNullSafe(F.col("a")), "left")
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    )
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return found.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
