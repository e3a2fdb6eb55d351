"""Repaired conversations against a plain program that works backwards from the end."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

from dnslens.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, n bigint, code string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows: list[tuple]) -> tuple:
    """Cost, audit and lines: the choice at each row is the cheapest one, then the one of the least letter."""

    @lru_cache(maxsize=None)
    def best(i: int, state: str, inserts: int) -> tuple:
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            cost, audit, lines = best(i, NEXT[state], inserts + 1)
            options.append((cost + 2, "I" + audit, (f"{NAMES[NEXT[state]]}:", *lines)))
        if i < len(rows):
            role, text, faulty, cut = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, lines))
            if not faulty:
                after = role[:1] if role[:1] == NEXT[state] or (role[:1], state) == ("s", "") else None
                if after:
                    cost, audit, lines = best(i + 1, after, 0)
                    options.append((cost + cut, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(i + 1, NEXT[state], 0)
                options.append((cost + 2 + cut, "R" + audit, (f"{NAMES[NEXT[state]]}:{text}", *lines)))
        return min(options, default=(1 << 60, "~", ()))

    for i in range(len(rows), -1, -1):
        for state in NEXT:
            best(i, state, 0)
    return best(0, "", 0)


def by_force(table: list[tuple]) -> dict:
    conversations: dict = {}
    for conv, turn, role, text in table:
        rows = conversations.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        shown = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        damage = zlib.crc32(shown.encode()) % 20
        if damage:
            text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
            rows += [(turn, "user" if damage == 4 else role, text)] * (1 + (damage == 3))
    out = {}
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen, judged = [0, 0, 0], set(), []
        for _, role, text in rows:
            said = text.strip(" \t\n\x0b\x0c\r")
            blank, again = not said, bool(said) and (role, text) in seen
            cut = bool(said) and not again and said[-1] not in ".!?"
            seen.add((role, text))
            faults = [f + x for f, x in zip(faults, (blank, again, cut))]
            judged.append((role, text, blank or again, cut))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(judged)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df) -> dict:
    rows = tr.repaired_digests(df).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def odd_rows(seed: int, conversations: list) -> list[tuple]:
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "Stranger", "s"]
    texts = ["a.", "b", "c!", None, " ", "d d?", "e\n", "f. ", "é\u2028", "x" * 3000, "ok.\u00a0"]
    rows = []
    for c in conversations:
        for k in range(draw.randint(1, 9)):
            turn = draw.choice([None, -3, 2, 900]) if draw.random() < 0.2 else k
            rows.append((c, turn, draw.choice(roles), draw.choice(texts)))
    return rows


def test_odd_conversations(spark):
    rows = odd_rows(1, [None, *range(250)])
    rows += rows[:40]  # that are there already
    draw = random.Random(2)
    one = [(999, k // 3, draw.choice(["user", "assistant", "system"]), f"x{draw.randint(0, 99)}.") for k in range(2000)]
    table = rows + one + [(1000, 1, "user", "copy.")] * 1500
    df = spark.createDataFrame([(*r, 1, "c") for r in table], SCHEMA).repartition(5)
    assert found(df) == by_force(table)


def test_real_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert found(df) == by_force([tuple(r) for r in df.collect()])


def test_repaired_turns_alternate(spark):
    rows = odd_rows(7, list(range(120)))
    repair = tr.Repair(spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA))
    turns: dict = {}
    for r in sorted(repair.repaired().collect()):
        turns.setdefault(r.conv_id, []).append(r)
    for rows in turns.values():
        assert [r.place for r in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows))
    assert len(repair.audits().collect()) == 120


def test_empty_table_and_dropped_conversations(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.", 1, "c")], SCHEMA)
    assert found(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def steps_of(kinds: list[tuple]) -> list:
    return [tr.row_moves(initial, faulty, cut, copies) for initial, faulty, cut, copies in kinds]


def test_blocks_chain_to_the_same_audit():
    draw = random.Random(11)
    for _ in range(300):
        kinds = [(draw.choice(["s", "u", "a", "t", ""]), draw.random() < 0.2, draw.random() < 0.3, draw.choice([1, 1, 1, 3])) for _ in range(draw.randint(1, 30))]
        rows = [(i, "x", faulty or k > 0, cut) for i, faulty, cut, n in kinds for k in range(n)]
        want = cheapest(rows)[:2]
        for size in (1, 2, 7, 30):
            front = {tr.START: (0, tr.Trail())}
            for at in range(0, len(kinds), size):
                front = tr.advance(front, tr.block_moves(steps_of(kinds[at : at + size]), at == 0))
            state, cost, trail = tr.finish(front)
            assert (cost, "".join(s.audit for s in trail.steps()) + tr.TAILS[state]) == want


def test_trails_with_equal_hashes_are_compared_in_full(monkeypatch):
    monkeypatch.setattr(tr, "_BASE", 0)  # hashes hold the last letter of an audit alone
    tr.row_moves.cache_clear()
    test_blocks_chain_to_the_same_audit()
    tr.row_moves.cache_clear()
