"""Secrets against plain searches over whole texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from dnslens.llm import secret_scan as ss

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
SHORT = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def token(prefix: str, body: str) -> str:
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = SHORT[digit] + digits
    return f"{prefix}{body}{digits:0>6}"


GITHUB = token("ghp_", "aB3" * 10)
NPM = token("npm_", "Zx9" * 10)


def by_force(text: str) -> list[tuple]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for rank, pattern in ((3, "gh[pousr]_[A-Za-z0-9]+"), (4, "npm_[A-Za-z0-9]+")):
        for m in re.finditer(pattern, text):
            if len(m[0]) == 40 and token(m[0][:4], m[0][4:34]) == m[0]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def spans(text: str) -> list[tuple]:
    return [(s["start"], list(ss.PATTERNS).index(s["kind"]), s["stop"]) for s in ss.spans_of(text.encode())]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("token=abc token=secret=abcdef", [0]),
        ("PassWord\": 'abc+/=-._'", [0]),
        ("api_key: 123456 apikey=12345 APIKEY   =   1234567", [0, 0]),
        ("to\u212aen=abcdef \u017fecret=abcdef", []),
        ("\u0130 token=abcdef \U0001f600 é secret:abcdef", [0, 0]),
        ("xAKIA" + "A1" * 8 + " AKIA" + "B" * 15 + " akia" + "C" * 30, [1]),
        ("g" + "0a" * 12 + "g" + "0a" * 11 + "b" + "A" * 30, [2]),
        ("token = " + "ab" * 12, [0, 2]),
        (GITHUB, [3]),
        (GITHUB + "x", []),
        (GITHUB[:-1] + ("a" if GITHUB[-1] != "a" else "b"), []),
        (NPM + " " + GITHUB.replace("ghp_", "ghs_") + "\ntoken: " + GITHUB, [4, 3, 0, 3]),
    ],
)
def test_cases(text, kinds):
    assert spans(text) == by_force(text)
    assert [k for _, k, _ in spans(text)] == kinds


def test_random_texts():
    draw = random.Random(3)
    parts = ["token", "Secret", "passwd", "password", "api", "_", "key", "AKIA", "akia", "ghp_", "npm_", GITHUB, NPM]
    parts += ["=", ":", " ", '"', "'", "abc123", "0" * 23, "f", "é", "\n", "Z9", "-", "\u212a", "x"]
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 14)))
        assert spans(text) == by_force(text), text


def test_long_runs():
    for text in ("a" * 300_000, "token" * 60_000, "token" + " " * 200_000 + "=abcdef", "AKIA" * 50_000):
        assert spans(text) == by_force(text)


def test_rows_with_oddities(spark, odd):
    rows = ss.digests(odd.withColumnRenamed("id", "found").withColumnRenamed("n", "spans")).collect()
    texts = odd.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    want = []
    for r in texts:
        marks = [f"{list(ss.PATTERNS)[k]}:{a}:{b}" for a, k, b in by_force(r.text or "")]
        want.append((r.doc_id, hashlib.sha256(",".join(marks).encode()).hexdigest(), ",".join(marks)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.base_sha256, r.spans)) for r in rows)


def test_spans_of_all_kinds_follow_those_of_the_contract(spark):
    df = spark.createDataFrame([(1, f"token={GITHUB} {NPM}"), (2, None)], "doc_id long, text string")
    one, two = sorted(ss.digests(df).collect())
    assert one.spans == "assign:0:46,github:6:46,npm:47:87" and (one.n_assign, one.n_access, one.n_hex) == (1, 0, 0)
    assert one.base_sha256 == hashlib.sha256(b"assign:0:46").hexdigest()
    assert two.spans == "" and two.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark, nothing):
    assert ss.digests(nothing).collect() == []
