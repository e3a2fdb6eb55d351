"""Secrets in texts: keyword automata first, patterns only at their hits, checksums last.

Two Aho-Corasick automata read a text once each. One holds the keywords that every match starts with and
reads the text in lower case. The other reads the text folded into two classes, hexadecimal digit or not,
and its keyword is the shortest run of digits that counts. A pattern is tried only where a keyword
begins, anchored there. Tokens that carry a checksum are kept only if it holds.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of the contract and their patterns; then the tokens with a checksum, whose
# last six characters are the CRC-32 of the thirty before them, in base 62.
PATTERNS = {
    "assign": rb"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]+",
    "github": rb"gh[pousr]_[A-Za-z0-9]+",
    "npm": rb"npm_[A-Za-z0-9]+",
}
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
BASE = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS, MIN_HEX, TOKEN = 6, 20, 24, 40
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_KINDS = list(PATTERNS)
_COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_FOLD = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))


@cache
def automaton(folded: bool) -> ahocorasick.Automaton:
    """Of all keywords, or of the shortest run of hexadecimal digits in a folded text."""
    words = {"hex": ("h" * MIN_HEX,)} if folded else KEYWORDS
    found = ahocorasick.Automaton()
    for kind, names in words.items():
        for word in names:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(token: bytes) -> bool:
    """Whether the last six characters of a token are the checksum of the thirty before them."""
    value, digits = zlib.crc32(token[-36:-6]), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = DIGITS[digit] + digits
    return digits.encode() == token[-6:]


def is_secret(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= MIN_VALUE
    if kind in ("github", "npm"):
        return len(match[0]) == TOKEN and checksum(match[0])
    return len(match[0]) >= (MIN_ACCESS if kind == "access" else MIN_HEX)


def byte_spans(data: bytes) -> list[tuple[int, int, int]]:
    """``start, kind, stop`` in bytes, in order of start and kind.

    A kind's matches are the leftmost ones that don't overlap, as a search over the whole text
    gives them: no keyword lies inside another one of its kind, so hits come in order of their starts.
    """
    found = []
    for folded in (False, True):
        text = data.translate(_FOLD) if folded else data.lower()
        ends = dict.fromkeys(_KINDS, 0)
        for last, (kind, length) in automaton(folded).iter(text.decode("latin-1")):
            start = last + 1 - length
            if start >= ends[kind] and (match := _COMPILED[kind].match(data, start)):
                ends[kind] = match.end()
                if is_secret(kind, match):
                    found.append((start, _KINDS.index(kind), match.end()))
    return sorted(found)


def spans_of(data: bytes) -> list[dict]:
    """Secrets of a text in UTF-8, in code points; ends are exclusive."""
    found = byte_spans(data)
    place, done = {}, (0, 0)
    for mark in sorted({m for start, _, stop in found for m in (start, stop)}):
        done = (mark, done[1] + len(data[done[0] : mark].decode("utf-8", "replace")))
        place[mark] = done[1]
    return [{"kind": _KINDS[k], "start": place[a], "stop": place[b]} for a, k, b in found]


def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([spans_of(x.as_buffer().to_pybytes()) if x.is_valid else [] for x in texts], _ARROW)


def secrets(text: str | Column) -> Column:
    """The secrets of a text as an array of ``kind, start, stop``, by start and then kind.

    Null and empty texts have none. Long texts are read whole, one row at a time; nothing is shuffled, so
    repeated rows, ties and other columns, whatever their names, stay as they are.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(_scan, SPANS)(text.cast("binary"))


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of each kind of the contract, the hash of their spans, and all spans as text."""
    found = docs.select("doc_id", secrets("text").alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    base = joined(F.filter("found", lambda s: s.kind.isin(*BASE)))
    return found.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
