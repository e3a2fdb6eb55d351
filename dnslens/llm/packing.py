"""Bounded-space online packing of tokenised documents into fixed windows.

Each task reads its documents once. Full windows of a document are sequences at once; what remains
of it goes to the best fitting of a fixed number of open windows. When none fits, the fullest is closed
and a new one opened. Windows still open at the end of a task are merged in a second step, in groups
of tasks of a fixed size. Token ids stay where they were made; only places of windows move.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 1024
OPEN = 64
END_OF_DOCUMENT = 0
TOKENIZER = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json as ranks: the same ids
ADDED = "byte_bpe_50k.json"  # has the added tokens, which the ranks lack
CACHED = 300_000
ROWS = 256
TASKS_MERGED = 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, window long, offset long, left boolean"
_BESIDE_BLANK = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, by the ranks of a byte-level BPE vocabulary.

    Such a tokenizer splits a text before every space between two non-blanks anyway, and never looks
    across. So texts are cut there, and ids of frequent parts are remembered (a bounded number).
    Strings that name added tokens are cut out first and have the tokens' ids, as by that tokenizer's default.
    """

    def __init__(self, tokenizer: str = TOKENIZER, added: str = ADDED):
        import public_tokenizers
        import tiktoken

        path = lambda name: name if os.path.isabs(name) else public_tokenizers.path(name)
        with open(path(added), encoding="utf-8") as file:
            found = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.added = {content: array("I", [number]).tobytes() for content, number in found.items()}
        longest = sorted(found, key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(map(re.escape, longest))})") if found else None
        with open(path(tokenizer), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.model = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, bytes] = {}

    def _encode(self, part: str) -> bytes:
        return array("I", self.model.encode_ordinary(part)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.at_added is None or not any(map(self.at_added.search, texts)):
            return self._ordinary(texts)
        split = [self.at_added.split(t) for t in texts]  # every second part is an added token
        ids = iter(self._ordinary([p for parts in split for p in parts[::2]]))
        return [b"".join(self.added[p] if i % 2 else next(ids) for i, p in enumerate(parts)) for parts in split]

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        split = [_CUT.split(t) if _BESIDE_BLANK.search(t) else t.split(" ") for t in texts]
        table, encode = self.known, self._encode
        new = {p: encode(" " + p) for p in set().union(*split).difference(table)}
        if len(table) < CACHED:
            table.update(new)
            get = table.__getitem__
        else:
            get = _Both(new, table).__getitem__
        return [encode(parts[0]) + b"".join(map(get, islice(parts, 1, None))) for parts in split]


class _Both(dict):
    """Looks in the second table what the first has not."""

    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key):
        return self.second[key]


class OpenWindows:
    """Best fit into at most ``keep`` open windows; numbers windows from ``number`` on."""

    def __init__(self, number: int, size: int = WINDOW, keep: int = OPEN):
        self.next, self.size, self.keep = number, size, keep
        self.spaces: list[tuple[int, int]] = []  # free places and number, least free first

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece shorter than a window."""
        at = bisect_left(self.spaces, (length, -1))
        if at < len(self.spaces):
            free, window = self.spaces.pop(at)
        else:
            if len(self.spaces) == self.keep:
                self.spaces.pop(0)  # the fullest is closed
            free, window = self.size, self.new()
        if free > length:
            insort(self.spaces, (free - length, window))
        return window, self.size - free


def window_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = WINDOW, keep: int = OPEN) -> DataFrame:
    """A row for each piece with its ``ids``, window and offset; ``left`` rows name windows still open.

    A document is its ids and then one end id, so a null or empty text is one token. Documents of any
    length are tokenised whole; equal ids or rows are packed one by one.
    """
    names = [part.split()[0] for part in PIECES.split(", ")]
    schema = pa.schema(
        [(n, pa.binary() if n == "ids" else pa.bool_() if n == "left" else pa.int64()) for n in names]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        windows = OpenWindows(TaskContext.get().partitionId() << 40, size, keep)
        end = END_OF_DOCUMENT.to_bytes(4, "little")
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    window, offset = (windows.new(), 0) if length == size else windows.place(length)
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], total, window, offset, False))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows = [(None, None, size - free, None, None, window, None, True) for free, window in windows.spaces]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PIECES)


def merged_windows(left: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window, sequence_id, base``: open windows put together, largest first, each to the best fit.

    A group holds the open windows of ``TASKS_MERGED`` tasks, so it is bounded whatever the input.
    """

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        spaces: list[tuple[int, int]] = []
        rows = []
        for fill, window in sorted(zip(-group["length"], group["window"])):
            at = bisect_left(spaces, (-fill, -1))
            free, sequence = spaces.pop(at) if at < len(spaces) else (size, window)
            rows.append((window, sequence, size - free))
            if free + fill > 0:
                insort(spaces, (free + fill, sequence))
        return pd.DataFrame(rows, columns=["window", "sequence_id", "base"])

    group = F.shiftright("window", 40 + TASKS_MERGED.bit_length() - 1).alias("group")
    return left.select(group, "window", "length").groupBy("group").applyInPandas(
        merge, "window long, sequence_id long, base long"
    )


def place(pieces: DataFrame, size: int = WINDOW) -> DataFrame:
    """Stores ``pieces`` and gives each its ``sequence_id`` and its offset there.

    All columns but ``window`` and ``left`` stay. An empty table gives an empty result.
    """
    pieces = stored(pieces, "pieces")
    moved = stored(merged_windows(pieces.filter("left"), size), "merged")
    own = pieces.filter("not left").drop("left")
    placed = own.join(moved, "window", "left")
    return placed.select(
        *[c for c in own.columns if c not in ("window", "offset")],
        F.coalesce("sequence_id", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = WINDOW, keep: int = OPEN) -> DataFrame:
    """The packed pieces with their token ids (little-endian uint32 bytes)."""
    return place(window_pieces(docs, tokenizer, size, keep), size)
