"""Documents with every oddity the operators must take, beside ordinary ones."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, size string, body string"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    parts = ["ta", "lo", "mir", "sen", "ku", "vel", "or", "an", "ith", "dé"]
    out = []
    for i in range(words):
        out.append("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))))
        out.append("\n" if i % 23 == 22 else ". " if i % 9 == 8 else " ")
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    passage = prose(1, 60)
    base = [prose(100 + i, 40 + 10 * i) for i in range(8)]
    near = base[7].split(" ")
    near[20] = "changed"
    texts = [
        None, "", " \t\n", "one", "two words here", "...!!! 123 456", *base,
        base[3], base[3], " ".join(near), base[2] + "\n" + passage, passage + "\n" + base[5][:150],
        "same line again\n" * 40, "x" * 5000, "ab " * 700, prose(7, 6000), "  lead " + base[1] + "  tail  ",
        base[0].upper(), "é\U0001f600 " * 90,
    ]
    rows = [
        (i, t, ("en", "fr", None)[i % 3], ("web", "b", None, "a")[i % 4], None if t is None else len(t), 1, 2, "s", "b")
        for i, t in enumerate(texts)
    ]
    rows.append((9, base[3], "en", "a", len(base[3]), 1, 2, "s", "b"))  # a row that is there already
    rows.append(rows[-1])
    rows.append((None, base[4], None, "web", None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(spark):
    """The odd rows whose ids are there once."""
    rows = odd_rows()
    ids = [r[0] for r in rows]
    return spark.createDataFrame([r for r in rows if r[0] is not None and ids.count(r[0]) == 1], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
