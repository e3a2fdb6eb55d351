"""Product codes against a plain version of the contract, and the trees they are found with."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from dnslens.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v int, code string"


def finite(vector) -> bool:
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def by_force(rows: list) -> list:
    kept = [(i, [math.floor(256 * x) for x in e], label) for i, e, label in rows if finite(e)]
    width = 16 * max(1, -(-max(len(e) for _, e, _ in kept) // 16))
    x = np.array([e + [0] * (width - len(e)) for _, e, _ in kept], dtype=np.int64).reshape(len(kept), 16, -1)
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, x[n].ravel().tolist()))
    seeds = {}
    for n in order:
        seeds.setdefault(kept[n][0], n)
    codes, errors, entries = [""] * len(kept), np.zeros(len(kept), dtype=np.int64), []
    for p in range(16):
        book = x[list(seeds.values())[:64], p]
        for last in (False, False, True):
            away = ((x[:, p][:, None] - book[None]) ** 2).sum(axis=2)
            entry = away.argmin(axis=1)
            if not last:
                book = np.stack([x[entry == e, p].sum(axis=0) // max(1, (entry == e).sum()) if (entry == e).any() else b for e, b in enumerate(book)])
        codes = [c + f"{e:02x}" for c, e in zip(codes, entry)]
        errors += away.min(axis=1)
        entries += book.ravel().tolist()
    sha, labels = hashlib.sha256(",".join(map(str, entries)).encode()).hexdigest(), defaultdict(int)
    for (_, _, label), error in zip(kept, errors):
        labels[label] += int(error)
    return sorted(repr((k[0], c, int(e), labels[k[2]], sha)) for k, c, e in zip(kept, codes, errors))


def found(df) -> list:
    return sorted(repr(tuple(r)) for r in vc.compressed(df).collect())


def odd_vectors() -> list:
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(0, 0.1, 32).astype(np.float32)], (None, 1, 2)[i % 3]) for i in range(300)]
    rows += [(None, rows[5][1], 1), (None, rows[3][1], None), (2, rows[9][1], 2), (-4, [], 2), (700, [0.5, -1e30], None)]
    rows += [(40, rows[40][1], 1)] * 150 + [(800 + k, rows[7][1], 2) for k in range(90)]
    bad = (None, [1.0] * 31 + [None], [math.nan] * 32, [math.inf] + [0.0] * 31)
    return rows, [(900 + k, e, k % 2) for k, e in enumerate(bad)]


def test_codes_are_those_of_the_contract(spark):
    rows, bad = odd_vectors()
    limited = [(i, [max(-65536.0, x) for x in e], label) for i, e, label in rows]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], SCHEMA).repartition(3)
    assert found(df) == by_force(limited + bad)


def test_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == by_force([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, 1, 1, "c")], SCHEMA)) == []


def test_ids_repeated_more_often_than_there_are_entries(spark):
    rows = [(k // 200, [float(k % 7)] * 16, 1) for k in range(800)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    assert found(df) == by_force(rows)


@pytest.mark.parametrize("n, d, spread", [(3000, 4, 100), (2500, 2, 5), (1, 3, 9), (900, 8, 1000), (500, 1, 3)])
def test_trees_own_what_is_nearest(n, d, spread):
    draw = np.random.default_rng(n)
    values = draw.normal(0, spread, (n, d)).astype(np.int64)
    values[n // 2 :] = values[0] if d == 8 else values[n // 2 :]  # a very common vector
    tree, rows = vc.tree_of(values)
    assert (tree.points[rows] == values).all()
    assert tree.count[0] == n and (tree.total[0] == values.sum(axis=0)).all()
    for b in range(len(tree.start)):
        inside = slice(tree.start[b], tree.stop[b])
        away = np.sqrt(((tree.points[inside] - tree.pivot[b]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[b] + 1e-9
        assert tree.count[b] == tree.weights[inside].sum()
    entries = np.vstack([values[draw.integers(0, n, 40)], values[:1], values[:1] + spread * 50])
    want = ((values[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (vc.owners(tree, entries)[rows] == want).all()
    totals, counts = np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64)
    vc.add_up(tree, entries, totals, counts)
    assert (counts == np.bincount(want, minlength=len(entries))).all()
    assert all((totals[e] == values[want == e].sum(axis=0)).all() for e in range(len(entries)))


def test_balls_far_from_other_entries_are_owned_whole():
    draw = np.random.default_rng(8)
    centres = draw.integers(-5000, 5000, (20, 4))
    values = (centres[draw.integers(0, 20, 4000)] + draw.integers(-9, 10, (4000, 4))).astype(np.int64)
    tree, _ = vc.tree_of(values)
    whole = sum((tree.stop[b] - tree.start[b]).sum() for b, _, _, _ in vc.settle(tree, centres))
    assert whole > 0.9 * len(tree.points)
