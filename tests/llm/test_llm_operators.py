"""Each operator against a brute-force version, and on rows with every oddity."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnslens.llm import (
    fingerprints,
    fuzzy_lines,
    host_rules,
    language,
    links,
    lm_scoring,
    mixing,
    packing,
    shingle_join,
    suffix_dedup,
    warc,
)

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


def texts_of(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def united(ids, pairs) -> dict:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- 1 ---------------------------------------------------------------------------------


def removed_by_force(texts: dict) -> dict:
    seen, out = set(), {}
    for i in sorted(texts):
        body = (texts[i] or "").encode()
        gone = np.zeros(len(body), dtype=bool)
        for k in range(len(body) - 99):
            if body[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(body[k : k + 100])
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out[i] = (len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("which", ["docs", "plain"])
def test_suffix_dedup_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == removed_by_force(texts_of(df))


def test_suffix_dedup_takes_repeated_and_null_rows(odd, nothing):
    rows = suffix_dedup.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    twins = [r for r in rows if r.doc_id == 9]
    assert len(twins) == 3 and len({r.kept_sha256 for r in twins}) == 1 and twins[0].n_removed == 0
    assert {r.n_removed for r in rows if r.doc_id in (14, 15)} == {twins[0].n_bytes}
    last = [r for r in rows if r.doc_id is None and r.n_bytes][0]
    assert last.n_removed == last.n_bytes  # a null id is last, so its text was there before
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_suffix_order_sorts_and_survives_collisions():
    draw = np.random.default_rng(0)
    data = draw.integers(97, 99, 4000).astype(np.uint8)
    at = draw.integers(0, 3900, 300)
    size, group = draw.integers(0, 100, 300), draw.integers(0, 7, 300)
    order, common = suffix_dedup.suffix_order(data, at, size, group)
    plain_order, plain_common = suffix_dedup._plain_order(data, at, size, group)
    body = lambda i: (group[i], data[at[i] : at[i] + size[i]].tobytes())
    assert [body(i) for i in order] == [body(i) for i in plain_order]
    assert common.tolist() == plain_common.tolist()
    thue = "a"
    for _ in range(12):  # strings whose polynomial hashes modulo 2^64 are equal
        thue += thue.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((thue + thue.translate(str.maketrans("ab", "ba"))).encode(), dtype=np.uint8)
    order, common = suffix_dedup.suffix_order(data, np.array([0, 4096]), np.array([90, 90]), np.zeros(2, int))
    assert order.tolist() == [0, 1] and common.tolist() == [-1, 0]


def embedded(n: int) -> list[tuple]:
    """A passage, and in every third text another one, inside texts that otherwise differ."""
    draw = np.random.default_rng(5)
    letters = lambda size: bytes(draw.integers(97, 123, size).astype(np.uint8)).decode()
    passage, other = letters(260), letters(130)
    return [(i, letters(20 + i % 90) + passage[i % 4 :] + letters(i % 70) + other * (i % 3 == 0) + letters(80)) for i in range(n)]


def test_a_passage_in_many_texts_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 8)
    most = []

    def watched(near, often, uncrowded=suffix_dedup.uncrowded):
        out = uncrowded(near, often)
        n = out.filter("around is not null").distinct().groupBy("gram").count().agg(F.max("count")).first()[0]
        most.append(n)
        return out

    monkeypatch.setattr(suffix_dedup, "uncrowded", watched)
    df = spark.createDataFrame(embedded(60), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == removed_by_force(texts_of(df))
    assert most[0] <= 8


def test_long_texts_are_searched_across_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    draw = np.random.default_rng(1)
    text = bytes(draw.integers(97, 123, 5000).astype(np.uint8))
    found = Counter()
    for data, ends, numbers, offsets in suffix_dedup.segments([text, b"short", text[100:900]]):
        _, at, first, last = suffix_dedup.anchor_runs(data, ends)
        part = np.searchsorted(ends, at, side="right")
        shift = offsets[part] - (ends - np.diff(ends, prepend=0))[part]
        for n, a, b in zip(numbers[part], first + shift, last + shift):
            found.update((int(n), s) for s in range(a, b + 1))
    assert found == Counter({(0, s): 1 for s in range(4901)} | {(2, s): 1 for s in range(701)})


# --- 2 ---------------------------------------------------------------------------------


def lanes_by_force(text: str) -> list[int]:
    import xxhash

    lanes, n = [0] * 80, 0
    for line in text.split("\n"):
        digest = hashlib.sha512(line.encode()).hexdigest()
        for i in range(16):
            lanes[i] += int(digest[8 * i : 8 * i + 8], 16)
        words = [xxhash.xxh64_intdigest(w, seed=42) for w in line.encode().split()]
        for i in range(max(1, len(words) - 4) if words else 0):
            h = 42
            for w in words[i : i + 5]:
                h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed=h)
            n += 1
            for bit in range(32):
                lanes[16 + 2 * bit] += h >> bit & 1
                lanes[17 + 2 * bit] += h >> (bit + 32) & 1
    return [x % (1 << 32) for x in lanes]


def test_fingerprints_equal_brute_force(plain):
    texts = texts_of(plain)
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in fingerprints.edited_pairs(plain).collect()}
    assert set(rows) == set(texts)
    for at, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = rows[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == "".join(f"{x:08x}" for x in lanes_by_force(text))
        assert row.edited_fingerprint == "".join(f"{x:08x}" for x in lanes_by_force(edited))
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1


def test_fingerprints_add_up_and_ignore_order(spark):
    df = spark.createDataFrame([(1, "a b\nc d"), (2, "c d\na b"), (3, "a b"), (4, "c d")], "k int, text string")
    found = fingerprints.fingerprints(df, ["k"]).withColumn("v", fingerprints.vector_of("print")).select("k", "v")
    v = {r.k: r.v for r in found.collect()}
    assert v[1] == v[2] != v[3]
    both = spark.createDataFrame([(v[3], v[4], v[1])], "a array<bigint>, b array<bigint>, c array<bigint>")
    row = both.select(fingerprints.added("a", "b").alias("sum"), fingerprints.removed("c", "b").alias("rest")).first()
    assert row["sum"] == v[1] and row["rest"] == v[3]


def test_fingerprints_take_repeated_and_null_rows(odd, nothing):
    rows = fingerprints.edited_pairs(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (9, 14, 15)}) == 1
    assert fingerprints.edited_pairs(nothing).count() == 0


def test_edits_are_nearer_than_neighbours(docs):
    found = fingerprints.edited_pairs(docs).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("x"))
    assert found.first().x > 0.95


# --- 3 ---------------------------------------------------------------------------------


def test_repeated_words_equal_brute_force():
    for words in ("a a a a", "a b c d", "x y z x y z q", "a b a b a", "", "p q r s p q r t p q r", "a a a"):
        split = words.encode().split()
        windows = [tuple(split[i : i + 3]) for i in range(len(split) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert host_rules.repeated_words(split) == len(covered)


def test_a_host_that_mostly_fails_is_rejected(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "fine") for i in range(40)]
    rows += [(100 + i, "short" if i % 10 else good, "bad") for i in range(40)]
    rows += [(200 + i, good, None) for i in range(5)] + [(300, "short", "tiny")]
    found = host_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    verdict = {r.doc_id: r for r in found}
    assert not any(r.kept for r in found if r.host == "bad") and verdict[300].host_rate < 1
    assert all(r.kept != r.base_failed for r in found if r.host in ("fine", None))


def test_quality_takes_odd_rows(odd, nothing):
    rows = host_rules.quality(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert host_rules.quality(nothing).count() == 0


# --- 4 ---------------------------------------------------------------------------------


def kept_by_force(texts: dict) -> dict:
    places = [(i, n, line) for i, t in texts.items() for n, line in enumerate((t or "").split("\n")) if line.encode().split()]
    lines = sorted({line for _, _, line in places})
    runs = {x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines}
    near = lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(a, b) for a in lines for b in lines if b < a and near(runs[a], runs[b])]
    root = united(lines, pairs)
    first = {}
    for i, n, line in places:
        first[root[line]] = min(first.get(root[line], (i, n)), (i, n))
    gone = {(i, n) for i, n, line in places if first[root[line]] != (i, n)}
    return {
        i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()
    }


@pytest.mark.parametrize("which", ["docs", "plain"])
def test_line_dedup_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    got = {r.doc.doc_id: r.text for r in fuzzy_lines.without_repeated_lines(df).collect()}
    assert got == kept_by_force(texts_of(df))


def test_line_dedup_takes_repeated_and_null_rows(odd, nothing):
    kept = fuzzy_lines.deduplicated(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(r.doc_id == 9 for r in rows) == 3 and not any(r.doc_id in (14, 15) for r in rows)
    assert {r.doc_id for r in rows} >= {0, 1, 2, 3, None}
    assert fuzzy_lines.deduplicated(nothing).count() == 0


def test_bands_find_alike_lines():
    draw = np.random.default_rng(3)
    found = 0
    for trial in range(200):
        line = "".join(map(chr, draw.integers(97, 123, 300)))
        other = line[:150] + "".join(map(chr, draw.integers(97, 123, 18))) + line[168:]
        keys = fuzzy_lines.band_keys([line, other])
        found += bool((keys[0] == keys[1]).any())
    assert found >= 198


def test_rows_of_one_id_lose_different_lines_at_one_place(spark):
    one, two = ("".join(c * 3 for c in x) for x in ("abcdefghijklmnop", "qrstuvwxyzabdfhj"))
    rows = [(1, one), (2, two), (5, one + "\nfirst of the two"), (5, two + "\nsecond text, other words")]
    kept = fuzzy_lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept if r.doc.doc_id == 5) == ["first of the two", "second text, other words"]


def test_one_changed_character_in_a_short_line_is_found(spark):
    draw = np.random.default_rng(8)
    rows, other = [], {"a": "b"}
    for i in range(60):
        line = "".join(map(chr, draw.integers(97, 123, 50 + i // 2)))
        at = 20 + i % 20
        rows += [(i, line), (100 + i, line[:at] + other.get(line[at], "a") + line[at + 1 :])]
    df = spark.createDataFrame(rows + [(300, "short"), (301, "shirt")], "doc_id long, text string")
    found = {r.doc.doc_id: r.n_removed for r in fuzzy_lines.without_repeated_lines(df).collect()}
    assert [i for i in found if i < 100 and found[i]] == [] and found[300] == found[301] == 0
    assert sum(found[100 + i] for i in range(60)) == 60


def test_two_changed_characters_are_found_at_every_length(spark):
    draw = np.random.default_rng(12)
    rows = []
    for i, length in enumerate(n for n in range(95, 161, 5) for _ in range(4)):
        line = "".join(map(chr, draw.integers(97, 123, length)))
        a, b = length // 4 + i % 4, length * 3 // 4
        changed = line[:a] + "#" + line[a + 1 : b] + "#" + line[b + 1 :]
        rows += [(i, line), (1000 + i, changed)]
    removed = {r.doc.doc_id: r.n_removed for r in fuzzy_lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(removed[i] == (i >= 1000) for i in removed)


def test_line_sets_count_what_is_in_common():
    draw = np.random.default_rng(2)
    lines = ["".join(map(chr, draw.integers(97, 100, draw.integers(1, 60)))) for _ in range(120)] + ["x" * 5000, "", "ab" * 900, "é\U0001f600" * 30]
    runs = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    a, b = np.divmod(np.arange(len(lines) ** 2), len(lines))
    want = [5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j]) for i, j in zip(a, b)]
    assert fuzzy_lines.LineSets(lines).linked(a, b).tolist() == want
    ids = np.arange(len(lines)) % 97
    flagged = np.arange(len(lines)) % 3 == 0
    other = ~flagged | (np.arange(len(lines)) % 5 == 0)
    cuts = [5, 6, 40, 90]
    pairs = {tuple(sorted(p)) for p in fuzzy_lines.AlikeLines().inside_tiles(ids, flagged, other, [lines[i] for i in ids], cuts).tolist()}
    inside = [
        (int(ids[i]), int(ids[j])) for f, t in zip([0, *cuts], [*cuts, len(lines)]) for i in range(f, t) for j in range(f, t)
        if flagged[i] and other[j] and ids[i] != ids[j] and want[ids[i] * len(lines) + ids[j]]
    ]
    assert united(range(97), pairs) == united(range(97), inside) and pairs <= {tuple(sorted(p)) for p in inside}


# --- links -----------------------------------------------------------------------------


def test_components_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    pairs = [tuple(map(int, p)) for p in draw.integers(0, 400, (230, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    found = links.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.root for r in found.collect()} == united(ids, [p for p in pairs if p[0] != p[1]])


def test_connect_loses_no_link(spark):
    """Sizes are linked if one apart; the smallest of the group is linked with few."""

    class Near(links.Relation):
        tile = 4

        def prepare(self, bodies):
            return [int(bytes(b)) for b in bodies]

        def matches(self, prepared, one, others):
            return np.array([abs(prepared[one] - prepared[o]) <= 1 for o in others], dtype=bool)

    values = [*range(0, 40, 2), 7, 8, 21, 22, 23, 60, 61]
    members = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(len(values))], "group long, id long")
    payload = spark.createDataFrame([(i, str(v).encode()) for i, v in enumerate(values)], "id long, body binary")
    edges = links.connect(members, payload, Near())
    found = {r.id: r.root for r in links.components(edges).collect()}
    pairs = [(a, b) for a in range(len(values)) for b in range(a) if abs(values[a] - values[b]) <= 1]
    wanted = united(range(len(values)), pairs)
    assert all(found.get(i, i) == wanted[i] for i in wanted)


def test_owners_of_bands_tell_all_that_share_one():
    draw = np.random.default_rng(6)
    owners, seen, told = fuzzy_lines.FirstOwners(), defaultdict(set), defaultdict(set)
    for size in (0, 50, 1, 400, 0, 300):
        keys, ids = draw.integers(0, 90, size).astype(np.uint64), draw.integers(-40, 40, size)
        keys[: size // 4] = 7  # a crowded band
        for key, own in zip(keys.tolist(), ids.tolist()):
            seen[key].add(own)
        for key, own in zip(*map(np.ndarray.tolist, owners.add(keys, ids))):
            told[key].add(own)
        assert told == {key: some for key, some in seen.items() if len(some) > 1}
    assert len(owners.keys) == len(seen)


def test_only_lines_of_near_sketches_are_paired(monkeypatch):
    """Lines that share a band by chance leave no task, and a crowded band isn't paired at all."""
    monkeypatch.setattr(fuzzy_lines, "CROWD", 5)
    draw = np.random.default_rng(7)
    sketches = draw.integers(0, 1 << 62, 80).astype(np.uint64)
    sketches[1::2] = sketches[::2] ^ np.uint64(0b1011)
    held, seen, crowded = fuzzy_lines.SharedBands(), defaultdict(set), defaultdict(set)
    for size in (0, 30, 1, 200, 0, 150):
        keys, ids = draw.integers(0, 60, size).astype(np.uint64), draw.integers(0, 80, size).astype(np.uint64)
        keys[: size // 4] = 7
        for key, own in zip(keys.tolist(), ids.tolist()):
            seen[key].add(own)
        for key, own, _ in held.add(np.stack([keys, ids, sketches[ids.astype(int)]], axis=1)).tolist():
            crowded[key].add(own)
    assert crowded == {key: some for key, some in seen.items() if len(some) > 5} and 7 in crowded
    near = sorted((a, b) for x, y in held.near() for a, b in zip(x.tolist(), y.tolist()))
    pairs = [(a, b) for key, some in seen.items() if key not in crowded for a in some for b in some if a < b]
    assert near and near == sorted(p for p in pairs if (sketches[p[0]] ^ sketches[p[1]]).item().bit_count() < fuzzy_lines.FAR)
    assert len(near) < len(pairs)


def test_sketches_of_alike_lines_are_near_and_others_far():
    draw = np.random.default_rng(9)
    lines = ["".join(map(chr, draw.integers(97, 123, 200))) for _ in range(300)]
    changed = [x[:60] + "#" + x[61:150] + "#" + x[151:] for x in lines]
    one, two = (fuzzy_lines.signatures(x)[1] for x in (lines, changed))
    assert (np.bitwise_count(one ^ two) < fuzzy_lines.FAR).all()
    assert (np.bitwise_count(one[1:] ^ one[:-1]) < fuzzy_lines.FAR).mean() < 0.01


def test_lines_are_hashed_in_blocks_that_fit_a_cache(monkeypatch):
    draw = np.random.default_rng(5)
    lines = ["".join(map(chr, draw.integers(97, 123, n))) for n in draw.integers(1, 400, 500)] + ["x" * 300_000, "é"]
    whole, sizes, hashes = fuzzy_lines.signatures(lines), [], fuzzy_lines.shingle_hashes
    monkeypatch.setattr(fuzzy_lines, "shingle_hashes", lambda x, *size: sizes.append((len(x), sum(map(len, x[1:])))) or hashes(x, *size))
    for block in (1, 5000, 1 << 16):
        monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
        sizes.clear()
        assert all((a == b).all() for a, b in zip(whole, fuzzy_lines.signatures(lines)))
        fuzzy_lines.LineSets(lines)
        assert sum(n for n, _ in sizes) == 2 * len(lines) and all(size <= block for _, size in sizes)


def test_bands_agree_as_often_as_similarity_says():
    """Minima and maxima alike, and those of one permutation no more often together than apart."""
    draw = np.random.default_rng(6)
    lines = ["".join(map(chr, draw.integers(97, 123, 50))) for _ in range(4000)]
    one, two = fuzzy_lines.band_keys(lines), fuzzy_lines.band_keys([x[:25] + "#" + x[26:] for x in lines])
    alike, want = one == two, (41 / 51) ** 5
    assert np.abs(alike.mean(axis=0) - want).max() < 0.04
    assert np.abs((alike[:, :8] & alike[:, 8:]).mean(axis=0) - want**2).max() < 0.04
    assert alike.any(axis=1).mean() > 0.997


@pytest.mark.parametrize("crowd", [1, 3, 128])
def test_crowded_bands_lose_no_link(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(fuzzy_lines, "CROWD", crowd)
    some = docs.filter("doc_id < 60")
    got = {r.doc.doc_id: r.text for r in fuzzy_lines.without_repeated_lines(some).collect()}
    assert got == kept_by_force(texts_of(some))


def test_long_lines_are_verified_in_pieces(spark, monkeypatch):
    draw = np.random.default_rng(11)
    lines = ["".join(map(chr, draw.integers(97, 123, 300))) for _ in range(20)]
    lines += [x[:100] + "#" + x[101:] for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, body string")
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(20, 40)], "a long, b long")
    for codes in (1, 1000, 1 << 20):
        monkeypatch.setattr(fuzzy_lines, "CODES", codes)
        found = sorted(map(tuple, fuzzy_lines.alike_pairs(pairs, texts).collect()))
        assert found == [(i, i + 20) for i in range(20)]


def near_copies(draw, groups: int, copies: int, length: int) -> list[str]:
    """Copies of some lines, each with a character changed; and lines like those, not alike enough."""
    lines = []
    for _ in range(groups):
        line = "".join(map(chr, draw.integers(97, 123, length)))
        for at in draw.choice(length, copies, replace=False).tolist():
            lines.append(line[:at] + "#" + line[at + 1 :])
        lines.append(line[: length // 2] + "".join(map(chr, draw.integers(97, 123, length - length // 2))))
    return lines


def test_lines_that_are_united_are_not_compared_again(monkeypatch):
    lines = near_copies(np.random.default_rng(13), 3, 40, 150)
    sets, compared, linked = fuzzy_lines.LineSets(lines), [], fuzzy_lines.LineSets.linked
    a, b = np.triu_indices(len(lines), 1)
    close = linked(sets, a, b)
    monkeypatch.setattr(fuzzy_lines.LineSets, "linked", lambda self, a, b: compared.append(len(a)) or linked(self, a, b))
    kept = fuzzy_lines.Forest(sets).unite(a, b)
    pairs = list(zip(a.tolist(), b.tolist()))
    roots = united(range(len(lines)), [p for p, c in zip(pairs, close) if c])
    assert close[kept].all() and united(range(len(lines)), [pairs[k] for k in kept]) == roots
    assert len(kept) == len(lines) - len(set(roots.values())) and len(set(roots.values())) == 6
    assert sum(compared) < len(pairs) and close.sum() - close[kept].sum() > 2000

    compared.clear()  # in a tile, copies that are united don't meet two by two
    one = [x for x in lines[:40]]
    found = fuzzy_lines.AlikeLines().inside_tiles(np.arange(40), np.ones(40, bool), np.ones(40, bool), one, [])
    assert len(found) == 39 and sum(compared) < 40 * 39 // 4


def test_pairs_of_near_copies_have_a_hub_of_their_band():
    draw = np.random.default_rng(14)
    held, groups = fuzzy_lines.SharedBands(), draw.integers(0, 1 << 62, 6).astype(np.uint64)
    ids = np.arange(90, dtype=np.uint64)
    sketches = groups[(ids % np.uint64(6)).astype(int)] ^ (np.uint64(1) << (ids % np.uint64(60)))
    cells = [np.stack([np.full(90, band, np.uint64) + ids % np.uint64(3), ids, sketches], axis=1) for band in (100, 200, 300)]
    lonely = np.stack([np.arange(50, dtype=np.uint64) + np.uint64(1000), ids[:50], sketches[:50]], axis=1)
    held.add(np.concatenate(cells[:2]))
    held.add(np.concatenate([cells[2], lonely]), True)
    assert not (held.cells[:, 0] >= 1000).any()
    near = [set(zip(a.tolist(), b.tolist())) for a, b in held.near()]
    seen = [tuple(x.tolist()) for part in held.near_with_hubs() for x in np.stack(part, axis=1)]
    assert {(a, b) for a, b, _ in seen} == set().union(*near) and seen
    assert all(hub == a % 6 == b % 6 for a, b, hub in seen)


def test_quarters_of_the_bands_share_permutations(monkeypatch):
    asked, drawn = [], fuzzy_lines.permutations
    monkeypatch.setattr(fuzzy_lines, "permutations", lambda n: asked.append(n) or drawn(n))
    fuzzy_lines.signatures(["a line of some words"])
    assert asked == [fuzzy_lines.BANDS * fuzzy_lines.BAND_ROWS // 4]


@pytest.mark.parametrize("codes, batch", [(1, 3), (2000, 10_000), (1 << 20, 7), (1 << 20, 10_000)])
def test_pairs_of_a_hub_are_united_over_batches_and_pieces(spark, monkeypatch, codes, batch):
    lines = near_copies(np.random.default_rng(15), 4, 12, 120)
    pairs = [(i, j, k % 3 * 100 if k % 7 else -5) for k, (i, j) in enumerate((i, j) for i in range(len(lines)) for j in range(i))]
    runs = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    want = united(range(len(lines)), [(i, j) for i, j, _ in pairs if 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j])])
    monkeypatch.setattr(fuzzy_lines, "CODES", codes)
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, body string")
    df = spark.createDataFrame(pairs, "a long, b long, hub long").repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = [tuple(r) for r in fuzzy_lines.alike_pairs(df, texts).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert united(range(len(lines)), found) == want
    assert codes < 1 << 20 or len(found) < 4 * len(lines)


def test_pairs_of_a_large_hub_are_cut(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "HUB_PAIRS", 50)
    lines = near_copies(np.random.default_rng(16), 1, 60, 120)[:60]
    pairs = spark.createDataFrame([(i, j, 7) for i in range(60) for j in range(i)], "a long, b long, hub long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, body string")
    dealt, whole = [], type(pairs).sortWithinPartitions
    monkeypatch.setattr(type(pairs), "sortWithinPartitions", lambda self, *c, **k: dealt.append(self) or whole(self, *c, **k))
    found = [tuple(r) for r in fuzzy_lines.alike_pairs(pairs, texts).collect()]
    assert set(united(range(60), found).values()) == {0}
    sizes = [r.n for r in dealt[0].filter("b is not null").groupBy("hub").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 60 * 59 // 2 and len(sizes) > 20 and max(sizes) < 250


def test_bands_in_many_small_pieces_are_those_of_one(spark, monkeypatch):
    words = [" ".join(f"w{(i * 7 + k) % 40}" for k in range(12)) for i in range(60)]
    lines = spark.createDataFrame([(w, i) for i, w in enumerate(words * 2)], "line string, n long").withColumn("id", F.xxhash64("line"))
    one = sorted(map(tuple, fuzzy_lines.candidates(lines, 120).collect()))
    monkeypatch.setattr(fuzzy_lines, "CELLS", 64)
    monkeypatch.setattr(fuzzy_lines, "PART", 1024)
    assert one and sorted(map(tuple, fuzzy_lines.candidates(lines).collect())) == one


def test_shared_bands_are_found_over_cut_batches(spark):
    words = ["alpha beta gamma delta", "alpha beta gamma delta!", "one two three four five six", "x", "y" * 50, "y" * 51]
    rows = [(f"{words[i % 6]} {'' if i % 4 else i}", i) for i in range(400)]
    lines = spark.createDataFrame(rows, "line string, n long").withColumn("id", F.xxhash64("line")).repartition(5)
    wanted = defaultdict(set)
    for r in lines.select("id", "line").distinct().collect():
        for key in fuzzy_lines.band_keys([r.line])[0]:
            wanted[int(key.astype(np.int64))].add(r.id)
    wanted = sorted((g, i) for g, ids in wanted.items() if len(ids) > 1 for i in ids)
    assert len(wanted) > 100
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 2, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert sorted(map(tuple, fuzzy_lines.candidates(lines).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert fuzzy_lines.candidates(lines.limit(0)).count() == 0


# --- 5 ---------------------------------------------------------------------------------


def scores_by_force(texts: list) -> list[tuple]:
    words = [(t or "").encode().split() for t in texts]
    single, double = Counter(w for d in words for w in d), Counter(p for d in words for p in zip(d, d[1:]))
    total, out = sum(map(len, words)), []
    for d in words:
        own, pairs, score, back = Counter(d), Counter(zip(d, d[1:])), 0.0, 0
        for i, w in enumerate(d):
            pair = (d[i - 1], w)
            if i and double[pair] > pairs[pair]:
                score += math.log((double[pair] - pairs[pair]) / (single[d[i - 1]] - own[d[i - 1]]))
                continue
            back += i > 0
            if single[w] > own[w]:
                score += math.log(0.4 * (single[w] - own[w]) / (total - len(d)))
            else:
                score += math.log(0.16 / (total - len(d) + 1))
        out.append((len(d), back, round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_scores_equal_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = lm_scoring.score(df).collect()
    wanted = scores_by_force([r.text for r in df.select("text").collect()])
    got = sorted((r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert np.allclose([g[2] for g in got], [w[2] for w in wanted], atol=1e-5)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(
        r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None
    )


def test_scores_of_nothing_and_of_higher_order(nothing, docs):
    assert lm_scoring.score(nothing).count() == 0
    third = {r.doc_id: r for r in lm_scoring.score(docs, order=3).collect()}
    assert len(third) == docs.count() and all(r.log_score <= 0 for r in third.values())


# --- 6 ---------------------------------------------------------------------------------


def components_by_force(texts: dict) -> dict:
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    root = united(ids, [(a, b) for a in ids for b in ids if b < a and alike(sets[a], sets[b])])
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.mark.parametrize("which", ["docs", "plain"])
def test_shingle_join_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = shingle_join.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_force(texts_of(df))
    assert sum(r.is_first for r in rows) == len({r.component_id for r in rows})


def test_shingle_join_takes_repeated_and_null_rows(odd, nothing):
    kept = shingle_join.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and 14 not in ids and 15 not in ids and ids.count(None) == 1
    assert shingle_join.one_of_each(nothing).count() == 0


def test_bitmaps_never_exclude_a_link():
    draw = np.random.default_rng(6)
    bound, exact = shingle_join.BitmapBound(), shingle_join.AlikeDocuments()
    for _ in range(100):
        whole = draw.integers(0, 1 << 63, int(draw.integers(5, 900)), dtype=np.uint64)
        sets = [np.unique(draw.choice(whole, int(len(whole) * draw.uniform(0.8, 1)) or 1, replace=False)) for _ in range(2)]
        maps = [len(s).to_bytes(8, "little") + shingle_join.bitmap(s)[1] for s in sets]
        may = bound.matches(bound.prepare(maps), 0, np.array([1]))[0]
        assert may or not exact.matches(exact.prepare([s.tobytes() for s in sets]), 0, np.array([1]))[0]


# --- 7 ---------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, refers_to long, digest string"


def test_archives_give_back_what_was_written(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n" * 200, "z" * 1000
    rows = [(1, "http://a/\n1", big), (2, None, big), (3, "u", "x"), (4, "u", "x"), (5, "u", None), (6, "u", ""), (7, "u", big)]
    rows += [(7, "u", big), (None, "u", big), (8, "u", other), (9, "u", other), (10, "u", "z" * 999), (11, "u", "z" * 999)]
    pages = spark.createDataFrame([(*r, 5, "d") for r in rows], PAGES).repartition(3)
    wanted = []
    for i, _, html in rows:
        body = (html or "").encode()
        last = max(r[0] for r in rows if r[0] is not None and (r[2] or "") == (html or ""))
        to = last if len(body) >= 1000 and last != i else None
        wanted.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if to else "response", to))
    got = [(str(r[0]), *r[1:]) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_normalised_record_by_record(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, "u", str(i) * 3000) for i in range(20)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), f"{tmp_path}/raw")
    files = warc.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/warc").filter("records > 0").collect()
    assert sum(f.records for f in files) == 20
    for at, size, file in [(r["at"], r["size"], r["file"]) for r in warc.read_index(spark, f"{tmp_path}/warc").collect()]:
        with open(file.removeprefix("file://"), "rb") as archive:
            archive.seek(at)
            assert gzip.decompress(archive.read(size)).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_archives_inflate_in_bounded_steps():
    import gzip
    import io

    parts = [b"a" * (5 * warc.STEP + 7), b"", bytes(range(256)) * 3, np.random.default_rng(7).bytes(3 * warc.STEP), b"b" * (40 * warc.STEP)]
    for file in (b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts))):
        steps = list(warc._inflated(io.BytesIO(file)))
        assert max(map(len, steps)) <= warc.STEP and b"".join(steps) == b"".join(parts)


def test_archives_hold_payloads_beyond_a_step(spark):
    long, odd = "é" * (2 * warc.STEP), "".join(chr(33 + i * i % 89) for i in range(warc.STEP + 1))
    rows = [(1, "u", long), (2, "u", odd), (3, "u", long), (4, "u", "x" * 20 * warc.STEP)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    for r in got:
        body = rows[r.page_id - 1][2].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [
        (1, "revisit", 3), (2, "response", None), (3, "response", None), (4, "response", None)
    ]


def test_a_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


# --- 8 ---------------------------------------------------------------------------------


def test_languages_are_recognised_when_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    tested = found.filter("held_out")
    assert tested.filter("lang = lang_pred").count() / tested.count() > 0.98
    ids = [r.doc_id for r in tested.select("doc_id").collect()]
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


def places_by_force(text: str) -> set:
    """Places of the runs of 1 to 4 characters, one run at a time."""
    text, found = text.lower(), set()
    for size in range(1, 5):
        for at in range(len(text) - size + 1):
            gram = 0
            for c in text[at : at + size]:
                gram = (gram + ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
                gram ^= gram >> 29
            found.add(gram >> 48)
    return found


def test_scores_are_those_of_kernels_between_texts(spark):
    docs = spark.read.parquet(DOCS).filter(F.length("text").between(1, 600) & F.col("lang").isNotNull()).limit(60)
    rows = docs.select("doc_id", "text", "lang").collect()
    learnt = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and any(map(str.isalpha, r.text))]
    assert len(learnt) < language.LANDMARKS and len({r.lang for r in learnt}) > 1  # so all of them are landmarks
    sets = [places_by_force(r.text) for r in learnt]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    near = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(near)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    sizes = Counter(r.lang for r in learnt)
    share = np.array([1 / sizes[r.lang] for r in learnt])
    share = np.sqrt(share / share.mean())[:, None]
    names = sorted(sizes)
    wanted = np.array([[float(r.lang == name) for name in names] for r in learnt])
    # Ridge regression as least squares with a row for each penalty.
    left = np.concatenate([near @ root * share, math.sqrt(language.RIDGE) * np.eye(root.shape[1])])
    right = np.concatenate([wanted * share, np.zeros((root.shape[1], len(names)))])
    weights = root @ np.linalg.lstsq(left, right, rcond=None)[0]
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(found) == len(rows)
    for r in rows:
        if not any(map(str.isalpha, r.text)):
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0)
            continue
        score = np.array([kernel(places_by_force(r.text), s) for s in sets]) @ weights
        assert found[r.doc_id].lang_pred == names[int(score.argmax())]
        assert found[r.doc_id].score == pytest.approx(min(1, max(0, score.max())), abs=1e-4)


def test_language_takes_odd_rows(odd, nothing, spark):
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 5)} == {"und"}
    kept = language.identified(odd)
    assert kept.schema == odd.schema and {0, 1, 2, 5}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language.identify(nothing).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


# --- 9 ---------------------------------------------------------------------------------


def targets_by_force(sizes: dict, weights=(5, 2, 1)) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix_meets_its_targets(request, which):
    df = request.getfixturevalue(which)
    mix = mixing.Mix(df, block_words=64)
    rows = mix.taken().collect()
    assert len(rows) == df.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    wanted = targets_by_force(dict(sizes))
    for r in rows:
        assert math.isclose(r.target, wanted[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - wanted[s]) <= 0.5 for s in wanted)
    key = lambda r: (str(r.doc_id), str(r.source), r.text_hash, r.copy, r.taken)
    again = mixing.Mix(df, block_words=64).taken().collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_targets_stop_at_three_times_a_source(spark):
    rows = [("a", 1), ("b", 1000), ("c", 1000), ("d", 2), (None, 0)]
    sized = spark.createDataFrame(rows, "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.repeating_weights(sized)).collect()}
    wanted = targets_by_force(dict(rows))
    assert all(math.isclose(got[s], wanted[s]) for s in wanted) and got["a"] == 3


def test_mixed_documents_hold_what_is_taken(odd, nothing):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    wanted = Counter()
    for r in mixing.Mix(odd).taken().collect():
        wanted[r.doc_id] += r.taken
    assert +words == +wanted
    assert mixing.mixed_documents(nothing).count() == 0


def test_slots_are_one_to_one(spark):
    for n in (1, 2, 7, 100, 1000):
        x = mixing.permuted(F.col("id"), F.lit(n), F.lit("key")).alias("x")
        assert sorted(r.x for r in spark.range(n).select(x).collect()) == list(range(n))


# --- 10 --------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "plain"])
def test_packing_is_a_round_trip(request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    rows = packing.pack(df).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts_of(df).items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        parts = sorted(pieces.pop(i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == ids.tobytes()
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        assert {r.doc_tokens for r in parts} == {len(ids)}
    assert not pieces
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        total = sum(r.length for r in parts)
        assert total <= 1024
        padding += 1024 - total
    assert padding <= 0.05 * 1024 * len(sequences) + 1024


def test_packing_takes_odd_rows(odd, nothing):
    rows = packing.pack(odd).collect()
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert packing.pack(nothing).count() == 0


def test_windows_are_bounded_and_best_fit():
    windows = packing.OpenWindows(0, size=10, keep=2)
    assert windows.place(6) == (0, 0) and windows.place(7) == (1, 0)
    assert windows.place(3) == (1, 7)  # exactly full: closed
    assert windows.place(5) == (2, 0) and windows.place(6) == (3, 0)  # the fullest, 0, went
    assert windows.place(4) == (3, 6) and len(windows.spaces) == 1


def test_added_tokens_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [
        "end of page<|endoftext|>next page", "<|endoftext|>", "a <|endoftext|> b  c", "<|endoftext|><|endoftext|>\n d",
        "plain text", "", "<|endoftext| >", " é<|endoftext|>é ",
    ]
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in packing.Encoder().encode(texts)] == want
