"""Near duplicates and repeated substrings against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from tidemill.llm import common, neardup, substrings
from tidemill.llm.common import WordHashes


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def plain_components(texts, k, num, den):
    s = plain_sets(texts, k)
    root = list(range(len(s)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(s)), 2):
        if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(a) for a in range(len(s))], [len(x) for x in s]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components(docs, texts, k, num, den):
    comp, sizes = plain_components(texts, k, num, den)
    got = {r["doc_id"]: r for r in neardup.jaccard_components(docs, k=k, num=num, den=den).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_components_of_odd_tables(odd, none, texts):
    assert neardup.jaccard_components(none).count() == 0
    comp, _ = plain_components(texts, 5, 80, 100)
    got = neardup.jaccard_components(odd).collect()
    assert len(got) == 2 * len(texts) + 3
    assert all(r["component_id"] == comp[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_components_of_repeated_ids(spark, texts):
    base = texts[60].split()
    changed = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (0, 3)]
    other = texts[61].split()
    chain = [texts[61], " ".join(["x"] * 3 + other[3:]), " ".join(["x"] * 6 + other[6:]), " ".join(["x"] * 9 + other[9:])]
    rows = [(5, texts[60]), (5, texts[0]), (5, texts[61]), (6, changed[0]), (7, changed[1]), (8, chain[1]), (None, chain[2]), (9, chain[3]), (3, texts[62]), (2, texts[62] + " z"), (2, texts[1])]
    comp, _ = plain_components([t for _, t in rows], 5, 90, 100)
    least = [min((i for (i, _), c in zip(rows, comp, strict=True) if c == own and i is not None), default=None) for own in comp]
    got = neardup.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", neardup.F.xxhash64("text")), num=90, hash_col="n").collect()
    of = {r["n"]: r["component_id"] for r in got}
    hashes = [r[0] for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i int, text string").select(neardup.F.xxhash64("text"), "i").orderBy("i").collect()]
    assert [of[h] for h in hashes] == least and len(set(comp)) == 5


def test_components_of_cut_buckets(docs, spark, texts, monkeypatch):
    """Buckets in parts and chunks of a few nodes, all of them taken for heavy or all for light, with chains and common passages."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    some = [" ".join([*passage, *(word() for _ in range(r.randint(8, 30)))]) for _ in range(40)]
    for i in range(12):
        w = some[i].split()
        w[i] = "other"
        some.append(" ".join(w))
    comp, _ = plain_components(some, 5, 80, 100)
    df = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(neardup, "PART", 3)
    monkeypatch.setattr(neardup, "CHUNK", 3)
    for cross, big in ((0, 4), (0, 1000), (1 << 40, 4)):
        monkeypatch.setattr(neardup, "CROSS", cross)
        monkeypatch.setattr(neardup, "BIG", big)
        got = {x["doc_id"]: x["component_id"] for x in neardup.jaccard_components(df).collect()}
        assert [got[i] for i in range(len(some))] == comp and len(set(comp)) > 3


def test_sketch_bounds_differences():
    r = np.random.default_rng(1)
    bands = neardup.Bands(85, 100)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(7, 800), np.int64).view(np.uint64))
        d = int(r.integers(0, max(1, bands.differences(2 * len(a)))))
        b = np.unique(np.concatenate([a[d // 2 :], r.integers(0, 1 << 63, d - d // 2, np.int64).view(np.uint64)]))
        assert neardup.hamming(neardup.sketch_of(a), neardup.sketch_of(b)) <= len(np.setxor1d(a, b))
        union = len(np.union1d(a, b))
        if 100 * len(np.intersect1d(a, b)) >= 85 * union and not np.array_equal(a, b):
            assert len(np.intersect1d(bands.keys(a), bands.keys(b))) >= (2 if min(len(a), len(b)) <= bands.small() else 4)


def test_shingles_of_short_texts():
    h = WordHashes()
    assert [len(neardup.shingles(t, 4, h)) for t in (None, "", " \n", "a", "a b c", "a b c d", "a b c d e")] == [0, 0, 0, 1, 1, 1, 2]
    assert np.array_equal(neardup.shingles("A B", 4, h), neardup.shingles("a\tb", 4, h))


def plain_dedup(texts, k=13):
    first = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = []
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_dedup(docs, none, texts):
    want = plain_dedup(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert substrings.dedup(none).count() == 0
    assert sum(x[1] for x in want) > 500


def test_dedup_of_repeated_rows(odd, texts):
    want = plain_dedup(texts)
    for r in substrings.dedup(odd).collect():
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]


def test_dedup_of_hot_buckets(docs, texts, monkeypatch):
    """Buckets that are dealt again by their windows, long texts in stretches, and strings known from earlier slices."""
    want = plain_dedup(texts)
    monkeypatch.setattr(substrings, "HEAVY", 2000)
    monkeypatch.setattr(substrings, "HELD", 3000)
    monkeypatch.setattr(substrings.stretches, "__defaults__", (500,))
    dealt = substrings.repeated_ranges(docs, "doc_id", "text")
    assert dealt.count() > 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_stretches_hold_all_windows(texts):
    for t in texts:
        ws = (t or "").encode().split()
        for size in (1, 40, 100_000):
            seen = [(at + j, tuple(line.split()[j : j + 13])) for at, line in substrings.stretches(t, 13, size) for j in range(len(line.split()) - 12)]
            assert seen == [(j, tuple(ws[j : j + 13])) for j in range(len(ws) - 12)]


def test_dedup_by_another_name(docs, texts):
    got = {r["id"]: r["kept"] for r in substrings.dedup(docs.withColumnRenamed("doc_id", "id").withColumnRenamed("text", "ranges"), "id", "ranges").collect()}
    assert [got[i] for i in range(len(texts))] == [x[2] for x in plain_dedup(texts)]


def test_dedup_of_repeated_ids(spark, texts):
    """Texts of one id don't repeat each other, and each loses only its own words."""
    a, b = texts[60], texts[0] + " " + texts[1]
    df = spark.createDataFrame([(5, a), (5, b), (5, a + " more"), (6, "x " + a), (None, a), (2, b)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.dedup(df).collect())
    n, m = len(a.split()), len(b.split())
    assert got == sorted([(5, n, 0), (5, m, m), (5, n + 1, 0), (6, n + 1, n), (0, n, 0), (2, m, 0)])


def test_known_strings():
    data = b"one two|one two|three|one two"
    a, b, h = np.array([0, 8, 16, 22]), np.array([7, 15, 21, 29]), np.array([1, 1, 2, 1], np.uint64)
    k = substrings.Known()
    assert k.repeated(data, np.array([4, 3, 3, 3]), a, b, h).tolist() == [True, False, False, False]
    assert k.repeated(data, np.array([5, 5, 2, 2]), a, b, h).tolist() == [True, True, False, False]
    assert k.least == {b"one two": 2}


def test_buckets_and_equal_hashes(monkeypatch):
    """Windows whose hashes are all equal are still told apart by their words."""
    lines = [b"a b c d e", b"b c d e f", b"x b c d y"]
    monkeypatch.setattr(substrings, "mix", lambda h: h * np.uint64(0))
    line, place = substrings.repeats(np.array([1, 2, 3]), [b"\n".join(lines)], window=3)
    assert list(zip(line.tolist(), place.tolist(), strict=True)) == [(1, 0), (1, 1), (2, 1)]


def test_ranges():
    d, a, b = substrings._joined(np.array([2, 1, 1, 1]), np.array([0, 20, 0, 10]), np.array([13, 33, 13, 23]))
    assert list(zip(d, a, b, strict=True)) == [(1, 0, 33), (2, 0, 13)]


def test_super_kmers_tell_where_windows_stand():
    text = substrings.Text(b"\n".join(b" ".join(b"w%d" % (i * j % 17) for i in range(60)) for j in (1, 2, 3)))
    first, last, _ = substrings.super_kmers(text)
    windows = [w for a, b in zip(first, last, strict=True) for w in range(a, b - 12)]
    assert windows == [w for j in range(3) for w in range(60 * j, 60 * j + 48)]
    assert hashlib.sha256(text.data).hexdigest()


def test_few_pairs_are_sent(spark):
    """Large sets that meet once in light buckets are no pair; a group of near copies sends pairs by its nodes, not by their square."""
    n = 200
    rows = spark.createDataFrame([(k, i, n, i, 2, 1) for k, i in ((7, 1), (7, 2), (8, 1), (8, 2), (9, 1), (9, 3))], "key bigint, id bigint, n bigint, label bigint, size bigint, major bigint")
    assert [tuple(r) for r in neardup.across(rows, 85, 100).collect()] == [(1, 2)]
    group = spark.createDataFrame([(7, i, n, i, 100, bytearray([1 << i % 8] + [0] * 31)) for i in range(100)], "key bigint, id bigint, n bigint, label bigint, size bigint, sketch binary")
    assert neardup.within(group, 85, 100).count() == 4950
    few = {tuple(r) for r in neardup.within(group, 85, 100, 8).collect()}
    assert len(few) <= 800 and {x for p in few for x in p} == set(range(100))


def test_keys_of_parts_of_few_tokens_are_left_out():
    """Unrelated sets share next to no keys, however many there are; a set sends as many keys as its bands have differences and common keys."""
    r = np.random.default_rng(2)
    bands = neardup.Bands(80, 100)
    for n in (30, 330):
        keys = [bands.keys(np.unique(r.integers(0, 1 << 63, n, np.int64).view(np.uint64) * np.uint64(2))) for _ in range(80)]
        assert {len(k) for k in keys} == {sum(bands.parts[b] - bands.spare[b] for b in bands.of(n))}
        assert sum(len(np.intersect1d(a, b)) for a, b in itertools.combinations(keys, 2)) < 30  # of 3,160 pairs


def test_keys_of_differences_that_cancel():
    """Differences that fall on one bit leave parts alike though their tokens differ; linked sets have enough keys in common still."""
    r = np.random.default_rng(4)
    for num, n in ((80, 60), (80, 300), (85, 300)):
        bands = neardup.Bands(num, 100)
        a = np.unique(r.integers(0, 1 << 63, n, np.int64).view(np.uint64) * np.uint64(2))
        most = (100 - num) * n // num  # b has all of a and so many more
        band = list(bands.of(n))[0]
        p = bands.parts[band]
        by_size = np.argsort(np.bincount(((a >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64), minlength=p), kind="stable")
        for pairs in (0, most // 4, most // 2):
            high = ((by_size[np.arange(pairs) % p].astype(np.uint64) << np.uint64(32)) // np.uint64(p) + np.uint64(1)) << np.uint64(32)
            twice = np.concatenate([high | np.uint64(i << 12) for i in range(2)])
            b = np.unique(np.concatenate([a, twice, r.integers(0, 1 << 63, most - 2 * pairs, np.int64).view(np.uint64) * np.uint64(2)]))
            assert 100 * n >= num * len(b)
            assert len(np.intersect1d(bands.keys(a), bands.keys(b))) >= (2 if n <= bands.small() else 4)


def test_first_nodes_are_compared_where_they_meet_twice(spark):
    rows = spark.createDataFrame([(k, i, n, (a, m)) for k, a, i, n, m in ((7, 1, 1, 200, 200), (7, 1, 2, 200, 200), (8, 1, 2, 200, 200), (9, 1, 3, 200, 200), (9, 1, 4, 900, 200), (8, 1, 4, 900, 200), (5, 6, 7, 9, 9))], "key bigint, id bigint, n bigint, lead struct<id bigint, n bigint>")
    assert sorted(tuple(r) for r in neardup.led(rows, 85, 100).collect()) == [(1, 2), (6, 7)]


def test_workers_forget_words_before_pairs():
    WordHashes.shared().of([b"a", b"b"])
    assert list(neardup.lean(iter)([1, 2])) == [1, 2]
    assert "words" not in common._memo and not WordHashes.shared()
