import random
from pathlib import Path

import numpy as np

from roadcut.llm import _io, _seq, order_minhash as O
from roadcut.plans import store


def words_hash(w):
    b = " ".join(w).encode()
    d = np.frombuffer(b, np.uint8)
    s, e, of = _seq.words(d, np.array([0, len(d)]))
    return O.labelled(_seq.word_symbols(d, s, e), of, 5)[0]


def brute(a, b):
    """Longest common subsequence of labelled shingles."""
    m = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1, j + 1] = m[i, j] + 1 if x == y else max(m[i, j + 1], m[i + 1, j])
    k = m[-1, -1]
    return k / max(len(a) + len(b) - k, 1)


def test_alignment():
    rng = random.Random(1)
    for _ in range(120):
        w = [rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(rng.randint(5, 70))]
        v = list(w)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(v))
            v[i : i + rng.randint(0, 2)] = [rng.choice("xyz")] * rng.randint(0, 2)
        if rng.random() < 0.3:
            k = rng.randrange(len(v))
            v = v[k:] + v[:k]
        a, b = words_hash(w), words_hash(v)
        for s in (0.5, 0.8, 0.9):
            assert O.aligned(a, b, s) == (len(a) > 0 and len(b) > 0 and brute(a, b) >= s - 1e-12)


def test_classes(spark, docs, rows, none):
    got = {}
    for r in O.classes(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert O.classes(docs).count() == len(rows) and all(len(v) == 1 for v in got.values())
    sh = {k: words_hash((t or "").split()) if (t or "").split() else np.zeros(0, np.uint64) for k, t in rows}
    said = {k: " ".join((t or "").replace("\n", " ").split(" ")).split() for k, t in rows}
    parent = {k: k for k in sh}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    keys = sorted(sh)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if said[a] == said[b] or len(sh[a]) and len(sh[b]) and brute(sh[a], sh[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {k: min(v) for k, v in got.items()} == {k: find(k) for k in keys}
    assert O.classes(none).count() == 0


def test_large_groups(spark):
    """A third of the rows are near copies of one text, another third share a passage and are not alike."""
    rng = random.Random(2)
    w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        v = list(w)
        v[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(v)))
    for i in range(150, 300):
        rows.append((i, " ".join([*w[:30], *(f"x{rng.randrange(10**6)}" for _ in range(100))])))
    got = {r.doc_id: r.class_id for r in O.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(150)) and all(got[i] == i for i in range(150, 300))


def test_star(spark):
    """A thousand copies that are like their original but not like each other are one class; so are those of a second."""
    rng = random.Random(5)
    rows = []
    for k, size in ((0, 1000), (1, 60)):
        w = [f"w{k}x{i}" for i in range(120)]
        rows.append((5000 * k + 2500, " ".join(w)))
        for i in range(size):
            v = list(w)
            for p in (rng.randrange(5, 55), rng.randrange(60, 115)):
                v[p] = f"e{k}x{i}x{p}"
            rows.append((5000 * k + i, " ".join(v)))
    got = {r.doc_id: r.class_id for r in O.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 5000 * 5000 for i, _ in rows}


def test_shared_and_missing_ids(spark):
    """Rows with one doc_id, or none, are told apart by their texts."""
    rng = random.Random(4)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abc")
    rows = [(5, a), (5, b), (2, b), (None, c), (None, a + " x"), (7, a), (None, None), (5, "")]
    got = O.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    key = {(r.doc_id, r.same): r for r in got.collect()}
    assert got.count() == len(rows)
    by = {}
    for r, (i, t) in zip(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS same").collect(), rows):
        by.setdefault(key[r.doc_id, r.same].class_key, set()).add(((t or "")[:1], key[r.doc_id, r.same].class_id))
    assert sorted(by.values(), key=str) == sorted([{("", 5)}, {("a", 5)}, {("b", 2)}, {("c", None)}], key=str)


def test_prefix_filter_loses_no_pair(spark):
    """Texts that differ from each other in a few words up to many: any two similar ones share a posting."""
    rng = random.Random(6)
    w = [f"w{i}" for i in range(60)]
    said = []
    for i in range(80):
        v = list(w)
        for p in rng.sample(range(60), rng.randint(0, 5)):
            v[p] = f"e{i}x{p}" if rng.random() < 0.7 else "same"
        said.append(v[: rng.randint(50, 60)])
    sh = [words_hash(v) for v in said]
    flat = lambda g: (g >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    shingles = spark.createDataFrame([(i, bytearray(flat(g))) for i, g in enumerate(sh)], "rep long, shingles binary")
    keys = {}
    for r in O._postings(shingles.select("rep"), shingles, 0.8).collect():
        keys.setdefault(r.rep, set()).add(r.key)
    similar = [(i, j) for i in range(80) for j in range(i) if brute(sh[i], sh[j]) >= 0.8]
    assert len(similar) > 50 and all(keys.get(i, set()) & keys.get(j, set()) for i, j in similar)


def test_spread(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else None, i) for i in range(100)], "k long, v long")
    other = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, w string")
    got = sorted(map(tuple, _io.spread(rows, ["k"], other, "v").select("k", "v", "w").collect()))
    assert got == sorted(map(tuple, rows.join(other, "k").select("k", "v", "w").collect()))


def test_pairs_without_a_shared_key_are_linked(spark):
    """Texts alike by 0.8 or a little more of which no Order MinHash key agrees."""
    rng, pairs = random.Random(8), []
    while len(pairs) < 3:
        w = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        v = list(w)
        for p in (30, 75):
            v[p] = f"e{rng.randrange(10**6)}"
        g = [words_hash(x) for x in (w, v)]
        keys = [O.sketches(x, np.zeros(len(x), np.int64), 1)[0] for x in g]
        if not set(keys[0].tolist()) & set(keys[1].tolist()) and O.aligned(*g, 0.8):
            pairs.append((w, v))
    rows = [(2 * i + k, " ".join(x)) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    got = {r.doc_id: r.class_id for r in O.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_the_order_of_shingles_loses_no_pair():
    """Whichever shingles are taken to be common, two similar texts share one of their prefixes."""
    rng = random.Random(9)
    w = [f"w{i}" for i in range(60)]
    said = []
    for i in range(60):
        v = list(w)
        for p in rng.sample(range(60), rng.randint(0, 4)):
            v[p] = f"e{i}x{p}"
        said.append(v[: rng.randint(50, 60)])
    sh = [words_hash(v) for v in said]
    key, of = O._cut(np.concatenate(sh)), np.repeat(np.arange(60), [len(g) for g in sh])
    for told in (0, 20, 50):
        common = np.sort(rng.sample(np.unique(key).tolist(), told)).astype(np.int64), np.array([rng.randint(3, 9) for _ in range(told)], np.int64)
        got, start, plain = O.prefixes(key, of, 60, 0.8, common)
        part = [set(got[a:b].tolist()) for a, b in zip(start[:-1], start[1:])]
        assert all(not set(common[0].tolist()) & set(got[a : a + n].tolist()) for a, n in zip(start, plain))
        similar = [(i, j) for i in range(60) for j in range(i) if brute(sh[i], sh[j]) >= 0.8]
        assert len(similar) > 20 and all(part[i] & part[j] for i, j in similar)
        told = [O.tally(O._cut(g)) for g in sh]
        assert all(O.could_be(told[i], told[j], len(sh[i]) + len(sh[j]), 0.8) for i, j in similar)


def test_tables_that_are_no_longer_read_are_deleted(spark):
    rng, folder = random.Random(3), Path(spark.conf.get("spark.checkpoint.dir"))
    w = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join([*w[: i % 5], f"e{i}", *w[i % 5 :]])) for i in range(12)]
    before, was = set(folder.iterdir()), spark.conf.get(store.CLEANUP, None)
    got = O.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before if "-" in p.name and any(p.iterdir())}
    assert not left & {"sketches", "texts", "buckets", "rare", "shingles", "pairs"} and spark.conf.get(store.CLEANUP, None) == was
    assert {r.class_id for r in got.collect()} == {0}


def test_spread_by_counted_rows(spark):
    """A key of few rows has one share, so what meets it is sent once."""
    rows = spark.createDataFrame([("a", i, 3) for i in range(3)] + [("b", i, 2500) for i in range(2500)], "k string, v long, n long")
    other = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, w long")
    got = _io.spread(rows, ["k"], other, "v", n="n").select("k", "v", "w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(other, "k").select("k", "v", "w").collect()))
