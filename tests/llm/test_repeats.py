import collections
import hashlib
import re
import random

import numpy as np

from roadcut.llm import _seq, substring_fm, suffix_lpf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_words(rows, n):
    words = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (k, _), w in zip(rows, words):
        c = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                c[i : i + n] = b"\1" * n
        out.append((k, len(w), sum(c), sha(" ".join(x for x, y in zip(w, c) if not y).encode())))
    return sorted(out)


def brute_bytes(rows, n):
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        c = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                c[i : i + n] = b"\1" * n
            seen.add(b[i : i + n])
        out.append((k, len(b), sum(c), len(re.findall(b"\1+", bytes(c))), sha(bytes(x for x, y in zip(b, c) if not y))))
    return sorted(out)


def test_words(docs, rows, none):
    for n in (35, 12):
        got = substring_fm.remove_repeated_words(docs, n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == brute_words(rows, n)
    assert substring_fm.remove_repeated_words(none).count() == 0


def test_bytes(docs, rows, none):
    for n in (100, 40):
        got = suffix_lpf.remove_later_copies(docs, n).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == brute_bytes(rows, n)
    assert suffix_lpf.remove_later_copies(none).count() == 0


def test_rows_without_or_with_one_id(spark, texts):
    """A third of the rows have no id, some share one: each row counts for itself; those without come first."""
    rows = [(None if i % 3 == 0 else 7 if i % 5 == 0 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(map(str, r))
    got = substring_fm.remove_repeated_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = [(rows[i][0], *r[1:]) for i, r in enumerate(sorted(brute_words(list(enumerate(texts)), 35)))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    hashed = [r[0] for r in spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").selectExpr("pmod(xxhash64(t), 2305843009213693952L)").collect()]
    place = [(k if k is not None else -(2**62) - h, t) for (k, t), h in zip(rows, hashed)]
    got = suffix_lpf.remove_later_copies(df).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(r[1:] for r in brute_bytes(place, 100))


def test_hot_anchors_take_the_other_way(docs, rows, monkeypatch, spark):
    """With every anchor hot, the merged windows alone must find the same."""
    from roadcut.llm import repeats

    monkeypatch.setattr(repeats, "HOT_HOMES", 1)
    monkeypatch.setattr(repeats, "HOME_BYTES", 4000)
    # workers import the module anew, so the kernels are called here
    import pyarrow as pa

    spec = repeats.Spec("bytes", 100, 50, 6, 25, True)
    homes = collections.defaultdict(list)
    for k, t in rows:
        homes[k % 5].append((k, t or ""))
    tables = {h: pa.table({"doc_id": pa.array([k for k, _ in v], pa.int64()), "place": pa.array([k for k, _ in v], pa.int64()), "text": pa.array([t for _, t in v])}) for h, v in homes.items()}
    key = lambda *x: tuple(pa.scalar(v) for v in x)
    packed = pa.concat_tables([repeats._anchors(spec, 4)(key(h), t) for h, t in tables.items()])
    groups = {(k, b) for k, b in zip(packed["kind"].to_pylist(), packed["bucket"].to_pylist())}
    pick = lambda t, c, v: t.filter(pa.compute.equal(t[c], v))
    known = pa.concat_tables([repeats._common(key(*g), pick(pick(packed, "kind", g[0]), "bucket", g[1])) for g in groups])
    mid = pa.concat_tables([repeats._segments(spec, 4)(key(h), t, pick(known, "home", h)) for h, t in tables.items()])
    assert not len(pick(mid, "kind", 2)) and len(pick(mid, "kind", 3))
    hot = pick(mid, "kind", 3)
    back = pa.concat_tables([repeats._merged(spec)(key(b), pick(hot, "key", b)) for b in set(hot["key"].to_pylist())])
    live, done = pick(mid, "kind", 1), pick(mid, "kind", 0)
    rest = [repeats._removed(spec)(key(h), pick(live, "home", h), pick(back, "home", h)) for h in homes]
    names = ["doc_id", "n_symbols", "n_removed", "n_spans", "kept_sha256"]
    got = pa.concat_tables([done.select(names), *(r.select(names) for r in rest)]).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == brute_bytes(rows, 100)


def test_wavelet_matrix():
    v = np.random.default_rng(1).integers(0, 37, 500)
    m = substring_fm.WaveletMatrix(v, 37)
    s, lo = np.arange(37), np.zeros(37, np.int64)
    for hi in (0, 1, 63, 64, 65, 499, 500):
        a, b = m.rank(s, lo, np.full(37, hi))
        assert (b - a == np.bincount(v[:hi], minlength=37)).all()


def test_matching_statistics():
    rng = random.Random(2)
    texts = [[rng.randrange(4) for _ in range(rng.randint(6, 40))] for _ in range(30)]
    length, depth = np.array([len(t) for t in texts]), 6
    weight = np.array([rng.randint(1, 3) for _ in texts])
    index = substring_fm.FMIndex(np.array(sum(texts, []), np.uint32), length, weight, depth)
    match, times = index.statistics(length)
    count = collections.Counter()
    for t, w in zip(texts, weight.tolist()):
        for i in range(len(t)):
            for n in range(1, depth + 1):
                if i + n <= len(t):
                    count[tuple(t[i : i + n])] += w
    at = 0
    for t in texts:
        for i in range(len(t)):
            n = min(depth, len(t) - i)
            assert match[at] == n and times[at] == count[tuple(t[i : i + n])]
            at += 1


def test_previous_factor():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(25)]
    window = 20
    lpf = suffix_lpf.previous_factor(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), window)
    at = 0
    for k, t in enumerate(texts):
        for i in range(len(t)):
            best = 0
            for n in range(1, min(window, len(t) - i) + 1):
                f = t[i : i + n]
                if any(f in x for x in texts[:k]) or t.find(f) < i:
                    best = n
            assert lpf[at] == best, (k, i)
            at += 1
    assert (suffix_lpf.earlier_window(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), window) == (lpf == window)).all()


def test_previous_smaller():
    v = np.random.default_rng(4).permutation(300)
    p = _seq.previous_smaller(v)
    for i in range(300):
        assert p[i] == max([j for j in range(i) if v[j] < v[i]], default=-1)
