import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from roadcut.llm import cgk_decontamination as C


def edits(item, text):
    d = list(range(len(item) + 1))
    best = d[-1]
    for c in text:
        n = [0]
        for i, x in enumerate(item):
            n.append(min(d[i] + (x != c), d[i + 1] + 1, n[i] + 1))
        d = n
        best = min(best, d[-1])
    return best


def test_search():
    rng = random.Random(1)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80)))
        assert C.search(item, text)[0] == edits(item, text)


def test_embedding_falls_into_step():
    rng = random.Random(2)
    t = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(40)]
    u = [x[:50] + "q" + x[50:] for x in t]
    a, b = C.embed(t, 380), C.embed(u, 380)
    other = C.embed(t[1:] + t[:1], 380)
    assert (a == b).mean() > 0.75 > 0.3 > (a == other).mean()


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while nobody looks at it"), (2, "a second item about rivers and mountains in the far north of the land"), (3, "two words"), (4, None), (5, "  ")]
WORDS = [f"filler{i}" for i in range(60)]


def test_find(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(1, f"{fill(30)} {ITEMS[0][1]} {fill(9)}"), (2, fill(50)), (3, None), (4, ""), (5, ITEMS[1][1].upper()), (6, f"{fill(5)} two\n  words {fill(5)}"),
            (7, "the quick brown fox jumped over a lazy dog, while nobody looks at it"), (8, "the quick brown fox went home and slept all day long without a dog"), (1, f"{fill(3)} {ITEMS[0][1]}")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in C.find(docs, bench).collect()}
    assert set(got) == {(1, 1), (5, 2), (6, 3), (7, 1)} and got[1, 1] == 0 and got[5, 2] == 0
    assert got[7, 1] == edits(ITEMS[0][1], rows[6][1])
    kept = C.drop_contaminated(docs, bench).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 4, 8] and kept[0].distance == 9
    assert C.find(docs.limit(0), bench).count() == 0 and C.find(docs, bench.limit(0)).count() == 0
    assert C.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_recall_of_edited_items(spark):
    """Items with one character in twenty changed are found; the same in blocks of one item."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(35)) for _ in range(60)]
    docs = []
    for i, t in enumerate(items):
        c = list(t)
        for _ in range(len(c) // 20):
            c[rng.randrange(len(c))] = "q"
        docs.append((i, " ".join(word() for _ in range(30)) + " " + "".join(c)))
    finder = C._Finder(list(enumerate(items)), 0.8, C.tables_for(0.99, 0.75))
    import pyarrow as pa

    found = {(t, m) for t, m, _, _ in finder(pa.array([t for _, t in docs]))}
    assert len(found & {(i, i) for i in range(60)}) >= 58 and not found - {(i, i) for i in range(60)}
    assert np.isclose(1 - (1 - 0.25**C.SAMPLES) ** C.tables_for(0.99, 0.75), 0.99, atol=0.001)


def test_recall_where_no_two_words_in_a_row_are_whole():
    """Items with a letter changed in every second word, and with an eighth of all letters changed."""
    rng = random.Random(7)
    letters = "abcdefghijklmno"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
    items = [" ".join(word() for _ in range(35)) for _ in range(60)]

    def second(t):
        return " ".join(w[:1] + "z" + w[2:] if i % 2 else w for i, w in enumerate(t.split()))

    def eighth(t):
        return "".join("z" if c != " " and rng.random() < 0.125 else c for c in t)

    finder = C._Finder(list(enumerate(items)), 0.8, C.tables_for(0.99, 0.85))
    for change in (second, eighth):
        changed = [change(t) for t in items]
        near = [i for i, (a, b) in enumerate(zip(items, changed)) if C.search(a, b)[0] <= 0.2 * len(a)]
        docs = [" ".join(word() for _ in range(20)) + " " + changed[i] + " " + word() for i in near]
        found = {(t, m) for t, m, _, _ in finder(pa.array(docs))}
        assert len(near) > 50 and len(found & set(enumerate(near))) >= 0.97 * len(near) and found <= set(enumerate(near))


def test_many_edit_searches_at_once():
    rng = random.Random(9)
    text = lambda low, high: "".join(rng.choice("abcñ€ ") for _ in range(rng.randint(low, high)))
    items = [text(1, n) for n in (3, 64, 65, 130, 400) for _ in range(20)]
    texts = [text(0, 30) + (i[: len(i) // 2] + "x" + i[len(i) // 2 + 2 :] if rng.random() < 0.7 else "") + text(0, 30) for i in items]
    assert C.search_all(items, texts, 7).tolist() == [C.search(i, t)[0] for i, t in zip(items, texts)]
    assert C.search_all([], []).tolist() == []


def test_bounds_of_the_edit_search_lose_nothing():
    rng = random.Random(8)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        most, edits = rng.randint(0, 6), C.search(a, b)[0]
        if edits <= most:
            assert C.could_hold([a[i : i + 3] for i in range(len(a) - 2)], b, most)


def _edited(rng, words, share=1.0):
    """A letter changed in words, as a share of them."""
    out = []
    for w in words:
        if rng.random() < share:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice([c for c in "abcdefghijk" if c != w[i]]) + w[i + 1 :]
        out.append(w)
    return out


def _within(items, texts, similarity=0.8):
    """(text, item), edits of all pairs within the similarity, by search through whole texts."""
    out = {}
    for m, item in enumerate(items):
        item = " ".join(item.split()).lower()
        for t, x in enumerate(texts):
            edits = C.search(item, " ".join(x.split()).lower())[0]
            if item and edits <= int((1 - similarity) * len(item) + 1e-9):
                out[t, m] = edits
    return out


def test_an_item_with_a_letter_changed_in_every_word_is_found(spark):
    rng = random.Random(11)
    syllables = ["the", "on", "tion", "er", "re", "sh", "ble", "and", "ou", "ly", "nt", "est", "in", "ha"]
    said = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    items = [said(rng.choice((9, 14, 25, 40))) for _ in range(30)]
    texts = [" ".join([*said(60), *_edited(rng, w), *said(60)]) for w in items] + [" ".join(said(150)) for _ in range(10)]
    items = [" ".join(w) for w in items]
    want = _within(items, texts)
    assert len(want) >= 25
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.distance for r in C.find(docs, bench).collect()} == want
    left = {r.doc_id for r in C.drop_contaminated(docs, bench).collect()}
    assert left == set(range(len(texts))) - {t for t, _ in want}


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9, 1.0])
def test_nothing_within_the_similarity_is_left_out(similarity):
    rng = random.Random(int(similarity * 100))
    letters = "abcdeñ漢 "
    some = lambda n: " ".join("".join(rng.choice(letters) for _ in range(n)).split())
    items = [some(rng.choice((1, 3, 8, 20, 40, 60, 90, 200, 330))) for _ in range(300)] + ["", "zz " * 20]
    texts = ["", "a", "\n b\t"]
    for _ in range(40):
        x = list(rng.choice(items))
        for _ in range(int(len(x) * (1 - similarity) * rng.random() * 1.1)):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice(([], [rng.choice(letters)], [x[i], rng.choice(letters)])) if x else []
            x = x or ["a"]
        texts.append(some(rng.randrange(300)) + rng.choice((" ", "")) + "".join(x) + some(rng.randrange(300)))
    f = C._Finder(list(enumerate(items)), similarity, C.tables_for(0.99, 0.85))
    assert {(t, m): e for t, m, e, _ in f(pa.array(texts))} == _within(items, texts, similarity)


def test_long_parts_are_searched_few_at_a_time(monkeypatch):
    """What a batch holds is as many letters as its longest part, times its pairs."""
    held, batch = [], C._search_batch
    monkeypatch.setattr(C, "_search_batch", lambda items, texts, n: held.append(len(texts) * max(map(len, texts))) or batch(items, texts, n))
    monkeypatch.setattr(C, "HELD", 4000)
    items, texts = ["abc"] * 60, ["ab" * n + "c" for n in range(30)] + ["ab" * 1500 + "c"] * 30
    assert C.search_all(items, texts).tolist() == [C.search(i, t)[0] for i, t in zip(items, texts)]
    assert max(held) <= 4000


def test_a_worker_keeps_its_distances_between_tasks_in_bounded_memory(monkeypatch):
    """Tasks bring the finder anew; the grams met stay, and start anew beyond KNOWN with the same results."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = [text(rng.randint(60, 120)) for _ in range(30)]
    texts = [text(200) + "".join("z" if rng.random() < 0.1 else c for c in rng.choice(items)) + text(200) for _ in range(20)]
    task = lambda: pickle.loads(pickle.dumps(C._Finder(list(enumerate(items)), 0.8, 40)))
    one, two = task(), task()
    want = sorted(x[:3] for x in one(pa.array(texts)))
    assert len(want) >= 15 and sorted(x[:3] for x in two(pa.array(texts))) == want and two.bound is one.bound
    assert one.bound.rows.nbytes <= C.KNOWN and len(one.bound.keys) > 500
    own, bits, ends, _ = one.bound.groups[0]
    gram = "abcxf"
    key = 0
    for c in gram:
        key = key * C.CLASSES + int(one.bound.of[ord(c)])
    got = one.bound._distances(np.array([key]), bits, ends, len(own))[0, C.ZONES]
    told = [int(got[r // 4]) >> r % 4 * 2 & 3 for r in range(len(own))]
    assert told == [min(C.FAR, C.search(gram, one.items.text[m])[0]) for m in own.tolist()]
    monkeypatch.setattr(C, "KNOWN", 200 * (C.ZONES + 1) * 8)
    C._Finder._made.cache_clear()
    few = task()
    assert sorted((i, *x[1:3]) for i, t in enumerate(texts) for x in few(pa.array([t]))) == want
    assert few.bound.rows.shape[2] < 500
    C._Finder._made.cache_clear()


def test_walks_of_windows_and_items_toss_the_same_coins():
    """However many steps the windows of a batch take, they are compared with the items' first ones."""
    texts = ["the quick brown fox", "a lazy dog"]
    assert (C.embed(texts, 20) == C.embed(texts, 90)[:, :20]).all()
