"""Benchmark decontamination by CGK embeddings and bit-sampling, and an exact way for what they don't propose."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.llm import _io, _seq
from roadcut.llm.chunk_bpe import _slices

U = np.uint64
#: Bytes of benchmark text held at once; a longer benchmark is searched for in blocks of this size.
BLOCK_BYTES = 4 << 20
WALKS, SAMPLES = 8, 3
#: Steps of a walk for each symbol. A pointer moves at every second step; what is written behind the end tells nothing.
LENGTH = 1.9
#: Bytes of two words that suffice to take a window.
LONG = 16
#: A word that fills at most this share of the items' places helps to tell where a window may stand.
TELLING = 1 / 1000
#: Of so many telling words of an item one has to agree, and two at least.
VOTES = 8
#: Windows are taken so many words beside the place that a gram tells: words may have been added or split.
SHIFTS = (-1, 0, 1)
#: Letters of a gram whose distance from an item is looked up; the greatest distance told; letters told apart.
GRAM, FAR, CLASSES = 5, 3, 32
#: Items whose distances stand in one table; bytes of it beyond which it starts anew; stretches of an item, to so many letters.
GROUP, KNOWN, ZONES, STEP = 256, 64 << 20, 4, 4
#: Letters that a batch of searches holds at once.
HELD = 1 << 20
#: Bytes of texts that are searched at once; a letter takes 40 bytes or so meanwhile.
SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tables_for(recall: float, apart: float) -> int:
    """Repetitions of the bit-sampling hash that find a pair with this share of differing embedded symbols, with
    probability ``recall`` at least."""
    each = (1 - apart) ** SAMPLES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - each)))


@lru_cache(4)
def _coins(steps: int) -> np.ndarray:
    """Random bits by walk, step and symbol; the same for a step however many follow."""
    return np.random.default_rng(5).integers(0, 2, (steps, WALKS, 256), dtype=np.int32).transpose(1, 0, 2)


def embed(texts: list[str], steps: int) -> np.ndarray:
    """CGK embeddings (walk, step, text): each step writes the symbol under the pointer and moves on or not, as a coin
    of the step and the symbol says. Texts an edit apart fall into step again, so their embeddings differ in few places.
    Behind its end a text is 0."""
    n = max(map(len, texts), default=0)
    m = np.zeros((len(texts), n + 1), np.uint32)
    for i, t in enumerate(texts):
        m[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    m = ((m ^ (m >> 8)) & 255).astype(np.uint8)
    m[:, -1] = 0
    coins, flat = _coins(steps), m.ravel()
    end = np.arange(len(texts)) * (n + 1) + n
    at = np.tile(end - n, (WALKS, 1))
    out, walk = np.zeros((WALKS, steps, len(texts)), np.uint8), np.arange(WALKS)[:, None] * 256
    for s in range(steps):
        c = flat.take(at)
        out[:, s] = c
        at += coins[:, s].ravel().take(walk + c)
        np.minimum(at, end, out=at)
    return out


def alike(windows: list[str], which: np.ndarray, items: list[str], known: np.ndarray, tables: int, batch: int = 1024) -> np.ndarray:
    """Which window shares a bit-sampling hash of its embedding with its item items[which], whose embeddings are known:
    SAMPLES places of the embedding, drawn anew for each table."""
    out = np.zeros(len(which), bool)
    draw = np.random.default_rng(6).random((WALKS, -(-tables // WALKS), SAMPLES)).astype(np.float32)
    size = np.array([len(t) for t in items], np.int64)[which]
    order = np.argsort(size, kind="stable")
    walk = np.arange(WALKS)[:, None, None]
    for i in range(0, len(order), batch):
        part = order[i : i + batch]
        steps = int(LENGTH * size[part].max(initial=0)) + 1
        same = embed([windows[j] for j in part], steps) == known[:, :steps, which[part]]
        cut = np.flatnonzero(np.r_[True, np.diff(size[part]) > 0])
        for a, b in zip(cut, np.r_[cut[1:], len(part)]):  # windows of one size look at the same places
            place = (draw * np.float32(LENGTH * size[part[a]])).astype(np.int64)
            out[part[a:b]] = same[:, :, a:b][walk, place].all(2).any((0, 1))
    return out


def search(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between the item and any part of the text, and where such a part ends (bit-parallel)."""
    n = len(item)
    if not n:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, (n, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def _plain(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """Hashes of words in lower case and without marks around them."""
    a, b = ws.copy(), we.copy()
    for _ in range(3):
        b -= (b - a > 1) & _MARK[data[b - 1]]
        a += (b - a > 1) & _MARK[data[np.minimum(a, len(data) - 1)]]
    return _seq.spans_hash(_seq.byte_symbols(_LOWER[data]), a, b)


def _grams(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words (h) of one text, and which are valid."""
    return _seq.gram_hash(h, n), of[n - 1 :] == of[: len(of) - n + 1] if len(of) >= n else np.zeros(0, bool)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, and where each begins (one more for the end)."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.r_[0, np.cumsum(size)]


def search_all(items: list[str], texts: list[str], batch: int = 1024) -> np.ndarray:
    """The distances that ``search`` tells for each item and its text, of many pairs at once: 64 letters of the item a word,
    a step for each letter of the longest text. Pairs of like sizes go together. No item may be empty."""
    out = np.zeros(len(items), np.int64)
    words = np.array([-(-len(t) // 64) for t in items], np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    order = np.lexsort((size, np.ceil(np.log2(np.maximum(words, 1)))))
    level = np.ceil(np.log2(np.maximum(words[order], 1)))
    cut = np.flatnonzero(np.r_[True, np.diff(level) > 0]) if len(order) else []
    for a, b in zip(cut, np.r_[cut[1:], len(order)]):
        while a < b:
            part = order[a : min(b, a + batch)]  # sizes rise: no more than fit beside the longest
            part = part[: max(1, int(np.count_nonzero(size[part] * np.arange(1, len(part) + 1) <= HELD)))]
            out[part] = _search_batch([items[j] for j in part], [texts[j] for j in part], int(words[part].max()))
            a += len(part)
    return out


def _search_batch(items: list[str], texts: list[str], n_words: int) -> np.ndarray:
    one, full, top = U(1), ~U(0), U(63)
    codes, start = _codes(items)
    n, row = np.diff(start), np.repeat(np.arange(len(items)), np.diff(start))
    at = np.arange(len(codes)) - start[row]
    key, back = np.unique(row << 21 | codes, return_inverse=True)
    eqs = np.zeros((n_words, len(key) + 1), U)  # bits of each letter of each item; the last column is a letter it hasn't
    np.bitwise_or.at(eqs, (at >> 6, back), one << (at & 63).astype(U))
    codes, start = _codes(texts)
    size = np.diff(start)
    said = np.full((int(size.max(initial=0)), len(items)), len(key), np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    said[np.arange(len(codes)) - start[row], row] = np.where((found := _seq.member(row << 21 | codes, key)) >= 0, found, len(key))
    pv, mv = np.full((n_words, len(items)), full), np.zeros((n_words, len(items)), U)
    score, best = n.copy(), n.copy()
    word, bit, rows = (n - 1) >> 6, ((n - 1) & 63).astype(U), np.arange(len(items))
    ups, downs = np.zeros_like(pv), np.zeros_like(pv)
    for letter in said:
        up, down = U(0), U(0)
        for w in range(n_words):
            eq, p, m = eqs[w][letter], pv[w], mv[w]
            xv = eq | m
            eq = eq | down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            ups[w], downs[w] = ph, mh
            ph2, mh2 = ph << one | up, mh << one | down
            up, down = ph >> top, mh >> top
            pv[w], mv[w] = mh2 | ~(xv | ph2), ph2 & xv
        score = score + (ups[word, rows] >> bit & one).astype(np.int64) - (downs[word, rows] >> bit & one).astype(np.int64)
        best = np.minimum(best, score)
    return best


def could_hold(trigrams: list[str], text: str, most: int) -> bool:
    """False only where no part of the text is within ``most`` edits of the item with these trigrams: an edit breaks three."""
    there = {text[i : i + 3] for i in range(len(text) - 2)}
    return sum(map(there.__contains__, trigrams)) >= len(trigrams) - 3 * most


class _Bound:
    """Where texts may hold an item within its edits, without loss. A text is cut into grams of GRAM letters. Each edit falls into one
    gram at most, so the distances of the grams that a part holds wholly, each to the nearest part of the item, add up to no more
    than the part's own distance. Distances are told up to FAR; rare letters count as one, which only lowers them.
    A part has n - k letters at least, so many consecutive grams are looked at for each item of n letters and k edits. What
    passes is summed up again with the distances from the stretch of the item where each gram can stand: not farther than
    k from its own place."""

    def __init__(self, texts: list[str], most: list[int]):
        n, k = np.array([len(t) for t in texts], np.int64), np.array(most, np.int64)
        span = np.clip((n - k - GRAM + 1) // GRAM, 0, 8000)
        short = FAR * span <= k  # these grams can't tell anything
        self.n, self.most, self.short = n, k, np.flatnonzero(short & (n > 0)).tolist()
        codes, start = _codes(texts)
        letter, times = np.unique(codes, return_counts=True)
        self.of = np.zeros(0x110000, np.uint8)
        self.of[letter] = CLASSES - 1
        self.of[letter[np.argsort(-times, kind="stable")[: CLASSES - 2]]] = np.arange(1, min(len(letter), CLASSES - 2) + 1)
        rest = np.flatnonzero(~short)
        rest = rest[np.argsort(n[rest], kind="stable")]
        self.groups = []
        for i in range(0, len(rest), GROUP):
            own = rest[i : i + GROUP]
            bits = np.zeros(((int(n[own].max()) // STEP + 1) * STEP - 1, -(-len(own) // 64), CLASSES), U)
            for r, m in enumerate(own.tolist()):
                c = self.of[codes[start[m] : start[m + 1]]]
                bits[np.arange(len(c)), r >> 6, c] |= U(1 << (r & 63))
            cut = np.flatnonzero(np.r_[True, np.diff(span[own]) > 0]).tolist()  # items that look at as many grams
            parts = [(a, b, int(span[own[a]])) for a, b in zip(cut, [*cut[1:], len(own)])]
            ends = np.zeros((ZONES, len(bits) + 1, bits.shape[1], 1), U)  # places where a gram of a stretch can end
            for r, m in enumerate(own.tolist()):
                steps = next(p[2] for p in parts if r < p[1])
                for z in range(ZONES):
                    a, b = GRAM * (steps * z // ZONES + 1) - k[m], GRAM * (steps * (z + 1) // ZONES + 1) - 1 + k[m]
                    ends[z, max(a, 0) : b + 1, r >> 6] |= U(1 << (r & 63))
            ends = np.bitwise_or.reduce(ends.reshape(ZONES, -1, STEP, *ends.shape[2:]), axis=2)
            self.groups.append((own, bits, ends, parts))
        self.forget()

    def forget(self) -> None:
        """No gram is known: keys (rising), and of each its row."""
        self.keys, self.at, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def _distances(self, keys: np.ndarray, bits: np.ndarray, ends: np.ndarray, items: int) -> np.ndarray:
        """Of each gram (rising) the least distance from any part of each item, FAR at most: the places of the items where parts end that
        are within 0, 1 and so on edits of the gram's beginning, a bit for each item; grams that begin alike share these. Of the whole
        item (the last row), and by how much that of a stretch is greater; four items a byte."""
        out = np.zeros((len(keys), ZONES + 1, -(-items // 4) * 4), np.uint8)
        each = max(1, (1 << 16) // bits[..., 0].size)
        for i in range(0, len(keys), each):
            part, was = keys[i : i + each], np.zeros(1, np.int64)
            near = [np.full((bits.shape[0] + 1, bits.shape[1], 1), ~U(0))] * FAR
            for g in range(GRAM - 1, -1, -1):
                begin = np.unique(part // CLASSES**g)
                if len(begin) > len(was):
                    near = [r.take(np.searchsorted(was, begin // CLASSES), 2) for r in near]
                said, was = bits.take(begin % CLASSES, 2), begin
                new = [np.zeros_like(near[0])]
                np.bitwise_and(near[0][:-1], said, out=new[0][1:])
                for less, now in zip(near, near[1:]):
                    more = less.copy()  # the gram has a letter more
                    step = now[:-1] & said
                    step |= less[:-1]  # another letter
                    step |= new[-1][:-1]  # the item has a letter more
                    more[1:] |= step
                    new.append(more)
                near = new
            for r in near:
                r = np.bitwise_or.reduce(r.reshape(-1, STEP, *r.shape[1:]), axis=1)
                for z in range(ZONES + 1):
                    met = np.bitwise_or.reduce(r & ends[z] if z < ZONES else r, axis=0).T.copy().view(np.uint8)
                    out[i : i + each, z, :items] += 1 - np.unpackbits(met, axis=1, count=items, bitorder="little")
        out[:, :ZONES] -= out[:, ZONES:]
        return np.bitwise_or.reduce(out.reshape(*out.shape[:2], -1, 4) << np.arange(0, 8, 2, dtype=np.uint8), axis=3)

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to): parts that hold whatever is within the item's edits, in order; short items get whole texts."""
        out = [(t, m, 0, len(x)) for m in self.short for t, x in enumerate(texts) if len(x) >= self.n[m] - self.most[m]]
        codes, start = _codes(texts)
        count = -(-np.diff(start) // GRAM)
        first = np.r_[0, np.cumsum(count)]
        said = np.zeros(int(first[-1]) * GRAM, np.uint8)
        said[np.arange(len(codes)) + np.repeat(first[:-1] * GRAM - start[:-1], np.diff(start))] = self.of[codes]
        keys = np.zeros(int(first[-1]), np.int64)
        for g in range(GRAM):
            keys = keys * CLASSES + said[g::GRAM]
        of = np.repeat(np.arange(len(texts)), count)
        keys, back = np.unique(keys, return_inverse=True)
        for own, bits, ends, parts in self.groups:
            new = keys[_seq.member(keys, self.keys) < 0]
            if len(self.groups) > 1 or self.rows is not None and len(self.keys) + len(new) > self.rows.shape[2]:
                self.forget()
                new = keys
            if self.rows is None:  # pages that nothing was written to take no memory
                width = -(-len(own) // 4)
                self.rows = np.empty((ZONES + 1, width, max(len(new), KNOWN // (ZONES + 1) // width)), np.uint8)
            if len(new):
                end = len(self.keys) + len(new)
                self.rows[..., len(self.keys) : end] = self._distances(new, bits, ends, len(own)).transpose(1, 2, 0)
                met, at = np.r_[self.keys, new], np.r_[self.at, np.arange(len(self.keys), end)]
                order = np.argsort(met, kind="stable")
                self.keys, self.at = met[order], at[order]
            out += self._parts(self.at[_seq.member(keys, self.keys)][back], of, first, own, parts)
        return sorted(out)

    def _summed(self, z: int, row: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Sums of the distances of stretch z of these items, from the first of some grams (row) up to each."""
        out = np.zeros((len(items), len(row) + 1), np.uint16)
        said = self.rows[z].take(row, 1)[items >> 2] >> ((items & 3) * 2).astype(np.uint8)[:, None] & np.uint8(3)
        np.cumsum(said, 1, np.uint16, out=out[:, 1:])
        return out

    def _parts(self, row: np.ndarray, of: np.ndarray, first: np.ndarray, own: np.ndarray, parts: list[tuple]) -> list[tuple]:
        longest, hits = max(p[2] for p in parts), []
        each, most = max(1 << 13, 4 * longest), np.minimum(self.most[own], 65535).astype(np.uint16)
        for i in range(0, len(of), each):
            end = min(len(of), i + each + longest - 1)
            far, found = self._summed(ZONES, row[i:end], np.arange(len(own))), [np.zeros((4, 0), np.int64)]
            for a, b, span in parts:
                if far.shape[1] > span:
                    sums = far[a:b, span : span + each] - far[a:b, :-span][:, :each]
                    item, at = np.nonzero(sums <= most[a:b, None])
                    found.append(np.stack([item + a, at, np.full(len(item), span), most[item + a] - sums[item, at].astype(np.int64)]))
            found = np.concatenate(found, 1)
            found = found[:, of[i + found[1]] == of[i + found[1] + found[2] - 1]]
            for z in range(ZONES):
                item, at, span, left = found
                there = np.bincount(item, minlength=len(own)) > 0
                far, nth = self._summed(z, row[i:end], np.flatnonzero(there)), (np.cumsum(there) - 1)[item]
                left -= far[nth, at + span * (z + 1) // ZONES] - far[nth, at + span * z // ZONES]
                found = found[:, left >= 0]
            item, at, span, _ = found
            hits.append(np.stack([of[i + at], own[item], i + at, span]))
        t, m, at, span = np.concatenate([np.zeros((4, 0), np.int64), *hits], 1)
        begin, reach = (at - first[t]) * GRAM, self.n[m] + self.most[m]
        order = np.lexsort((begin, m, t))
        t, m, a, b = (v[order] for v in (t, m, np.maximum(begin + span * GRAM - reach, 0), begin + reach))
        new = np.r_[len(t) > 0, (t[1:] != t[:-1]) | (m[1:] != m[:-1]) | (a[1:] > b[:-1])] if len(t) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        lasts = np.r_[begins[1:], len(t)] - 1 if len(t) else begins
        return list(zip(*(v.tolist() for v in (t[begins], m[begins], a[begins], b[lasts]))))


class _Places:
    """Where in the items each of some grams stands (item, place), by its hash."""

    def __init__(self, g: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = at[np.argsort(g[at], kind="stable")]
        key = g[order]
        self.start = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
        self.key, self.size = key[self.start], np.diff(np.r_[self.start, len(key)])
        self.item, self.place = item[order], place[order]
        self.filled = np.zeros(1 << 20, bool)
        self.filled[key & U((1 << 20) - 1)] = True

    def __call__(self, g: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """at, item, first: for each valid gram of a text that stands in an item, where the item would begin."""
        at = np.flatnonzero(self.filled[g & U((1 << 20) - 1)] & ok)
        k = _seq.member(g[at], self.key)
        at, k = at[k >= 0], k[k >= 0]
        entry = _seq.gather(self.start[k], self.size[k])
        at = np.repeat(at, self.size[k])
        return at, self.item[entry], at - self.place[entry]


class Items:
    """A block of benchmark items with the word grams that stand in them."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.text, self.words = ids, [], []
        data, off = _io.text_bytes(pa.array(texts, pa.string()))
        ws, we, of = _seq.words(data, off)
        count = np.bincount(of, minlength=len(texts))
        self.text = [" ".join(data[a:b].tobytes().decode() for a, b in zip(ws[s : s + c], we[s : s + c])).lower() for s, c in zip((np.cumsum(count) - count).tolist(), count.tolist())]
        self.count, first = count, np.cumsum(count) - count
        self.embedded = embed(self.text, int(LENGTH * max(map(len, self.text), default=0)) + 1)
        self.trigrams = [[t[i : i + 3] for i in range(len(t) - 2)] for t in self.text]
        h, place = _plain(data, ws, we), np.arange(len(of)) - first[of]
        self.grams = {}
        for n in (1, 2, 3):
            g, ok = _grams(h, of, n)
            alone = np.minimum(count[of[: len(g)]], 3) == n  # items of one or two words are sought by these alone
            ok &= alone | (n == 2) & (we[n - 1 :] - ws[: len(g)] >= LONG)
            if ok.any():
                self.grams[n] = _Places(g, np.flatnonzero(ok), of, place)
        _, back, size = np.unique(h, return_inverse=True, return_counts=True)
        telling = size[back] <= max(1, TELLING * len(h))
        self.telling = _Places(h, np.flatnonzero(telling), of, place) if len(h) else None
        self.votes = np.maximum(2, np.bincount(of[telling], minlength=len(texts)) // VOTES)

    def candidates(self, data, ws, we, of) -> np.ndarray:
        """(text, item, first word) of every item-sized window that shares a word gram, in its place, with the item, or a share
        of its telling words, two at least, in their places but for as many words as are added or split between them."""
        out, h = [np.zeros((0, 3), np.int64)], _plain(data, ws, we)
        for n, places in self.grams.items():
            at, item, begin = places(*_grams(h, of, n))
            for shift in SHIFTS:
                out.append(np.stack([of[at], item, begin + shift], 1))
        if self.telling is not None:
            at, item, begin = self.telling(h, np.ones(len(h), bool))
            order = np.lexsort((begin, item, of[at]))
            rows, place = np.stack([of[at], item, begin], 1)[order], (at - begin)[order]
            for need in np.unique(self.votes[rows[:, 1]]).tolist():
                r, q = rows[mine := self.votes[rows[:, 1]] == need], place[mine]
                new = np.r_[True, (np.diff(q) != 0) | (np.diff(r[:, :2], axis=0) != 0).any(1)]  # one word again and again counts once
                r = r[new]
                a, b = r[: len(r) - need + 1], r[need - 1 :]
                near = (a[:, :2] == b[:, :2]).all(1) & (b[:, 2] - a[:, 2] < need)
                out.append(b[near])
        return np.unique(np.concatenate(out), axis=0)


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, apart: float = 0.85) -> DataFrame:
    """Documents that hold an item, or a text with 1 - distance / length >= ``similarity`` of it: a row for each doc_id
    and item_id, with distance (edits) and first_word (of the window). Compared in lower case with single spaces.

    Windows of an item's number of words are taken where a gram of three words, or of two long ones (all, of shorter
    items) agrees with the item's, or an eighth of its words that are rare among the
    items do, two at least. Window and item are embedded by CGK random walks and compared by repeated bit-sampling; ``recall`` sets the
    repetitions for pairs whose embeddings differ in a share ``apart``. What agrees is verified by exact edit distance
    to the best part of the window and its surroundings. What the embeddings don't propose is sought for behind them in an
    exact way (_Bound): all parts of all texts that a lower bound of the distance doesn't rule out are searched, so no text
    within the similarity is left out, and distance is the least one.

    Items without words are not found. Null texts are empty. Rows with one doc_id are reported together; repeated items
    under their ids each. Empty tables give no rows. The benchmark is read in blocks of bounded size.
    """
    d = _io.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for block in _blocks(benchmark):
        part = d.mapInArrow(_reporter(block, similarity, tables_for(recall, apart)), "doc_id long, item_id long, distance int, first_word int")
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("distance", "first_word")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.distance", "best.first_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, apart: float = 0.85) -> DataFrame:
    """The rows of docs in which ``find`` finds no item, with all their columns; each text decides for itself, so nothing
    is shuffled. Null texts stay."""
    docs = _io.small_batches(docs)
    for block in _blocks(benchmark):
        finder = _Finder(block, similarity, tables_for(recall, apart))

        def run(batches, finder=finder):
            for batch in batches:
                bad = {r[0] for r in finder(batch.column("text"))}
                keep = np.ones(batch.num_rows, bool)
                keep[list(bad)] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """Items in blocks of bounded size, in a fixed order."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").orderBy("item_id", "text")
    blocks, held, size = [], [], 0
    for r in items.toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text.encode())
        if size > BLOCK_BYTES:
            blocks.append(held)
            held, size = [], 0
    return [*blocks, held]


class _Finder:
    """Of a batch of texts: (text, item, edits, first word) for each text and item that agree."""

    def __init__(self, block: list[tuple], similarity: float, tables: int):
        self.block, self.similarity, self.tables = block, similarity, tables

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("items", "bound")}

    @staticmethod
    @lru_cache(1)
    def _made(block: tuple, similarity: float) -> tuple[Items, _Bound]:
        """Kept by a worker from task to task, with the grams met so far."""
        items = Items([i for i, _ in block], [t for _, t in block])
        return items, _Bound(items.text, [int((1 - similarity) * len(t) + 1e-9) for t in items.text])

    def __call__(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        if "items" not in self.__dict__:
            self.items, self.bound = self._made(tuple(self.block), self.similarity)
        data, off = _io.text_bytes(texts)
        return [(i + t, m, e, s) for i, j in _slices(off, SLICE) for t, m, e, s in self._slice(data[off[i] : off[j]], off[i : j + 1] - off[i])]

    def _most(self, item: str) -> int:
        return int((1 - self.similarity) * len(item) + 1e-9)

    def _rest(self, data: np.ndarray, off: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds to best what the embeddings haven't proposed, and lesser distances: all parts that _Bound can't rule out."""
        items, tried = self.items, []
        texts = [b" ".join(data[a:b].tobytes().split()).decode().lower() for a, b in zip(off[:-1], off[1:])]
        for t, m, a, b in self.bound(texts):
            if best.get((t, m), (1,))[0] and could_hold(items.trigrams[m], texts[t][a:b], self._most(items.text[m])):
                tried.append((t, m, a, texts[t][a:b]))
        for (t, m, a, text), edits in zip(tried, search_all([items.text[x[1]] for x in tried], [x[3] for x in tried]).tolist()):
            if edits <= self._most(items.text[m]) and ((t, m) not in best or edits < best[t, m][0]):
                begin = max(0, search(items.text[m], text)[1] - len(items.text[m]))
                best[t, m] = (edits, texts[t].count(" ", 0, a + begin))

    def _slice(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        items = self.items
        ws, we, of = _seq.words(data, off)
        if not len(ws) or not any(items.text):
            return []
        c = items.candidates(data, ws, we, of)
        count = np.bincount(of, minlength=len(off) - 1)
        first = np.cumsum(count) - count

        def said(text: int, a: int, b: int) -> str:
            a, b = first[text] + max(a, 0), first[text] + min(b, count[text])
            return b" ".join(data[ws[a] : we[b - 1]].tobytes().split()).decode().lower() if a < b else ""

        at = c[:, 2] - first[c[:, 0]]
        rows = list(zip(c[:, 0].tolist(), c[:, 1].tolist(), at.tolist(), items.count[c[:, 1]].tolist()))
        windows = [said(t, s, s + k + 2)[: len(items.text[m])] for t, m, s, k in rows]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        searched: dict[tuple[int, int], int] = {}  # candidates come in order of text, item and place
        tried = []
        for p in np.flatnonzero(alike(windows, c[:, 1], items.text, items.embedded, self.tables)).tolist():
            t, m, s, k = rows[p]
            slack, item = k // 5 + 2, items.text[m]
            if (t, m) in best or (t, m) in searched and s - searched[t, m] <= slack // 2:
                continue
            searched[t, m] = s
            text = said(t, s - slack, s + k + slack)
            if item in text:
                best[t, m] = (0, max(s, 0))
            elif could_hold(items.trigrams[m], text, most := self._most(item)):
                tried.append((t, m, s, text, most))
        tried = [x for x in tried if x[:2] not in best]
        for (t, m, s, _, most), edits in zip(tried, search_all([items.text[x[1]] for x in tried], [x[3] for x in tried]).tolist()):
            if edits <= most and ((t, m) not in best or edits < best[t, m][0]):
                best[t, m] = (edits, max(s, 0))
        self._rest(data, off, best)
        return [(t, m, *v) for (t, m), v in best.items()]


def _reporter(block: list[tuple], similarity: float, tables: int):
    finder = _Finder(block, similarity, tables)

    def run(batches):
        for batch in batches:
            rows = finder(batch.column("text"))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in rows])), pa.array([block[r[1]][0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=["doc_id", "item_id", "distance", "first_word"])

    return run


def op5_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(_io.table(spark, sf_dir, "documents"), _io.table(spark, sf_dir, "benchmark"))
