"""Exchange of repeated windows between documents, shared by the two substring-dedup operators.

A window is L consecutive symbols (words or bytes) of one document. No step gathers a group that grows without bound:

1. Anchors. Closed syncmers are chosen by content alone, so both copies of a repeated window hold the same ones. Each
   home (a few MB of documents) sends every distinct anchor once, packed by hash bucket; the bucket answers which occur
   twice or more. A window can repeat only if all its anchors do; nothing is lost by dropping the others. Whole
   documents are compared in the same way: of equal ones only the first goes on, the others are covered by it.
2. Segments. A run of the remaining windows with one routing minimizer is announced to the shard of that minimizer, where
   equal windows meet. Equal segments are copies of the first of them. Where a minimizer has different segments, the
   symbols of one of each are sent for, and the shard's index (``solve``) answers which of their windows are repeats.
   Windows that hold an anchor found in many homes (a passage that a large part of the corpus shares) don't go to a
   shard: each home reduces them to one entry per distinct window, and buckets by window hash merge the entries.
3. Answers return to the homes as runs of window starts, and each document's covered symbols are removed.

Words and windows are compared by 64-bit hashes (a false match of two windows has a chance of about n^2 / 2^64).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.llm import _io, _seq

U = np.uint64
#: An anchor of so many homes is hot.
HOT_HOMES = 48
HOME_BYTES, BUCKET_BYTES, SHARD_BYTES = 3 << 19, 4 << 20, 4 << 20


@dataclass(frozen=True)
class Spec:
    """unit: ``words`` or ``bytes``; length: symbols of a window; k, s: anchors; m: routing minimizer; earlier: a window
    is a repeat only if an equal one starts earlier (smaller doc_id, or same document), else if one starts anywhere."""

    unit: str
    length: int
    k: int
    s: int
    m: int
    earlier: bool

    def __post_init__(self) -> None:
        if not (0 < self.s < self.k <= self.length and self.k - self.s <= self.length - self.k + 1 and 0 < self.m <= self.length):
            raise ValueError("each window must hold an anchor")


#: Announcement of a segment, and the answer that sends for its symbols; a whole document.
SEG = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("ord", "<i4"), ("at", "<i4"), ("n", "<i4")])
ASK = np.dtype([("shard", "<i4"), ("ord", "<i4"), ("at", "<i4"), ("n", "<i4")])
WHOLE = np.dtype([("hash", "<u8"), ("doc", "<i8")])
#: Of a segment in a shard: its home, document's number in the home, doc_id, first symbol, symbols.
HEAD = np.dtype([("home", "<i4"), ("ord", "<i4"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])
HIT = np.dtype([("ord", "<i4"), ("first", "<i4"), ("last", "<i4")])
SEEN = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("many", "<i4")])


class Texts:
    """Symbols of a home's documents, in the order (place, text): place is the doc_id, or for rows without one a number of
    the text's below all ids."""

    def __init__(self, spec: Spec, t: pa.Table):
        self.spec = spec
        t = t.sort_by([("place", "ascending"), ("text", "ascending")])
        self.ids, self.doc = t["doc_id"].combine_chunks(), _io.longs(t["place"])
        self.data, self.off = _io.text_bytes(t["text"])
        self._symbols()

    @classmethod
    def again(cls, spec: Spec, t: pa.Table) -> tuple[Texts, np.ndarray]:
        """From documents that were kept with their numbers."""
        t, x = t.sort_by("ord"), cls.__new__(cls)
        x.spec, x.ids, x.doc = spec, t["doc_id"].combine_chunks(), _io.longs(t["n_symbols"])
        x.data, x.off = _io.text_bytes(t["body"])
        x._symbols()
        return x, t["ord"].to_numpy()

    def _symbols(self) -> None:
        if self.spec.unit == "words":
            self.ws, self.we, of = _seq.words(self.data, self.off)
            self.h = _seq.word_symbols(self.data, self.ws, self.we)
            self.n = np.bincount(of, minlength=len(self.doc))
        else:
            self.h, self.n = _seq.byte_symbols(self.data), np.diff(self.off)
        self.first = np.cumsum(self.n) - self.n
        self.left = _seq.room(self.n)

    def same_document(self) -> np.ndarray:
        """For each row the first row with its doc_id: rows that repeat a doc_id count as one document."""
        new = np.ones(len(self.doc), bool)
        new[1:] = self.doc[1:] != self.doc[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(self.doc)), 0))

    def whole(self) -> np.ndarray:
        """Hash of each document."""
        return _seq.spans_hash(self.h, self.first, self.first + self.n)

    def digest(self, i: int, covered: np.ndarray | None) -> str:
        """sha256 of what is kept of document i."""
        a, b = int(self.first[i]), int(self.first[i] + self.n[i])
        if self.spec.unit == "bytes":
            d = self.data[self.off[i] : self.off[i + 1]]
            return hashlib.sha256(d if covered is None else d[~covered]).hexdigest()
        kept = np.arange(a, b) if covered is None else a + np.flatnonzero(~covered)
        if not len(kept):
            return hashlib.sha256(b"").hexdigest()
        # each kept word and one byte behind it: the byte that follows is white space or of the next text; it becomes a space
        length = self.we[kept] - self.ws[kept] + 1
        at = _seq.gather(self.ws[kept], length)
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[np.cumsum(length) - 1] = 32
        return hashlib.sha256(out[:-1]).hexdigest()


def _packed(bucket: np.ndarray, count: int, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    b, v = bucket[order], values[order]
    cut = np.searchsorted(b, np.arange(count + 1))
    for i in np.flatnonzero(np.diff(cut)):
        yield int(i), v[cut[i] : cut[i + 1]].tobytes()


def _anchors(spec: Spec, buckets: int) -> Callable:
    def run(key, t):
        x = Texts(spec, t)
        _, g = _seq.syncmers(x.h, x.left, spec.k, spec.s)
        g &= ~U(1)
        g, n = np.unique(g, return_counts=True)
        rows = list(_packed(((g >> U(20)) % U(buckets)).astype(np.int64), buckets, g | (n > 1)))
        split = len(rows)
        long = np.flatnonzero(x.n >= spec.length)
        whole = np.zeros(len(long), WHOLE)
        whole["hash"], whole["doc"] = x.whole()[long], x.doc[long]
        rows += _packed(((whole["hash"] >> U(20)) % U(buckets)).astype(np.int64), buckets, whole)
        return pa.table({"kind": pa.array([1] * split + [2] * (len(rows) - split), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "home": pa.array([key[0].as_py()] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _common(key, t):
    """Of a bucket, for each home: its anchors that occur twice or more (the lowest bit marks hot ones), and its
    documents that have equals, with the first one's doc_id."""
    homes, kind = t["home"].to_numpy(), key[0].as_py()
    parts = [np.frombuffer(b, "<u8" if kind == 1 else WHOLE) for b in t["blob"].to_pylist()]
    v = np.concatenate(parts)
    home = np.repeat(homes, [len(p) for p in parts])
    if kind == 1:
        h, many = v & ~U(1), (v & U(1)).astype(np.int64)
        order = np.argsort(h)
    else:
        h, many = v["hash"], np.zeros(len(v), np.int64)
        order = np.lexsort((v["doc"], h))
    hs, hm, many = h[order], home[order], many[order]
    start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    count = np.diff(np.r_[start, len(hs)])
    keep = np.repeat((count > 1) | (np.add.reduceat(many, start) > 0), count)
    out = hs | np.repeat(count >= HOT_HOMES, count) if kind == 1 else v[order][np.repeat(start, count)]
    return _returned(hm[keep], out[keep], kind)


_BACK = "kind int, home int, body binary"
_MID = "kind int, home int, key long, ord int, doc_id long, n_symbols long, n_removed long, n_spans long, kept_sha256 string, body binary"


def _mid(kind: int, n: int, **c) -> pa.Table:
    types = {"kind": pa.int32(), "home": pa.int32(), "key": pa.int64(), "ord": pa.int32(), "doc_id": pa.int64(), "n_symbols": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "body": pa.binary()}
    c["kind"] = np.full(n, kind, np.int32)
    return pa.table({k: (pa.nulls(n, v) if k not in c else pa.array(c[k], v)) for k, v in types.items()})


def _segments(spec: Spec, shards: int) -> Callable:
    """Documents without a possible repeat are done (kind 0); others are kept (1), and their windows go out (2, hot 3)."""

    def run(key, t, known):
        home, x, L = int(key[0].as_py()), Texts(spec, t), spec.length
        got = list(zip(known["kind"].to_pylist(), known["body"].to_pylist()))
        table = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(b, "<u8") for k, b in got if k == 1)])
        equal = np.unique(np.concatenate([np.zeros(0, WHOLE), *(np.frombuffer(b, WHOLE) for k, b in got if k == 2)]))
        whole = x.whole()
        at = _seq.member(whole, equal["hash"])
        copy = (at >= 0) & (x.n >= L)
        lead = copy & (x.doc == equal["doc"][at]) if len(equal) else copy
        first = np.flatnonzero(lead)
        lead[np.setdiff1d(first, first[np.unique(whole[first], return_index=True)[1]])] = False
        copy &= ~lead
        table.sort()
        at, g = _seq.syncmers(x.h, x.left, spec.k, spec.s)
        hit = _seq.member(g & ~U(1), table & ~U(1))
        n = max(len(x.h) - L + 1, 0)
        odd, hot = np.zeros(len(x.h) + 1, np.int64), np.zeros(len(x.h) + 1, np.int64)
        odd[at + 1], hot[at + 1] = hit < 0, (hit >= 0) & (table[hit] & U(1) > 0) if len(table) else False
        span, odd, hot = L - spec.k + 1, np.cumsum(odd), np.cumsum(hot)
        of = np.repeat(np.arange(len(x.doc)), x.n)
        may = (odd[span : span + n] == odd[:n]) & (x.left[:n] >= L) & ~copy[of[:n]]
        hot = may & (hot[span : span + n] > hot[:n])
        live = np.zeros(len(x.doc), bool)
        live[of[:n][may]] = True
        out, rest = [], np.flatnonzero(~live)
        gone, none = copy[rest], hashlib.sha256(b"").hexdigest()
        out.append(_mid(0, len(rest), home=np.full(len(rest), home), doc_id=x.ids.take(pa.array(rest)), n_symbols=x.n[rest], n_removed=np.where(gone, x.n[rest], 0), n_spans=gone.astype(np.int64), kept_sha256=[none if g else x.digest(i, None) for i, g in zip(rest, gone)]))
        rest = np.flatnonzero(live)
        data = x.data.tobytes() if len(rest) else b""
        out.append(_mid(1, len(rest), home=np.full(len(rest), home), ord=rest, key=lead[rest].astype(np.int64), doc_id=x.ids.take(pa.array(rest)), n_symbols=x.doc[rest], body=[data[x.off[i] : x.off[i + 1]] for i in rest]))
        if (cold := may & ~hot).any():
            # 40 bits of hash and 24 of place: of equal minimizers in a window the first; a segment holds one occurrence
            gram = _seq.gram_hash(x.h, spec.m)
            gram = ((gram ^ U(0x5BD1E995C6A4A793)) & ~U(0xFFFFFF)) | (np.arange(len(gram), dtype=U) & U(0xFFFFFF))
            least = _seq.sliding_min(gram, L - spec.m + 1)[:n]
            cut = np.zeros(n, bool)
            cut[1:] = (least[1:] != least[:-1]) | (of[1:n] != of[: n - 1])
            a, b = _seq.runs(cold, cut)
            seg = np.zeros(len(a), SEG)
            seg["key"], seg["hash"], seg["doc"], seg["ord"] = least[a] >> U(24), _seq.spans_hash(x.h, a, b + L), x.doc[of[a]], of[a]
            seg["at"], seg["n"] = a - x.first[of[a]], b - a + L
            rows = list(_packed((_seq.mix(seg["key"].copy()) % U(shards)).astype(np.int64), shards, seg))
            out.append(_mid(2, len(rows), home=np.full(len(rows), home), key=[r[0] for r in rows], body=[r[1] for r in rows]))
        if hot.any():
            w = np.flatnonzero(hot)
            g = _seq.spans_hash(x.h, w, w + L)
            u, i, c = np.unique(g, return_index=True, return_counts=True)  # w rises, so the index is of the earliest
            seen = np.zeros(len(u), SEEN)
            seen["hash"], seen["doc"], seen["many"] = u, x.doc[of[w[i]]], c > 1
            seen["at"] = w[i] - x.first[of[w[i]]]
            rows = list(_packed(((u >> U(20)) % U(shards)).astype(np.int64), shards, seen))
            out.append(_mid(3, len(rows), home=np.full(len(rows), home), key=[r[0] for r in rows], body=[r[1] for r in rows]))
        return pa.concat_tables(out)

    return run


def _returned(homes: np.ndarray, rows: np.ndarray, kind: int) -> pa.Table:
    order = np.argsort(homes, kind="stable")
    homes, rows = homes[order], rows[order]
    u, at = np.unique(homes, return_index=True)
    cut = np.r_[at, len(homes)]
    return pa.table({"kind": pa.array(np.full(len(u), kind), pa.int32()), "home": pa.array(u, pa.int32()), "body": pa.array([rows[cut[i] : cut[i + 1]].tobytes() for i in range(len(u))], pa.binary())})


def _announced(spec: Spec) -> Callable:
    """A shard's announcements. Equal segments are hits (kind 1), the first aside if it stays; where the segments of a
    minimizer differ, the symbols of the first of each equal ones are sent for (kind 4)."""

    def run(key, t):
        parts = [np.frombuffer(b, SEG) for b in t["body"].to_pylist()]
        v, home = np.concatenate(parts), np.repeat(t["home"].to_numpy(), [len(p) for p in parts])
        order = np.lexsort((v["at"], v["ord"], home, v["doc"], v["hash"], v["key"]))
        v, home = v[order], home[order]
        new = np.r_[True, v["key"][1:] != v["key"][:-1]]
        start = np.flatnonzero(new)
        mixed = np.zeros(len(v), np.int64)
        mixed[1:] = (v["hash"][1:] != v["hash"][:-1]) & ~new[1:]
        first = new | (mixed > 0)  # of equal segments
        mixed = np.repeat(np.add.reduceat(mixed, start) > 0, np.diff(np.r_[start, len(v)])) & first
        on = ~first
        if not spec.earlier:
            on[:-1] |= ~first[1:]
        hits = np.zeros(int(on.sum()), HIT)
        hits["ord"], hits["first"], hits["last"] = v["ord"][on], v["at"][on], v["at"][on] + v["n"][on] - spec.length
        asks = np.zeros(int(mixed.sum()), ASK)
        asks["shard"] = key[0].as_py()
        for name in ("ord", "at", "n"):
            asks[name] = v[name][mixed]
        return pa.concat_tables([_returned(home[on], hits, 1), _returned(home[mixed], asks, 4)])

    return run


def _bodies(spec: Spec) -> Callable:
    """A home sends the symbols that shards have asked for."""

    def run(key, t, asked):
        names, types = ["key", "home", "body"], [pa.int64(), pa.int32(), pa.binary()]
        if not len(t) or not len(asked):
            return pa.table([pa.array([], x) for x in types], names=names)
        x, ords = Texts.again(spec, t)
        ask = np.concatenate([np.frombuffer(b, ASK) for b in asked["body"].to_pylist()])
        ask = ask[np.argsort(ask["shard"], kind="stable")]
        doc = np.searchsorted(ords, ask["ord"])
        head = np.zeros(len(ask), HEAD)
        head["home"], head["doc"] = key[0].as_py(), x.doc[doc]
        for name in ("ord", "at", "n"):
            head[name] = ask[name]
        length = ask["n"].astype(np.int64)
        at = _seq.gather(x.first[doc] + ask["at"], length)
        body = x.h[at] if spec.unit == "words" else x.data[at]
        ends, (u, cut) = np.r_[0, np.cumsum(length)], np.unique(ask["shard"], return_index=True)
        cut = np.r_[cut, len(ask)]
        blobs = [np.int64(q - p).tobytes() + head[p:q].tobytes() + body[ends[p] : ends[q]].tobytes() for p, q in zip(cut[:-1], cut[1:])]
        return pa.table([pa.array(u, types[0]), pa.array(np.full(len(u), head["home"][0]), types[1]), pa.array(blobs, types[2])], names=names)

    return run


def _answers(spec: Spec, solve: Callable) -> Callable:
    """A shard's segments through its index."""

    def run(key, t):
        heads, bodies = [], []
        for b in t["body"].to_pylist():
            n = int(np.frombuffer(b, "<i8", 1)[0])
            heads.append(np.frombuffer(b, HEAD, n, 8))
            bodies.append(np.frombuffer(b, U if spec.unit == "words" else np.uint8, -1, 8 + n * HEAD.itemsize))
        head, body = np.concatenate(heads), np.concatenate(bodies)
        start = np.cumsum(head["n"], dtype=np.int64) - head["n"]
        order = np.lexsort((head["at"], head["ord"], head["home"], head["doc"]))
        head, start = head[order], start[order]
        # equal segments stand in the index once, as the earliest, with the number of their occurrences
        sym = _seq.mix(body + U(1)) if spec.unit == "words" else _seq.byte_symbols(body)
        same, first, inv, count = np.unique(_seq.spans_hash(sym, start, start + head["n"]), return_index=True, return_inverse=True, return_counts=True)
        keep = np.sort(first)
        slot = np.searchsorted(keep, first)[inv]  # of each segment: its representative among those kept
        weight = np.zeros(len(keep), np.int64)
        weight[slot[first]] = count
        length = head["n"][keep].astype(np.int64)
        hit = solve(body[_seq.gather(start[keep], length)], length, weight)  # one truth value for each window of each kept segment
        windows = length - spec.length + 1
        base = np.cumsum(windows) - windows
        wide = windows[slot]
        on = hit[_seq.gather(base[slot], wide)]
        if spec.earlier:  # what equals an earlier segment is a repeat as a whole
            later = np.ones(len(head), bool)
            later[keep] = False
            on |= np.repeat(later, wide)
        cut = np.zeros(len(on), bool)
        cut[np.cumsum(wide) - wide] = True
        a, b = _seq.runs(on, cut)
        seg = np.searchsorted(np.cumsum(wide), a, "right")
        hits = np.zeros(len(a), HIT)
        shift = head["at"][seg] - (np.cumsum(wide) - wide)[seg]
        hits["ord"], hits["first"], hits["last"] = head["ord"][seg], a + shift, b + shift
        return _returned(head["home"][seg], hits, 1)

    return run


def _merged(spec: Spec) -> Callable:
    """Hot windows: which occur in two places, and where first."""

    def run(key, t):
        parts = [np.frombuffer(b, SEEN) for b in t["body"].to_pylist()]
        v, home = np.concatenate(parts), np.repeat(t["home"].to_numpy(), [len(p) for p in parts])
        order = np.lexsort((v["at"], v["doc"], v["hash"]))
        v, home = v[order], home[order]
        start = np.flatnonzero(np.r_[True, v["hash"][1:] != v["hash"][:-1]])
        count = np.diff(np.r_[start, len(v)])
        keep = np.repeat((count > 1) | (np.add.reduceat(v["many"], start) > 0), count)
        out = v[np.repeat(start, count)]
        return _returned(home[keep], out[keep], 2)

    return run


def _removed(spec: Spec) -> Callable:
    def run(key, t, got):
        L = spec.length
        names = ["doc_id", "n_symbols", "n_removed", "n_spans", "kept_sha256"]
        if not len(t):
            return _mid(0, 0).select(names)
        x, ords = Texts.again(spec, t)
        cover = np.zeros(len(x.h) + 1, np.int64)
        for kind, body in zip(got["kind"].to_pylist(), got["body"].to_pylist()):
            if kind == 1:
                hit = np.frombuffer(body, HIT)
                base = x.first[np.searchsorted(ords, hit["ord"])]
                np.add.at(cover, base + hit["first"], 1)
                np.add.at(cover, base + hit["last"] + L, -1)
        seen = [np.frombuffer(b, SEEN) for k, b in zip(got["kind"].to_pylist(), got["body"].to_pylist()) if k == 2]
        if seen and len(x.h) >= L:
            seen = np.concatenate(seen)
            seen = seen[np.argsort(seen["hash"])]
            n = len(x.h) - L + 1
            at = _seq.member(_seq.gram_hash(x.h, L), seen["hash"])
            on = (at >= 0) & (x.left[:n] >= L)
            if spec.earlier:
                w = np.flatnonzero(on)
                of = np.searchsorted(x.first + x.n, w, "right")
                first = seen[at[w]]
                own = np.flatnonzero((first["doc"] == x.doc[of]) & (first["at"] == w - x.first[of]))
                own = own[np.unique(at[w[own]], return_index=True)[1]]  # rows may share a doc_id; the first of them has it
                on[w[own]] = False
            w = np.flatnonzero(on)
            cover[:n][w] += 1
            cover[L : L + n][w] -= 1
        if not spec.earlier:  # the first of equal documents
            lead = np.flatnonzero(t.sort_by("ord")["key"].to_numpy())
            np.add.at(cover, x.first[lead], 1)
            np.add.at(cover, x.first[lead] + x.n[lead], -1)
        covered = np.cumsum(cover)[:-1] > 0
        removed, spans, sha = np.zeros(len(ords), np.int64), np.zeros(len(ords), np.int64), []
        for i in range(len(ords)):
            c = covered[x.first[i] : x.first[i] + x.n[i]]
            removed[i] = c.sum()
            spans[i] = (c[1:] & ~c[:-1]).sum() + (c[0] if len(c) else 0)
            sha.append(x.digest(i, c if removed[i] else None))
        return pa.table({"doc_id": x.ids, "n_symbols": pa.array(x.n, pa.int64()), "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array(sha, pa.string())})

    return run


def remove(docs: DataFrame, spec: Spec, solve: Callable) -> DataFrame:
    """Per row of docs (doc_id, text): n_symbols, n_removed, n_spans (maximal removed runs), kept_sha256.

    Null texts are empty. Rows that repeat a doc_id are told apart by their texts; a row equal to another in both is a
    copy of it. Rows without a doc_id come before all others, in an order of their texts' hashes. No rows give no rows. Columns other than doc_id and text are not read.
    """
    docs = _io.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = _io.volume(docs)
    homes = max(1, math.ceil(size / HOME_BYTES))
    syncs = size / (6 if spec.unit == "words" else 1) * 2 / (spec.k - spec.s + 1) * 8
    buckets, shards = max(8, math.ceil(syncs / BUCKET_BYTES)), max(8, math.ceil(size / SHARD_BYTES))
    place = F.coalesce("doc_id", F.lit(-(2**62)) - F.pmod(F.xxhash64("text"), F.lit(2**61)))
    home = docs.withColumn("place", place).withColumn("home", F.pmod(F.xxhash64("place"), F.lit(homes)).cast("int"))
    parts = max(12, math.ceil(size / (8 << 20)))
    home = home.repartition(parts, "home")
    packed = home.groupBy("home").applyInArrow(_anchors(spec, buckets), "kind int, bucket long, home int, blob binary")
    known = packed.groupBy("kind", "bucket").applyInArrow(_common, _BACK)
    mid = home.groupBy("home").cogroup(known.repartition(parts, "home").groupBy("home")).applyInArrow(_segments(spec, shards), _MID)
    mid = _io.stored(mid, "repeats")
    to = ["key", "home", "body"]
    told = mid.where("kind = 2").select(to).groupBy("key").applyInArrow(_announced(spec), _BACK)
    merged = mid.where("kind = 3").select(to).groupBy("key").applyInArrow(_merged(spec), _BACK)
    live = mid.where("kind = 1").select("home", "ord", "key", "doc_id", "n_symbols", "body")
    sent = live.groupBy("home").cogroup(told.where("kind = 4").groupBy("home")).applyInArrow(_bodies(spec), "key long, home int, body binary")
    solved = sent.groupBy("key").applyInArrow(_answers(spec, solve), _BACK)
    done = mid.where("kind = 0").select("doc_id", "n_symbols", "n_removed", "n_spans", "kept_sha256")
    marks = told.where("kind = 1").unionByName(solved).unionByName(merged)
    rest = live.groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(_removed(spec), done.schema)
    return done.unionByName(rest)
