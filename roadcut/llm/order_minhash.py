"""Near-duplicate classes by Order MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.llm import _io, _seq
from roadcut.llm.chunk_bpe import _slices
from roadcut.operators import graph

U = np.uint64
#: Words of a shingle; sketches of a text; shingles of a sketch.
SHINGLE, SKETCHES, ORDERED = 5, 24, 2
#: A key joins a sketch with those so many places on (all differences are different).
JOINED = (1, 5)
#: Bytes of a shingle's hash that tell the shingles of compared texts apart.
WIDTH = 6
MEMBER = ("key", "rep", "size", "at", "n")
#: Pivots that have met a bucket grow by this factor a turn.
MORE = 32
#: Pairs that a task joins to classes, about.
PART = 200_000
#: Texts or pairs of texts that a task works on at least.
HEAVY = 1000
#: Texts of the sample that tells which shingles are common; how often such a one stands there; how many are told at most.
SAMPLE, COMMON, TOLD = 4000, 3, 50_000
#: Bits of the map that tells which rows a join won't need.
BITS = 1 << 22


def labelled(h: np.ndarray, of: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, each joined with the number of its earlier occurrences in its text, and the text
    of each. So the shingles of a text are all different."""
    g = _seq.gram_hash(h, shingle)
    ok = np.flatnonzero(of[shingle - 1 :] == of[: len(g)]) if len(g) else np.zeros(0, np.int64)
    g, t = g[ok], of[ok]
    order = np.lexsort((g, t))
    gs, ts = g[order], t[order]
    new = np.r_[True, (gs[1:] != gs[:-1]) | (ts[1:] != ts[:-1])] if len(gs) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(gs)), 0)) if len(gs) else np.zeros(0, np.int64)
    nth = np.empty(len(gs), np.int64)
    nth[order] = np.arange(len(gs)) - start
    return np.where(nth > 0, _seq.mix(g ^ (nth.astype(U) * U(0x9E3779B97F4A7C15))), g), t


def sketches(g: np.ndarray, t: np.ndarray, texts: int, count: int = SKETCHES, ordered: int = ORDERED) -> np.ndarray:
    """Order MinHash of each text (text, sketch): the ``ordered`` smallest labelled shingles under the sketch's own hash,
    joined in the order in which they stand in the text. Texts with fewer shingles join those they have; none: 0. A key
    joins three sketches, so that texts that share a passage only seldom meet; no two keys have two sketches in common."""
    out = np.zeros((texts, count), U)
    if not len(g):
        return out
    have = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    size = np.diff(np.r_[have, len(t)])
    row = t[have]
    place = np.arange(len(g), dtype=np.int64)
    for j in range(count):
        v = _seq.mix(g ^ U((j + 1) * 0xA24BAED4963EE407 % 2**64))
        picks = []
        for _ in range(ordered):
            low = np.minimum.reduceat(v, have)
            at = np.minimum.reduceat(np.where(v == np.repeat(low, size), place, len(g)), have)
            picks.append(np.where(low < U(2**64 - 1), at, -1))
            v[at] = U(2**64 - 1)
        picks = np.sort(np.stack(picks), 0)
        key = np.full(len(have), j, U)
        for p in picks:
            key = np.where(p >= 0, _seq.mix(key * U(0x9E3779B97F4A7C15) ^ g[np.maximum(p, 0)]), key)
        out[row, j] = key
    key = out.copy()
    for apart in JOINED:
        key = _seq.mix(key * U(0x9E3779B97F4A7C15) + np.roll(out, -apart, 1))
    return key


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the best alignment of two sequences of distinct shingles keeps enough of them: with m kept in order,
    m / (len(a) + len(b) - m) >= similarity.

    Equal shingles are matched (i, j) and chained, i and j rising, inside the band that a good alignment can't leave:
    |i - j| is at most the number of shingles it may drop. Runs of matches on one diagonal are chained as wholes.
    """
    if not len(a) or not len(b):
        return False
    total = len(a) + len(b)
    least = similarity * total / (1 + similarity)
    if min(len(a), len(b)) < least - 1e-9:
        return False
    order = np.argsort(b)
    at = _seq.member(a, b[order])
    i = np.flatnonzero(at >= 0)
    j = order[at[i]]
    band = np.abs(i - j) <= total - 2 * least + 1e-9
    i, j = i[band], j[band]
    if len(i) < least - 1e-9:
        return False
    cut = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)])
    size = np.diff(np.r_[cut, len(i)])
    start, best = j[cut], size.copy()
    if len(cut) > 1 and (np.diff(start) < 0).any():
        for k in range(1, len(cut)):
            before = best[:k][start[:k] < start[k]]
            if len(before):
                best[k] = size[k] + before.max()
        kept = int(best.max())
    else:
        kept = len(i)
    return kept >= least - 1e-9


def _words(text: pa.Array):
    data, off = _io.text_bytes(text)
    for i, j in _slices(off, 1 << 20):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        ws, we, of = _seq.words(d, o)
        h = _seq.word_symbols(d, ws, we)
        yield i, j, h, of, np.bincount(of, minlength=j - i)


def _cut(g: np.ndarray) -> np.ndarray:
    """The bits of shingles' hashes by which compared texts are told apart."""
    return (g >> U(64 - 8 * WIDTH)).astype(np.int64)


def _sampled(shingle: int):
    """key, n: shingles of the batches' texts and how often they stand there."""

    def run(batches):
        for batch in batches:
            for _, _, h, of, _ in _words(batch.column("text")):
                key, n = np.unique(_cut(labelled(h, of, shingle)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def _common(docs: DataFrame, shingle: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles (rising) and how common they are, by a sample of the different texts. It only sets the order of
    shingles, so it bears on the work and not on the result."""
    some = docs.where(F.pmod(F.xxhash64("same"), F.lit(max(1, count // SAMPLE))) == 0).groupBy("same").agg(F.first("text").alias("text"))
    n = some.select("text").mapInArrow(_sampled(shingle), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    got = n.orderBy(F.desc("n"), "key").limit(TOLD).collect()
    key, many = np.array([r.key for r in got], np.int64), np.array([r.n for r in got], np.int64)
    order = np.argsort(key)
    return key[order], many[order]


def prefixes(key: np.ndarray, of: np.ndarray, texts: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text (of: rising) the shingles of which two texts of that similarity must share one: the first of one order of all
    shingles, as many as a text may lack and one more. The order is by commonness, then by key. The shingles in that order, where
    each text's begin (one more for the end), and how many of each text's aren't common."""
    many = np.zeros(len(key), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], key), len(common[0]) - 1)
        many = np.where(common[0][at] == key, common[1][at], 0)
    order = np.lexsort((key, many, of))
    n = np.bincount(of, minlength=texts)
    take = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    pick = order[_seq.gather(np.cumsum(n) - n, take)]
    start = np.r_[0, np.cumsum(take)]
    plain = np.r_[0, np.cumsum(many[pick] == 0)]
    return key[pick], start, plain[start[1:]] - plain[start[:-1]]


def _sketched(shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]):
    def run(batches):
        for batch in batches:
            for i, j, h, of, n in _words(batch.column("text")):
                g, t = labelled(h, of, shingle)
                keys = sketches(g, t, j - i)
                rare, start, plain = prefixes(_cut(g), t, j - i, similarity, common)
                rare = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(rare))
                first = np.cumsum(n) - n
                whole = _seq.spans_hash(h, first, first + n).astype(np.int64)
                off = pa.array(np.arange(0, (j - i + 1) * SKETCHES, SKETCHES), pa.int32())
                same = [batch.column(c).slice(i, j - i) for c in ("doc_id", "same")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(whole), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(keys.astype(np.int64).ravel())), rare, pa.array(plain, pa.int32())], names=["doc_id", "same", "whole", "n_words", "sketch", "rare", "plain"])

    return run


def tally(key: np.ndarray) -> np.ndarray:
    """How many of a text's shingles fall into each of n / 4 to n / 2 bins, 255 at most."""
    bins = max(16, 1 << max(0, (len(key) >> 2) - 1).bit_length())
    return np.minimum(np.bincount(key & (bins - 1), minlength=bins), 255).astype(np.uint8)


def could_be(a: np.ndarray, b: np.ndarray, n: int, similarity: float) -> bool:
    """False only where two texts of n shingles together can't be similar, by their tallies: what these differ by, the finer one
    folded, is no more than the shingles that only one text has."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    b = b.reshape(-1, len(a)).sum(0, dtype=np.int64)
    return np.abs(b - a).sum() <= n - 2 * np.ceil(similarity * n / (1 + similarity) - 1e-9)


def _shingled(shingle: int):
    def run(batches):
        for batch in batches:
            for i, j, h, of, n in _words(batch.column("text")):
                g, t = labelled(h, of, shingle)
                cut = np.searchsorted(t, np.arange(j - i + 1))
                flat = (g >> U(64 - 8 * WIDTH)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                said = pa.array([flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
                key = _cut(g)
                told = pa.array([tally(key[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), said, told], names=["rep", "shingles", "tally"])

    return run


def _numbers(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _verified(similarity: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a_said").to_pylist(), batch.column("b_said").to_pylist()
            yes, at, known = [], None, None
            for x, y in zip(a, b):
                if x is not at and x != at:
                    at, known = x, _numbers(x)
                yes.append(aligned(known, _numbers(y), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], names=["a", "b", "yes"])

    return run


def _tallied(similarity: float):
    def run(batches):
        for batch in batches:
            a, b, n = batch.column("a_said").to_pylist(), batch.column("b_said").to_pylist(), batch.column("n").to_pylist()
            yes = [bool(could_be(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), k, similarity)) for x, y, k in zip(a, b, n)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], names=["a", "b", "yes"])

    return run


def _compared(pairs: DataFrame, shingles: DataFrame, column: str, run) -> DataFrame:
    """a, b, yes for pairs (a, b): a is a pivot, whose column travels once for each share of its partners."""
    there = _only(shingles, pairs.select(F.explode(F.array("a", "b")).alias("rep")), "rep")
    said, n = F.col(column), (F.octet_length("shingles") / WIDTH).cast("long")
    left = there.select(F.col("rep").alias("a"), said.alias("a_said"), n.alias("a_n"))
    right = there.select(F.col("rep").alias("b"), said.alias("b_said"), n.alias("b_n"))
    both = _io.spread(pairs, ["a"], left, "b", with_rows=lambda p: p.join(right, "b"))
    return both.select("a", "b", "a_said", "b_said", (F.col("a_n") + F.col("b_n")).alias("n")).mapInArrow(run, "a long, b long, yes boolean")


def _checked(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """a, b, yes for pairs (a, b). Tallies, which are short, go first; shingles only of the pairs that these don't rule out."""
    told = _io.stored(_compared(pairs, shingles, "tally", _tallied(similarity)), "told", pairs.count(), 10 * HEAVY)
    return told.where("NOT yes").unionByName(_compared(told.where("yes").select("a", "b"), shingles, "shingles", _verified(similarity)))


def _first(similarity: float):
    def run(batches):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            raw = [_numbers(x).astype(np.int64) for x in batch.column("shingles").to_pylist()]
            n = np.array([len(x) for x in raw], np.int64)
            key, start, _ = prefixes(np.concatenate([none[0], *raw]), np.repeat(np.arange(len(raw)), n), len(raw), similarity, none)
            row = np.repeat(np.arange(len(raw)), np.diff(start))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("rep").take(pa.array(row)), pa.array(n[row]), pa.array(np.arange(len(key)) - start[row] + 1)], names=["key", "rep", "size", "at"])

    return run


def _postings(open_: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """key, rep, size, at: of the texts in open_ the shingles by which an exact prefix filter joins them (prefixes), with their
    places in that order. Any two of these texts that are similar have one in common at places that _near allows."""
    return shingles.join(open_.select("rep").distinct(), "rep", "left_semi").mapInArrow(_first(similarity), "key long, rep long, size long, at long")


def _only(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """rows without most of those whose column isn't among wanted's, by a map of bits that is broadcast: half a megabyte at
    any size. It loses none that is."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS)).alias("bit")
    bits = wanted.select(bit).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bit_map")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    r = rows.withColumn("bit", bit).withColumn("bit_map", F.expr("bitmap_bucket_number(bit)")).join(F.broadcast(bits), "bit_map")
    there = F.expr("shiftright(conv(hex(substring(bits, CAST(bitmap_bit_position(bit) div 8 AS INT) + 1, 1)), 16, 10)::INT, CAST(bitmap_bit_position(bit) % 8 AS INT)) & 1 = 1")
    return r.where(there).select(*rows.columns)


def _met(texts: DataFrame, similarity: float) -> DataFrame:
    """key, rep, size, at, n (members): the prefixes of texts (whole, size, rare, plain), but for shingles that one text alone
    has there. Common shingles are few (TOLD), so their numbers go to the rows, whose members stay where they are. The others'
    members meet at once, and of them those go that can be similar to no member of their bucket: the next larger one is too
    large, and they are too large for all smaller ones (_near)."""
    p = texts.select(F.col("whole").alias("rep"), "size", "plain", F.posexplode("rare").alias("at", "key"))
    p = p.select("key", "rep", F.col("size").cast("int").alias("size"), (F.col("at") + 1).alias("at"), (F.col("at") < F.col("plain")).alias("own"))
    common = p.where("NOT own").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    common = p.where("NOT own").join(F.broadcast(common), "key").select(*MEMBER)
    p = p.where("own").drop("own").withColumn("largest", F.floor((F.col("size") - F.col("at") + 1 + 1e-9) * (1 + similarity) / similarity) - F.col("size"))
    by_size = Window.partitionBy("key").orderBy("size", "rep")
    over, under = F.lead("size").over(by_size) <= F.col("largest"), F.max("largest").over(by_size.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("size")
    meets = F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False))
    own = p.withColumn("n", F.count("*").over(Window.partitionBy("key"))).withColumn("meets", meets).where("meets")
    longs = [F.col(c).cast("long").alias(c) for c in MEMBER]
    return own.select(*longs).unionByName(common.select(*longs))


def _buckets(members: DataFrame, count: int, left: int) -> DataFrame:
    """key, rep, size, at, n (members) of the buckets with two members or more; count: rows, left: of these, about."""
    many = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return _io.stored(_io.spread(members.select("key", "rep", "size", "at"), ["key"], many, "rep", count), "buckets", left)


def _near(similarity: float) -> Column:
    """Whether rows of a bucket can be similar: what stands before and at the key's places leaves shingles enough."""
    share = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("pivot_size")) - 1e-9)
    return (F.col("at") + share <= F.col("size") + 1) & (F.col("pivot_at") + share <= F.col("pivot_size") + 1)


def _open(members: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """key, rep, size, at, n, root: the members of buckets of ``least`` members or more that hold more than one class."""
    count = members.count()
    m = members.where(F.col("n") >= least).select(*MEMBER).join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
    two = m.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return _io.stored(_io.spread(m, ["key"], two, "rep", n="n"), "members", count)


def _pivots(members: DataFrame, meets: DataFrame, first: int, last: int) -> DataFrame:
    """key, pivot, pivot_root, pivot_size, pivot_at: those ranked first to last in each bucket, the ones that meet most others being first. Ranked
    in shares of a bucket, then among the shares' first."""
    m = members.join(meets, "rep").withColumn("share", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(_io.shares(members.count()))))
    order = [F.desc("meets"), F.xxhash64("rep"), F.col("rep")]
    near = m.withColumn("rank", F.row_number().over(Window.partitionBy("key", "share").orderBy(*order))).where(F.col("rank") <= last)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return best.where(F.col("rank").between(first, last)).select("key", F.col("rep").alias("pivot"), *(F.col(c).alias(f"pivot_{c}") for c in ("root", "size", "at")))


def _components(checked: DataFrame) -> DataFrame:
    """node, root for the ends of the pairs that were found alike."""
    half = checked.where("yes").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    count = checked.count()
    return _io.stored(graph.components(half, dealt=1 + count // PART).select(F.col("id").alias("node"), F.col("component").alias("root")), "roots", count)


def _linked(members: DataFrame, shingles: DataFrame, similarity: float, checked: DataFrame | None, turns: int | None, last: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that were compared (a, b, yes), roots, and the open buckets (as _open) after so many turns; with None, when no
    bucket holds two classes that haven't been compared. members: as of _buckets. last: pivots of the first turn."""
    if checked is None:
        checked, roots = members.sparkSession.createDataFrame([], "a long, b long, yes boolean"), None
        rows = members.select(*MEMBER, F.col("rep").alias("root"))
    else:
        roots = _components(checked)
        rows = _open(members, roots, 2)
    first, turn = 1, 0
    meets = members.groupBy("rep").agg(F.sum("n").alias("meets"))
    while not rows.isEmpty() and turn != turns:
        pivots = _pivots(rows, meets, first, last)
        met = _io.spread(rows, ["key"], pivots, "rep", n="n").where(_near(similarity) & (F.col("root") != F.col("pivot_root")))
        # a pair of which each is the other's pivot goes once, from the lesser one
        pairs = met.select(F.least("pivot", "rep").alias("lo"), F.greatest("pivot", "rep").alias("hi"), "pivot").groupBy("lo", "hi").agg(F.min("pivot").alias("a"))
        pairs = pairs.join(checked.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti")
        pairs = _io.stored(pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "pairs", rows.count())
        first, last, turn = last + 1, MORE * last, turn + 1
        found = False
        if count := pairs.count():
            more = _io.stored(_checked(pairs, shingles, similarity), "checked", count, HEAVY)
            checked, found = checked.unionByName(more), not more.where("yes").isEmpty()
        if roots is None or found:
            roots = _components(checked)
        before, rows = rows, _open(rows, roots, first)
        _io.dropped(before, pairs)
    return checked, _components(checked) if roots is None else roots, rows


def classes(docs: DataFrame, similarity: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id of its class of near-duplicates), n_words, class_key (a number that tells
    the class apart even where rows share a doc_id), same (hash of the text as it stands).

    Two texts are linked if the best alignment of their shingles of five words keeps m of them, with m / (n1 + n2 - m)
    at least ``similarity``; classes are the connected components. Texts with the same words are one class at once and
    go on as one.

    Candidates: texts that share a key of Order MinHash. In each key's bucket the others are compared to a pivot, the
    member that meets most others (the middle of a star). Behind them all texts go through an exact prefix filter: any two
    similar ones share one of the first fifth of their shingles (in one order of all shingles, the common ones last), so each
    such shingle is a bucket again, in which pivots (one, 32 times as many and so on, linked or not) meet the members that
    aren't of their class until all are compared or of one class. So no pair is lost, whether or not it shares a key. Buckets,
    pivots' partners and classes are joined in shares, so no task gets one that holds a large part of all rows.

    Texts of fewer than five words link only to equal ones; texts without words are equal. Null text: empty. A null
    doc_id is the class's only where no row has another. Rows that repeat are returned each. Rows with
    one doc_id and different texts are different texts. An empty table gives no rows. Long texts go through in slices,
    whole. Columns other than doc_id and text are not read.
    """
    d = _io.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("same", F.xxhash64("text"))
    rows = d.count()
    sketched = _sketched(shingle, similarity, _common(d, shingle, rows))
    sketched = _io.stored(d.mapInArrow(sketched, "doc_id long, same long, whole long, n_words long, sketch array<long>, rare array<long>, plain int"), "sketches", rows, 2 * HEAVY)
    own = _io.stored(sketched.select("doc_id", "same", "whole", "n_words"), "rows", rows)
    texts = sketched.where(f"n_words >= {shingle}").groupBy("whole").agg(F.min("same").alias("same"), *(F.first(c).alias(c) for c in ("n_words", "sketch", "rare", "plain")))
    texts = _io.stored(texts.withColumn("size", F.col("n_words") - shingle + 1), "texts", rows, 10 * HEAVY)
    _io.dropped(sketched)
    count = texts.count()
    keys = texts.select(F.col("whole").alias("rep"), "size", F.lit(1).cast("long").alias("at"), F.explode("sketch").alias("key"))
    buckets = _buckets(keys, count * SKETCHES, count)
    met = _io.stored(_met(texts, similarity), "rare", count, 2 * HEAVY)
    need = buckets.select("rep").union(met.select("rep")).distinct()
    need = _io.stored(need.join(texts.select(F.col("whole").alias("rep"), "same"), "rep"), "need", count)
    _io.dropped(texts)
    said = _only(d, need, "same").groupBy("same").agg(F.first("text").alias("text")).join(need.select("same", "rep"), "same").select("rep", "text")
    shingles = _io.stored(said.mapInArrow(_shingled(shingle), "rep long, shingles binary, tally binary"), "shingles", need.count(), HEAVY)
    checked, _, rest = _linked(buckets, shingles, similarity, None, 1)
    _io.dropped(buckets, rest)
    _, roots, _ = _linked(met, shingles, similarity, checked, None, MORE)
    _io.dropped(met, shingles)
    least = own.groupBy("whole").agg(F.min("doc_id").alias("least"))
    least = _io.stored(least.join(roots, F.col("whole") == F.col("node"), "left").select("whole", F.coalesce("root", "whole").alias("class_key"), "least"), "least", count)
    of = least.groupBy("class_key").agg(F.min("least").alias("first"))
    of = _io.spread(least.select("whole", "class_key"), ["class_key"], of, "whole").select("whole", "class_key", F.col("first").alias("class_id"))
    out = _io.spread(own.select("doc_id", "same", "whole", "n_words"), ["whole"], _io.stored(of, "classes", count), "doc_id")
    return out.select("doc_id", "class_id", "n_words", "class_key", "same")


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(_io.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_words")
