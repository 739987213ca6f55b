"""BPE with content-defined chunk reuse."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.llm import _io, _seq, _tokens

#: Bytes under the rolling hash, and the mean length of a chunk.
ROLLING, MEAN = 24, 512
U = np.uint64


def boundaries(data: np.ndarray, off: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Byte positions at which texts, laid end to end, are cut: the rolling hash of the ROLLING bytes before a position
    decides, so equal passages are cut at equal places; only before the first byte of a character."""
    g = _seq.gram_hash(_seq.byte_symbols(data), ROLLING)
    at = np.flatnonzero((g >> U(7)) % U(mean) == 0) + ROLLING
    at = at[at < len(data)]
    of = np.searchsorted(off, at, "right") - 1
    return at[((data[at] & 0xC0) != 0x80) & (at - off[of] >= ROLLING)]


class Reuse:
    """Encodes texts by chunks. A chunk met before costs a lookup: its ids from its first to its last certain piece
    start. Over a join, the text from the last certain start of the left chunk to the first one of the right chunk is
    encoded again; where a chunk has none, the stretch grows until both sides agree."""

    def __init__(self, path: str, most: int = 24 << 20):
        self.encoder, self.most, self.held = _tokens.encoder(path), most, 0
        self.memo: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        self.hits = self.misses = 0

    def _chunks(self, chunks: list[bytes]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.memo]
        self.misses += len(new)
        self.hits += len(chunks) - len(new)
        inner, cut = [], []
        for c in new:
            s = c.decode()
            first = _tokens.CUT.search(s)
            if first is None:
                self.memo[c] = None
                continue
            last = s.rfind(" ")
            while _tokens.CUT.match(s, last) is None:
                last = s.rfind(" ", 0, last)
            inner.append(s[first.start() : last])
            cut.append((c, s[: first.start()].encode(), s[last:].encode()))
        for (c, head, tail), ids in zip(cut, self.encoder.encode(inner)):
            self.memo[c] = (head, ids, tail)
            self.held += 2 * len(c) + len(ids)

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of texts laid end to end, as little-endian unsigned 32-bit integers."""
        if self.held > self.most:
            self.memo.clear()
            self.held = 0
        cut, raw = boundaries(data, off), data.tobytes()
        lo = np.searchsorted(cut, off[:-1], "right")
        hi = np.searchsorted(cut, off[1:], "left")
        texts = []
        for i in range(len(off) - 1):
            p = [int(off[i]), *cut[lo[i] : hi[i]].tolist(), int(off[i + 1])]
            texts.append([raw[a:b] for a, b in zip(p[:-1], p[1:])])
        self._chunks([c for t in texts for c in t])
        joins, plans = [], []
        for t in texts:
            plan, left = [], b""
            for c in t:
                known = self.memo[c]
                if known is None:
                    left += c
                    continue
                plan.append((len(joins), known[1]))
                joins.append((left + known[0]).decode())
                left = known[2]
            plan.append((len(joins), b""))
            joins.append(left.decode())
            plans.append(plan)
        repaired = self.encoder.encode(joins)
        return [b"".join([x for j, ids in plan for x in (repaired[j], ids)]) for plan in plans]


def _slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def encode_decode(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """Ids of every text and the text that they decode to.

    Documents that share chunks travel to one task (by the smallest chunk hash of a text; large groups are split by
    size, at the cost of a second encoding), where each distinct chunk is encoded once.

    path: a byte-level BPE file of the tokenizers library. keep: also return the ids and the decoded text.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded), a row for each input row. Null text: as
    empty. Very long texts are encoded whole. Rows that repeat are returned each. An empty table gives no rows.
    """
    path = path or _tokens.vocabulary()

    @F.arrow_udf("long")
    def near(text: pa.Array) -> pa.Array:
        data, off = _io.text_bytes(text)
        out = np.zeros(len(off) - 1, np.int64)
        for a, b in _slices(off, 2 << 20):
            d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            cut = np.unique(np.r_[o[:-1], boundaries(d, o)])
            end = np.r_[cut[1:], len(d)]
            h = _seq.spans_hash(_seq.byte_symbols(d), cut, end)
            full = np.searchsorted(cut, o[:-1])
            some = np.flatnonzero(np.diff(o) > 0)
            if len(some):
                out[a + some] = np.minimum.reduceat(h, full[some]).astype(np.int64)
        return pa.array(out)

    def run(batches):
        reuse, back = Reuse(path), _tokens.decoder(path)
        for batch in batches:
            ids = batch.column("doc_id")
            data, off = _io.text_bytes(batch.column("text"))
            for a, b in _slices(off, 1 << 20):
                got = reuse.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                arrays = [np.frombuffer(x, "<u4") for x in got]
                texts = [back.decode(x) for x in arrays]
                out = {
                    "doc_id": ids.slice(a, b - a),
                    "n_tokens": pa.array([len(x) for x in arrays], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                }
                if keep:
                    out |= {"ids": pa.array([x.astype(np.int32) for x in arrays], pa.list_(pa.int32())), "decoded": pc.cast(pa.array(texts, pa.binary()), pa.string())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    d = _io.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("near", near("text")).hint("rebalance", F.col("near")).select("doc_id", "text")
    extra = ", ids array<int>, decoded string" if keep else ""
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def op6_chunk_reuse_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(_io.table(spark, sf_dir, "documents"))
