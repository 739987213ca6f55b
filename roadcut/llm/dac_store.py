"""Token ids in directly addressable codes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.llm import _io, _seq, _tokens
from roadcut.llm.chunk_bpe import _slices

U = np.uint64
#: Words that a worker's memo holds; about 200 bytes each, twice.
MEMO = 500_000
#: Words of 64 bits under one count of the rank directory; ids of a block.
STRIDE, BLOCK = 4, 1 << 18
_HEAD, _LEVEL = struct.Struct("<4sII"), struct.Struct("<I")


class Codes:
    """A sequence of unsigned 32-bit integers, any of which can be read without the others.

    Level 0 holds the lowest 8 bits of every value and a bitmap that tells which values go on; level 1 the next 8 bits
    of those, and so on. A value's place on the next level is the rank of its bit, from a directory of counts.
    Layout: magic, count, levels; for each level its size, its bytes, its bitmap, its directory.
    """

    MAGIC = b"DAC1"

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @classmethod
    def of(cls, values: np.ndarray) -> Codes:
        v, levels = values.astype(np.uint32), []
        while True:
            rest = v >> np.uint32(8)
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (8 * STRIDE), np.uint8)]).view("<u8")
            counts = np.bitwise_count(bits).reshape(-1, STRIDE).sum(1)
            levels.append(((v & np.uint32(255)).astype(np.uint8), bits, np.r_[0, np.cumsum(counts)].astype("<u4")))
            if not more.any():
                return cls(levels)
            v = rest[more]

    def to_bytes(self) -> bytes:
        out = [_HEAD.pack(self.MAGIC, len(self), len(self.levels))]
        for low, bits, directory in self.levels:
            out += [_LEVEL.pack(len(low)), low.tobytes(), bits.tobytes(), directory.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Codes:
        magic, n, count = _HEAD.unpack_from(raw)
        if magic != cls.MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at, levels = _HEAD.size, []
        for _ in range(count):
            (size,) = _LEVEL.unpack_from(raw, at)
            at += _LEVEL.size
            words = -(-size // (64 * STRIDE)) * STRIDE
            low = np.frombuffer(raw, np.uint8, size, at)
            bits = np.frombuffer(raw, "<u8", words, at + size)
            directory = np.frombuffer(raw, "<u4", words // STRIDE + 1, at + size + 8 * words)
            at += size + 8 * words + 4 * (words // STRIDE + 1)
            levels.append((low, bits, directory))
        return cls(levels)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The values from start to stop: one rank a level, then the levels run along."""
        out = np.zeros(stop - start, np.uint32)
        to = slice(None)
        for level, (low, bits, directory) in enumerate(self.levels):
            out[to] |= low[start:stop].astype(np.uint32) << np.uint32(8 * level)
            first, last = start >> 6, -(-stop // 64)
            on = np.flatnonzero(np.unpackbits(bits[first:last].view(np.uint8), bitorder="little")[start - 64 * first : stop - 64 * first])
            block = first // STRIDE
            inside = bits[first] & ((U(1) << U(start & 63)) - U(1)) if start & 63 else U(0)
            start = int(directory[block]) + int(np.bitwise_count(bits[block * STRIDE : first]).sum()) + int(np.bitwise_count(inside))
            stop, to = start + len(on), on if level == 0 else to[on]
            if not len(on):
                break
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at any places, in any order."""
        at = np.asarray(at, np.int64)
        out, to = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (low, bits, directory) in enumerate(self.levels):
            out[to] |= low[at].astype(np.uint32) << np.uint32(8 * level)
            word = at >> 6
            on = np.flatnonzero((bits[word] >> (at & 63).astype(U)) & U(1))
            at, word, to = at[on], word[on], to[on]
            block = word // STRIDE
            rank = directory[block].astype(np.int64)
            for j in range(STRIDE - 1):
                w = block * STRIDE + j
                before = w < word
                rank[before] += np.bitwise_count(bits[w[before]])
            rank += np.bitwise_count(bits[word] & ((U(1) << (at & 63).astype(U)) - U(1)))
            at = rank
        return out


_FILE = "part int, block int, n_tokens long, doc_ids binary, sizes binary, codes binary"


def write(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes docs in ascending order of doc_id and writes the ids, ``end_id`` behind each document, as a table of
    blocks in the shared folder; returns that table. A row holds whole documents: about BLOCK ids, or one longer one."""
    path = path or _tokens.vocabulary()
    d = _io.small_batches(docs, "8m").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(12, 3 * d.rdd.getNumPartitions())  # the input's own splits bound their texts

    def run(batches):
        part, block, encoder = TaskContext.get().partitionId(), 0, _tokens.encoder(path, MEMO)
        end = np.uint32(end_id).tobytes()
        ids, docs_, sizes, held = [], [], [], 0

        def row():
            codes = Codes.of(np.frombuffer(b"".join(ids), "<u4")).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([np.array(docs_, "<i8").tobytes()]), pa.array([np.array(sizes, "<u4").tobytes()]), pa.array([codes])], names=["part", "block", "n_tokens", "doc_ids", "sizes", "codes"])

        for batch in batches:
            number, text = _io.longs(batch.column("doc_id")), batch.column("text")
            _, off = _io.text_bytes(text)
            for a, b in _slices(off, 4 << 20):
                for n, raw in zip(number[a:b].tolist(), encoder.encode(text.slice(a, b - a).to_pylist())):
                    ids += [raw, end]
                    docs_.append(n)
                    sizes.append(len(raw) // 4 + 1)
                    held += sizes[-1]
                    if held >= BLOCK:
                        yield row()
                        ids, docs_, sizes, held = [], [], [], 0
                        block += 1
        if docs_:
            yield row()

    return _io.stored(d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _FILE), "codes")


def read(blocks: DataFrame) -> DataFrame:
    """Per document, from the blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                codes, sizes = Codes.from_bytes(r["codes"]), np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                start = np.cumsum(sizes) - sizes
                raw = codes.slice(0, len(codes)).astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), sizes.tolist())]
                number = np.frombuffer(r["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), r["part"]), pa.int32()), pa.array(np.full(len(sizes), r["block"]), pa.int32()), pa.array(number, pa.int64(), mask=number == -(2**63)), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(run, "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long")
    size = blocks.select("part", "block", "n_tokens")
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part: a few rows for any input
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = size.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("within"))
    at = inside.join(parts, "part").select("part", "block", (F.col("before") + F.col("within")).alias("base"))
    return rows.join(at, ["part", "block"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op8_directly_addressable_codes(spark, sf_dir: str) -> DataFrame:
    """Null text: empty, so the end id alone. Rows with one doc_id stand in the order of their texts, a null doc_id
    first. An empty table gives no rows."""
    return read(write(_io.table(spark, sf_dir, "documents")))
