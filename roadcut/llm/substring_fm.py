"""Substring dedup over words by FM-indexes of shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.llm import _seq, repeats

U = np.uint64


class WaveletMatrix:
    """Rank of any symbol in a sequence: one bitmap a level, packed in 64-bit words with a rank directory."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, v = [], values.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            one = (v >> level) & 1 > 0
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(U)
            ranks = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed)[:-1], out=ranks[1:])
            zeros = len(v) - int(one.sum())
            self.levels.append((packed, ranks, zeros))
            v = np.concatenate([v[~one], v[one]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo and hi carried down to the symbol's run, where hi - lo is its count between them."""
        for i, (packed, ranks, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - i)) & 1 > 0
            out = []
            for p in (lo, hi):
                w = p >> 6
                r = ranks[w] + np.bitwise_count(packed[w] & ((U(1) << (p & 63).astype(U)) - U(1))).astype(np.int64)
                out.append(np.where(one, zeros + r, p - r))
            lo, hi = out
        return lo, hi


class FMIndex:
    """Index of texts laid end to end, each behind a separator, for patterns of up to ``depth`` symbols.

    Rows stand in suffix order by their first ``depth`` symbols, which is all that backward search of such patterns
    needs. Symbols are dense ranks from 1; 0 separates.
    """

    def __init__(self, texts: np.ndarray, length: np.ndarray, weight: np.ndarray, depth: int):
        alphabet, dense = np.unique(texts, return_inverse=True)
        self.depth, total = depth, len(texts) + len(length) + 1
        self.start = np.cumsum(length + 1) - length
        at = _seq.gather(self.start, length)
        seq = np.zeros(total, np.int64)
        seq[at] = dense + 1
        w = np.zeros(total, np.int64)
        w[at] = np.repeat(weight, length)
        order, rank = _seq.class_ranks(seq, 1, depth)
        _, shorter = _seq.class_ranks(seq, 1, depth - 1)
        self.seq, self.sigma = seq, len(alphabet) + 1
        self.bwt = WaveletMatrix(seq[order - 1], self.sigma)
        self.before = np.cumsum(np.r_[0, np.bincount(seq, minlength=self.sigma)])
        # a symbol's run in the last level of the wavelet matrix starts here
        self.run = self.bwt.rank(np.arange(self.sigma), np.zeros(self.sigma, np.int64), np.zeros(self.sigma, np.int64))[0]
        self.mass = np.r_[0, np.cumsum(w[order])]
        # the rows that agree with a row in depth - 1 symbols
        c = shorter[order]
        edge = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size = np.diff(np.r_[edge, total])
        self.low, self.high = np.repeat(edge, size), np.repeat(edge + size, size)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: from the rows of P to the rows of symbol + P."""
        a, b = self.bwt.rank(symbol, lo, hi)
        shift = self.before[symbol] - self.run[symbol]
        return a + shift, b + shift

    def statistics(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams each indexed text, all at once, from right to left. For each position: the length of the match that
        starts there, up to depth, and the number of its occurrences by weight."""
        total = int(length.sum())
        match, times = np.zeros(total, np.int64), np.zeros(total, np.int64)
        order = np.argsort(-length, kind="stable")
        n, last = length[order], (self.start + length - 1)[order]
        out = (np.cumsum(length) - 1)[order]
        lo, hi, have = np.zeros(len(n), np.int64), np.full(len(n), len(self.seq), np.int64), np.zeros(len(n), np.int64)
        for step in range(int(n.max(initial=0))):
            m = int(np.searchsorted(-n, -step, "left"))  # texts longer than step
            l, h, k = lo[:m], hi[:m], have[:m]
            full = k == self.depth
            h, l = np.where(full, self.high[l], h), np.where(full, self.low[l], l)
            l, h = self.extend(self.seq[last[:m] - step], l, h)
            lo[:m], hi[:m], have[:m] = l, h, np.minimum(k + 1, self.depth)
            match[out[:m] - step], times[out[:m] - step] = have[:m], self.mass[h] - self.mass[l]
        return match, times


def solver(window: int):
    def solve(texts: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
        match, times = FMIndex(texts, length, weight, window).statistics(length)
        whole = _seq.gather(np.cumsum(length) - length, length - window + 1)  # positions that start a whole window
        return (match[whole] == window) & (times[whole] > 1)

    return solve


def remove_repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """Removes each word covered by a window of words whose word sequence starts anywhere else as well.

    Candidate windows go to shards by content (see ``repeats``). Each shard builds one FM-index of its texts (a wavelet
    matrix over the Burrows-Wheeler transform) and streams the texts through it by backward search; intervals whose
    matching statistic reaches the window in two or more places are reported.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256, a row for each input row. Null text: no words. A text
    of fewer words than the window keeps all. Equal rows are copies of each other. An empty table gives no rows.
    """
    k = max(2, window // 2 + 1)
    spec = repeats.Spec("words", window, k, max(1, 2 * k - window - 1, k // 8), max(1, window // 4), False)
    return repeats.remove(docs, spec, solver(window)).withColumnRenamed("n_symbols", "n_words")


def op2_substring_fm_index(spark, sf_dir: str) -> DataFrame:
    from roadcut.llm import _io

    return remove_repeated_words(_io.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("n_spans"))
