"""Substring dedup over bytes by longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from roadcut.llm import _seq, repeats


def previous_factor(texts: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """For each position of the byte texts, laid end to end in order of age: the longest factor, up to ``window`` bytes
    and inside its text, that starts earlier as well.

    The suffix array is built by prefix doubling from 8-byte prefixes. The nearest suffixes, before and behind in
    suffix order, that start earlier in the text are its previous and next smaller positions; the longer agreement with
    one of them is the longest previous factor.
    """
    start = np.cumsum(length + 1) - length - 1
    seq = np.zeros(len(texts) + len(length) + 8, np.int64)  # 0 ends a text
    seq[_seq.gather(start, length)] = texts.astype(np.int64) + 1
    n = len(texts) + len(length)
    rank = seq[:n].copy()
    for j in range(1, 7):  # 7 symbols of 9 bits
        rank = rank * 512 + seq[j : n + j]
    _, rank = _seq.sort_order(rank)
    levels, have = [(7, rank)], 7
    while have * 2 < window:
        _, rank = _seq.class_ranks(rank, have, have * 2)
        have *= 2
        levels.append((have, rank))
    order, last = _seq.class_ranks(rank, have, window)
    # texts that end inside the compared symbols differ from all others: their agreement is cut to the text below
    before = _seq.previous_smaller(order)
    behind = n - 1 - _seq.previous_smaller(order[::-1])[::-1]
    lpf = np.zeros(n, np.int64)
    for side in (before, behind):
        ok = (side >= 0) & (side < n)
        i, j = order[ok], order[side[ok]]
        same = np.zeros(len(i), np.int64)
        whole = last[i] == last[j]
        same[whole] = window
        p, q, todo = i[~whole], j[~whole], np.flatnonzero(~whole)
        for step, r in [*reversed(levels), (1, seq[:n])]:
            while True:
                inside = (p + same[todo] < n) & (q + same[todo] < n)
                agree = np.zeros(len(p), bool)
                a, b = p[inside] + same[todo[inside]], q[inside] + same[todo[inside]]
                agree[inside] = r[a] == r[b]
                if not agree.any():
                    break
                same[todo[agree]] += step
                if step > 7:
                    break
        lpf[i] = np.maximum(lpf[i], same)
    left = np.repeat(length, length) - (np.arange(len(texts)) - np.repeat(np.cumsum(length) - length, length))
    return np.minimum(lpf[_seq.gather(start, length)], np.minimum(left, window))


def earlier_window(texts: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """For each position whether its longest previous factor reaches the window: whether its previous or next smaller
    position agrees with it in that many bytes, without the lengths of shorter factors."""
    start = np.cumsum(length + 1) - length - 1
    seq = np.zeros(len(texts) + len(length) + 8, np.int64)
    seq[_seq.gather(start, length)] = texts.astype(np.int64) + 1
    n = len(texts) + len(length)
    rank = seq[:n].copy()
    for j in range(1, 7):
        rank = rank * 512 + seq[j : n + j]
    _, rank = _seq.sort_order(rank)
    order, last = _seq.class_ranks(rank, 7, window)
    hit = np.zeros(n, bool)
    for side in (_seq.previous_smaller(order), n - 1 - _seq.previous_smaller(order[::-1])[::-1]):
        ok = (side >= 0) & (side < n)
        i, j = order[ok], order[side[ok]]
        hit[i[last[i] == last[j]]] = True
    return hit[_seq.gather(start, length)]


def solver(window: int):
    def solve(texts: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
        hit = earlier_window(texts, length, window)
        return hit[_seq.gather(np.cumsum(length) - length, length - window + 1)]

    return solve


def remove_later_copies(docs: DataFrame, window: int = 100) -> DataFrame:
    """Removes each byte covered by a string of ``window`` UTF-8 bytes that also starts earlier: in a smaller doc_id, or
    in the same document before it. The first occurrence stays.

    Candidate windows go to shards by content (see ``repeats``); a shard's segments stand in order of (doc_id, start),
    and its longest-previous-factor array tells which windows have an earlier match.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each input row. Null text: no bytes. Texts
    shorter than the window keep all. A null doc_id counts as the smallest. Of equal rows the first of them in the
    order keeps its bytes. An empty table gives no rows.
    """
    k = max(2, window // 2)
    spec = repeats.Spec("bytes", window, k, max(1, 2 * k - window - 1, k // 8), max(1, window // 4), True)
    return repeats.remove(docs, spec, solver(window)).withColumnRenamed("n_symbols", "n_bytes")


def op10_suffix_array_lpf(spark, sf_dir: str) -> DataFrame:
    from roadcut.llm import _io

    return remove_later_copies(_io.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
