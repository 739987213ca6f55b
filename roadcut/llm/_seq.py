"""Array kernels on symbol sequences (words or bytes of many texts at once)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P, _T = 0x9E3779B97F4A7C15 | 1, np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U)
_PINV = pow(_P, -1, 2**64)
_pw, _ipw = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    global _pw, _ipw
    if len(_pw) < n:
        m = 1 << (n - 1).bit_length()
        out = []
        for p in (_P, _PINV):
            a = np.full(m, p, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _pw, _ipw = out
    return _pw[:n], _ipw[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(31)
    return x


def spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of h[start:end] for each pair; equal sequences have equal hashes wherever they stand."""
    pw, ipw = powers(len(h) + 1)
    s = np.zeros(len(h) + 1, U)
    np.cumsum(h * pw[: len(h)], out=s[1:])
    return mix((s[end] - s[start]) * ipw[start])


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive symbols."""
    if len(h) < k:
        return np.zeros(0, U)
    pw, ipw = powers(len(h) + 1)
    s = np.zeros(len(h) + 1, U)
    np.cumsum(h * pw[: len(h)], out=s[1:])
    g = s[k:] - s[:-k]
    g *= ipw[: len(g)]
    return mix(g)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    if len(a) < w:
        return a[:0]
    p = 1
    while p * 2 <= w:
        a = np.minimum(a[:-p], a[p:])
        p *= 2
    return np.minimum(a[: len(a) - (w - p)], a[w - p :]) if p < w else a


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _T[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word ``[^\\x20\\x09-\\x0D]+`` in texts data[offsets[i]:offsets[i+1]]."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = ~space
    start = np.flatnonzero(w[1:-1] & (~w[:-2] | edge[:-1]))
    end = np.flatnonzero(w[1:-1] & (~w[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans_hash(_T[data], start, end)


def room(lengths: np.ndarray) -> np.ndarray:
    """For each symbol of texts laid end to end: the symbols from it to the end of its text."""
    ends = np.cumsum(lengths)
    return np.repeat(ends, lengths) - np.arange(int(ends[-1]) if len(ends) else 0)


def syncmers(h: np.ndarray, left: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers: k-grams whose smallest s-gram is the first or the last one.

    Whether a k-gram is one depends on its symbols alone, and k - s consecutive k-grams of a text hold one at least.
    """
    g, n = gram_hash(h, s), len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    m = sliding_min(g, k - s + 1)
    at = np.flatnonzero(((m == g[:n]) | (m == g[k - s :])) & (left[:n] >= k))
    pw, ipw = powers(len(h) + 1)
    c = np.zeros(len(h) + 1, U)
    np.cumsum(h * pw[: len(h)], out=c[1:])
    return at, mix((c[at + k] - c[at]) * ipw[at])


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each pair, end to end."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)


def runs(on: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each maximal run of true values; cut[i]: a run may not hold both i-1 and i."""
    w = np.zeros(len(on) + 2, bool)
    w[1:-1] = on
    c = np.zeros(len(on) + 1, bool)
    if cut is not None:
        c[:-1] = cut
    return np.flatnonzero(w[1:-1] & (~w[:-2] | c[:-1])), np.flatnonzero(w[1:-1] & (~w[2:] | c[1:]))


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def sort_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and each one's dense rank."""
    order = np.argsort(key)
    k = key[order]
    new = np.zeros(len(k), np.int64)
    new[1:] = k[1:] != k[:-1]
    rank = np.empty(len(k), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def class_ranks(rank: np.ndarray, have: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``depth`` symbols from ranks by the first ``have``, by prefix doubling; and the ranks
    before the last step, which are by the ``have`` symbols that depth/2 <= have < depth."""
    n = len(rank)

    def joined(r: np.ndarray, shift: int) -> np.ndarray:
        second = np.zeros(n, np.int64)
        second[: n - shift] = r[shift:] + 1
        return r * (int(r.max(initial=0)) + 2) + second

    while have * 2 < depth:
        _, rank = sort_order(joined(rank, have))
        have *= 2
    order, last = sort_order(joined(rank, depth - have))
    return order, last


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each index the nearest earlier one with a smaller value, or -1; pointers jump over larger values."""
    p = np.arange(-1, len(v) - 1)
    todo = np.arange(len(v))
    while len(todo):
        q = p[todo]
        todo = todo[(q >= 0) & (v[np.maximum(q, 0)] > v[todo])]
        p[todo] = p[p[todo]]
    return p
