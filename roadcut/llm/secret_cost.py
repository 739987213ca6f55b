"""Secret scan: fixed patterns, and the cost to guess the value in a credential context."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.llm import _io

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Contexts beyond the fixed pattern: group value is the value; prose: the forms in which plain words may follow.
_CONTEXT = re.compile(
    r"""(?:(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|credentials?|auth(?:orization)?|bearer)(?![a-z])["']?\x20*(?:[:=]>?|->|(?P<prose>is|was))\x20*(?:bearer\x20+|basic\x20+)?["'`<]?|://[^\s:/@]+:(?=[^\s/]+@))(?P<value>[^\s"'`<>@,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_WORDS_IN = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "://")
#: Frequent parts of passwords, most frequent first.
COMMON = """password admin welcome login user guest root test qwerty letmein master hello monkey dragon secret shadow
love sunshine princess football baseball superman batman summer winter spring autumn monday friday january october
changeme default example sample demo temp pass key token name home work office company server system access public
private the you and for are not this that with from have will what your all can new one two three god money star
blue red green black white king queen angel baby happy lucky magic power freedom flower chocolate cookie pepper
computer internet google apple samsung microsoft windows linux mobile phone""".split()
_LEET = str.maketrans("4@831!05$7", "aabeiiosst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d")


@lru_cache(1)
def _neighbours() -> frozenset[str]:
    """Pairs of keys side by side or one row apart, and pairs of characters that follow each other."""
    out = set()
    for r, row in enumerate(_ROWS):
        for i, c in enumerate(row):
            near = [row[j] for j in (i - 1, i + 1) if 0 <= j < len(row)]
            for q in (r - 1, r + 1):
                if 0 <= q < len(_ROWS):
                    near += [_ROWS[q][j] for j in (i - 1, i, i + 1) if 0 <= j < len(_ROWS[q])]
            out |= {c + d for d in near}
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    for s in (alphabet, alphabet[::-1], "0123456789", "9876543210"):
        out |= {s[i : i + 2] for i in range(len(s) - 1)}
    return frozenset(out)


def _bits(c: str) -> float:
    """log10 of the guesses for one character by brute force."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def guess_cost(value: str, words: tuple[str, ...] = tuple(COMMON), enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of the value needs, or, once that is certain to reach
    ``enough``, some number not less than ``enough``.

    best[j] is the cost of the first j characters: the least, over the last segment, of best[i] plus the segment's cost
    as a word (rank, capitals, character swaps), date, repeat of what stands before, keyboard walk or brute force, plus
    a constant for each segment. An empty value costs 0.

    Costs are never negative, so a start that costs enough can't lead to less, and a value ends where only such starts
    are left. Brute force is a sum, so the cheapest start is carried along. A walk or repeat that goes on is taken up at a
    later character only where an earlier start of it isn't as cheap for all its ends. So long values take time in
    proportion to their length, as a rule.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a capital whose small form is two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, near = low.translate(_LEET), _neighbours()
    best = [0.0] + [math.inf] * n
    by_first: dict[str, list[tuple[int, str]]] = {}
    for rank, w in enumerate(words, 2):
        by_first.setdefault(w[0], []).append((rank, w))
    step = math.log10(2)
    brute, reach, walk_end, walks = math.inf, 0, 0, []
    ends = [0] * 65  # of the run of each period
    starts: list[dict[int, list[int]]] = [{} for _ in range(65)]  # where it was taken up, by place in the period
    for i in range(n):
        here = best[i] = min(best[i], brute)
        if here >= enough:
            if i >= reach:
                return here
            brute += _bits(value[i])
            continue
        brute = min(brute, here + step) + _bits(value[i])
        for rank, w in by_first.get(plain[i], ()):
            if plain.startswith(w, i):
                part = value[i : i + len(w)]
                cost = math.log10(rank) + (0.3 if part[0].isupper() else 0) + 0.3 * sum(c.isupper() for c in part[1:]) + 0.3 * sum(a != b for a, b in zip(low[i:], w))
                best[i + len(w)] = min(best[i + len(w)], here + step + cost)
                reach = max(reach, i + len(w))
        for j in range(min(n, i + 10), i + 3, -1):
            if _DATE.fullmatch(low, i, j):
                best[j] = min(best[j], here + step + math.log10(365 * 120))
                reach = max(reach, j)
        if i >= walk_end:
            walk_end, walks = i + 1, []
            while walk_end < n and low[walk_end - 1 : walk_end + 1] in near:
                walk_end += 1
        if walk_end >= i + 3 and all(here - best[k] < math.log10((3 + i - k) / 3) - 1e-12 for k in walks):
            walks.append(i)
            for j in range(i + 3, walk_end + 1):
                best[j] = min(best[j], here + step + math.log10(47 * 4 * (j - i)))
            reach = max(reach, walk_end)
        for size in range(1, min(i, 64) + 1):  # the size characters before i, again and again
            if i >= ends[size]:
                end, starts[size] = i, {}
                while end < n and low[end] == low[end - size]:
                    end += 1
                ends[size] = end if end > i else i + 1
                if end == i:
                    continue
            if ends[size] - i < size or low[i] != low[i - size]:
                continue
            taken = starts[size].setdefault(i % size, [])
            if any(here - best[k] >= math.log10((2 + (i - k) // size) / 2) - 1e-12 for k in taken):
                continue
            taken.append(i)
            for times, j in enumerate(range(i + size, ends[size] + 1, size), 2):
                best[j] = min(best[j], here + step + math.log10(times))
                reach = max(reach, j)
    return min(best[n], brute) if n else 0.0


def _covered(a: int, b: int, base: list[tuple[int, int]]) -> bool:
    """Whether the spans, in order, cover all of a to b."""
    for s, e in base:
        if s > a:
            break
        a = max(a, e)
        if a >= b:
            return True
    return False


def spans(text: str, least: float = 10.0, hex_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every finding, in order.

    Values in other credential contexts count when they cost 10**least guesses or more and no other findings cover them
    wholly. Behind "is" and "was", where prose stands, they must also have a digit, and letters or signs.
    """
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hex_run:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(w in low for w in _WORDS_IN):
        base = sorted((s, e) for s, _, e in out)
        for m in _CONTEXT.finditer(text):
            value = m["value"].rstrip(".:!?)]}")
            a, b = m.start("value"), m.start("value") + len(value)
            if len(value) < 6 or _covered(a, b, base):
                continue
            if m["prose"]:
                mixed = any(c.isalpha() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
                if mixed < 2 or not any(c.isdigit() for c in value):
                    continue
            if guess_cost(value, enough=least) >= least:
                out.append((a, 3, b))
    return sorted(out)


def _long_hex(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have 24 consecutive lowercase hex digits."""
    m = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    for p in (1, 2, 4, 8):
        m = m[:-p] & m[p:] if len(m) > p else m[:0]
    m = m[:-8] & m[8:] if len(m) > 8 else m[:0]
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, np.flatnonzero(m), "right") - 1] = True  # a run over the end of a text costs a search
    return out


def scan(docs: DataFrame, least: float = 10.0, redact: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans (kind:start:end in code points, joined by
    commas, end exclusive); and, with ``redact``, clean_text: the text with that mark in place of each finding.

    Null text: empty, no findings. Texts are scanned whole. Rows that repeat are reported each; an empty table gives no
    rows. ``keep``: columns to carry along, but those named like a result, which gives way to the result; others are not
    read.
    """
    names = ["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"] + ["clean_text"] * (redact is not None)
    kept = [k for k in dict.fromkeys(keep) if k not in names]
    source = "_".join(["text", *kept])  # no column's name
    d = _io.small_batches(docs).select(*kept, F.coalesce("text", F.lit("")).alias(source))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            text = batch.column(source)
            data, off = _io.text_bytes(text)
            runs = _long_hex(data, off)
            rows = []
            for t, h in zip(text.to_pylist(), runs.tolist()):
                found = spans(t, least, h)
                clean = t
                if not found:
                    rows.append((0, 0, 0, 0, none, "", t))
                    continue
                n = [sum(k == j for _, k, _ in found) for j in range(4)]
                said = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in found]
                if redact is not None:
                    out, at = [], 0
                    for a, _, b in found:
                        if a >= at:
                            out += [t[at:a], redact]
                        at = max(at, b)
                    clean = "".join([*out, t[at:]])
                rows.append((*n, hashlib.sha256(",".join(s for k, s in said if k < 3).encode()).hexdigest(), ",".join(s for _, s in said), clean))
            cols = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4 : len(names)]]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + arrays, names=kept + names)

    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in kept), *(f"{x} long" for x in names[:4]), *(f"{x} string" for x in names[4:])])
    return d.mapInArrow(run, schema)


def op3_guess_cost_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(_io.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")
