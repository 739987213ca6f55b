"""The tokenizers library behind a memo of words, and ids back to bytes."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from roadcut.llm import _seq

BPE = "byte_bpe_50k.json"
#: A space before a character that isn't white space starts a new piece of the byte-level pattern, whatever stands around it.
CUT = re.compile(r" (?=[^\s\x1c-\x1f\x85᠎])")
_ODD = re.compile(r" (?=[\s\x1c-\x1f\x85᠎]|$)")


def vocabulary(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space of Latin-1 besides the space and the line feed.
_FEW = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Words in whose letters, digits and marks all versions of Unicode agree.
_MARKS = r"A-Za-z0-9À-ÖØ-öø-ÿ.,;:!?'\"()\[\]{}%&*#$|<>=/_+@^~-"
_PLAIN, _PLAIN_LINE = re.compile(f"[{_MARKS}]+"), re.compile(f"[ {_MARKS}]+")


def _merger(library, name: str):
    """A faster merger of the same vocabulary (tiktoken), or None. It merges by the rank of the result; that is the same
    as by the rank of the merge where each merge made the next id, which is checked."""
    import public_tokenizers
    import tiktoken

    d = json.loads(library.to_str())
    model, before = d["model"], d["pre_tokenizer"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    made = [model["vocab"].get(a + b) for a, b in merges]
    same = d["normalizer"] is None and before and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if not same or None in made or made != list(range(256, 256 + len(made))) or len(model["vocab"]) not in (len(made) + 256, len(made) + 257):
        return None
    byte = byte_of()
    special = {t["content"] for t in d["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_of() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for: bytes that print stand for themselves, the
    others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them with
    add_special_tokens=False. Words behind a space are encoded once each while they stay in the memo, which holds those
    of the last two times ``most`` words; new plain words go through a faster merger of the library's own vocabulary."""

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merger = _merger(self.library, path)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most
        self.line_feed = self.library.encode("\n", add_special_tokens=False).ids[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 8192):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False)]
        return out

    def _merged(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.merger.encode_ordinary(t), "<u4").tobytes() for t in texts]

    def _learn(self, words: list[str]) -> None:
        other = words
        if self.merger is not None:
            other = []
            for i in range(0, len(words), 1000):
                part = words[i : i + 1000]
                said = " ".join(part)
                if _PLAIN_LINE.fullmatch(said) is None or "<|" in said:
                    other += [w for w in part if _PLAIN.fullmatch(w) is None or "<|" in w]
                    part = [w for w in part if _PLAIN.fullmatch(w) is not None and "<|" not in w]
                self._lines(part, self._merged)
        odd = [w for w in other if "\n" in w or "<|" in w]
        self.memo.update(zip(odd, self._whole([" " + w for w in odd])))
        self._lines([w for w in other if not ("\n" in w or "<|" in w)], self._whole)

    def _lines(self, plain: list[str], encode) -> None:
        """Many words in one call, a line each: a line feed before a space is a piece of its own."""
        parts = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for part, raw in zip(parts, encode([" " + "\n ".join(p) for p in parts])):
            ids = np.frombuffer(raw, "<u4")
            end = [*(np.flatnonzero(ids == self.line_feed) * 4).tolist(), len(raw)]
            if len(end) != len(part):
                raise ValueError("the vocabulary joins line feeds with words")
            start = [0, *(e + 4 for e in end[:-1])]
            self.memo.update((w, raw[a:b]) for w, a, b in zip(part, start, end))

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before each CUT; a piece but the first lacks its leading space."""
        parts = text.split(" ")
        if "" not in parts and " \n" not in text and _latin(text) and not any(c in text for c in _FEW):
            return parts
        if _ODD.search(text) is None:
            return parts
        out, at = [], 0
        for m in CUT.finditer(text):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}
        memo, cut = self.memo, [self.pieces(t) for t in texts]
        wanted: set[str] = set()
        for c in cut:
            wanted.update(c[1:])
        wanted.difference_update(memo.keys())
        known = wanted & self.old.keys()
        memo.update((w, self.old[w]) for w in known)
        self._learn(list(wanted - known))
        first = list({c[0] for c in cut})
        head = dict(zip(first, self._whole(first)))
        get = memo.__getitem__
        return [head[c[0]] + b"".join(map(get, c[1:])) for c in cut]


class Decoder:
    """Bytes of ids: the byte-level alphabet writes each byte of a token as one character."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        byte = byte_of()
        words = t.get_vocab(with_added_tokens=True)
        table: list[bytes] = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            table[i] = bytes(map(byte.__getitem__, w)) if all(c in byte for c in w) else w.encode()
        self.size = np.array([len(b) for b in table], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; malformed sequences are replaced as the library does."""
        out = self.flat[_seq.gather(self.at[ids], self.size[ids])].tobytes()
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


@lru_cache(2)
def encoder(path: str, most: int = 200_000) -> Encoder:
    """A worker's own; it stays when the task ends."""
    return Encoder(path, most)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)
