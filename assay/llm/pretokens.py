"""Exact encoding by pre-tokens, over the tokenizers library.

BPE never merges across a pre-token's edge, so a text's ids are those of its pre-tokens in order. Each distinct
pre-token is encoded by the library once and remembered. The split done here goes by the Unicode classes that Python
has; it agrees with the library's on every assigned character (a test goes through them all). The library encodes whole
what the split isn't proven for: texts with unassigned characters, whose class depends on the version of Unicode, with a
string of an added token, or whose lower-cased form isn't composed.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

# The Latin-1 members of the Unicode classes L, N and White_Space.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼½¾"
SPACE = "\\t-\\r \u0085\u00a0"
# The members of White_Space beyond Latin-1.
WIDE_SPACE = SPACE + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CLITIC = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_split(letter: str, number: str, space: str) -> str:
    return f"{CLITIC}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def word_split(letter: str, number: str, space: str) -> str:
    return f"{CLITIC}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"


@functools.lru_cache(maxsize=1)
def wide_classes() -> tuple[str, str, frozenset[str]]:
    """The ranges of all letters and of all numbers, and the unassigned characters, by Python's Unicode."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    unassigned = []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind == "Cn":
            unassigned.append(chr(c))
        elif kind[0] in ranges:
            have = ranges[kind[0]]
            if have and have[-1][1] == c - 1:
                have[-1][1] = c
            else:
                have.append([c, c])
    letters, numbers = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in ranges[k]) for k in "LN")
    return letters, numbers, frozenset(unassigned)


#: Distinct pre-tokens remembered by one Python worker, some 200 bytes each. A full memory starts anew.
REMEMBERED = 300_000
#: Characters split at a time; so few that their pre-tokens stay in a core's cache between the split and the lookup.
SLICE = 30_000
#: Words of a joined text.
LINES = 64


class Pretokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        steps = [(p["type"], p.get("pattern", {}).get("Regex")) for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        bpe = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        if bpe and kind == "ByteLevel" and spec["normalizer"] is None and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.lower, self.splitter = False, byte_split
        elif bpe and norm == ["NFC", "Replace", "Lowercase"] and steps == [("Split", CLITIC + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)]:
            self.lower, self.splitter = True, word_split
        else:
            self.lower, self.splitter = False, None
        self.find = re.compile(self.splitter(LETTER, NUMBER, SPACE)).findall if self.splitter else None
        self.memory: dict[str, bytes] = {}
        self.remembered = REMEMBERED
        self.ends = None  # which ids end a line (of the byte-level kind) or a word
        if self.find:
            suffix = spec["model"].get("end_of_word_suffix")
            if self.lower and suffix or not self.lower and not suffix:
                line = self.tokenizer.encode("\n", add_special_tokens=False).ids
                self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
                self.ends[[k for t, k in spec["model"]["vocab"].items() if t.endswith(suffix)] if self.lower else line] = True

    @functools.cached_property
    def find_wide(self):
        letters, numbers, _ = wide_classes()
        return re.compile(self.splitter(letters, numbers, WIDE_SPACE)).findall

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where only the library may split."""
        if self.find is None or self.added.search(text):
            return None
        find = self.find
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                find = self.find_wide
                if not wide_classes()[2].isdisjoint(set(text)):
                    return None
                if self.lower:  # the library lowers characters one by one, so a sigma at a word's end is like any other
                    text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        if self.lower:
            text = text.lower()
            if find is not self.find and not unicodedata.is_normalized("NFC", text) or self.added.search(text):
                return None
        return find(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, each encoded alone. Words of letters go through the library as lines of joined texts,
        whose ids fall apart again at the line ends or at the ids that end words."""
        if self.ends is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(words)
        plain = [k for k, w in enumerate(words) if w[w[0] == " " :].isalpha()]
        rest = [k for k, w in enumerate(words) if not w[w[0] == " " :].isalpha()]
        lines = [plain[lo : lo + LINES] for lo in range(0, len(plain), LINES)]
        joined = ["".join([words[k] + "\n" for k in some]) for some in lines]
        for some, e in zip(lines, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            a = np.array(e.ids, "<u4")
            at = np.nonzero(self.ends[a])[0] + 1
            if len(at) != len(some) or at[-1] != len(a):
                rest += some
                continue
            raw, drop = a.tobytes(), 0 if self.lower else 4
            edge = [0, *(4 * at).tolist()]
            for j, k in enumerate(some):
                out[k] = raw[edge[j] : edge[j + 1] - drop]
        for lo in range(0, len(rest), 20_000):
            some = rest[lo : lo + 20_000]
            for k, e in zip(some, self.tokenizer.encode_batch([words[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, in order; null counts as empty."""
        for some in slices(texts):
            found = [self.split(t or "") for t in some]
            words = set().union(*(f for f in found if f))
            unseen = words.difference(self.memory)
            if unseen:
                if len(self.memory) + len(unseen) > self.remembered:
                    self.memory.clear()
                    unseen = words
                asked = list(unseen)
                self.memory.update(zip(asked, self.encode(asked), strict=True))
            get = self.memory.__getitem__
            for text, f in zip(some, found, strict=True):
                yield self.whole(text or "") if f is None else b"".join(map(get, f))


def slices(texts: list[str | None], limit: int = SLICE) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


@functools.lru_cache(maxsize=4)
def pretokens(path: str) -> Pretokens:
    """One per path and Python process; workers that Spark uses again keep theirs."""
    return Pretokens(path)
