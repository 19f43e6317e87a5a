"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that give exactly one id need no merges when they are met
as a pre-token. Texts of any script are split here (see pretokens). A text's count is its number of pre-tokens plus what the pre-tokens outside that set have beyond one;
only these are merged, by the library, each distinct one once while it is remembered.

Defined cases: null text is empty and has 0 bytes and 0 tokens; rows are counted one by one, repeated or not; null
doc_ids stay; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import json
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .pretokens import REMEMBERED, pretokens, slices

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """The strings proven to be one token when they are a pre-token. At most one for each vocabulary entry."""
    p, letter = pretokens(path), byte_letters()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, asked = model.get("end_of_word_suffix") or "", {}
    for token, k in model["vocab"].items():
        if token.endswith(end):
            raw = token[: len(token) - len(end)] if end else token
            try:
                asked[bytes(letter[c] for c in raw).decode()] = k
            except (KeyError, UnicodeDecodeError):
                continue
    found = p.tokenizer.encode_batch(list(asked), add_special_tokens=False)
    return frozenset(s for (s, k), e in zip(asked.items(), found, strict=True) if e.ids == [k] and p.split(s) == [s])


def _counter(path: str, whole, limit: int):
    def count(batches):
        p, single = pretokens(path), whole.value
        more: dict[str, int] = p.__dict__.setdefault("more", {})  # beyond one, of pre-tokens that need merges
        for b in batches:
            out = []
            for some in slices(b.column(1).to_pylist()):
                found = [(t or "", p.split(t or "")) for t in some]
                rest = [None if f is None else list(filterfalse(single.__contains__, f)) for _, f in found]
                words = set().union(*(r for r in rest if r))
                unseen = words.difference(more)
                if len(more) + len(unseen) > REMEMBERED:
                    more.clear()
                    unseen = words
                asked = list(unseen)
                more.update((w, len(x) // 4 - 1) for w, x in zip(asked, p.encode(asked), strict=True))
                for (t, f), r in zip(found, rest, strict=True):
                    n = len(p.tokenizer.encode(t, add_special_tokens=False).ids) if f is None else len(f) + sum(map(more.__getitem__, r))
                    out.append((len(t.encode()), n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64()), pa.array([n > limit for _, n in out], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))  # no more than the vocabulary
    return texts(docs).mapInArrow(_counter(tokenizer, whole, limit), COUNTED)
