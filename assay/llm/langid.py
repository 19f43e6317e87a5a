"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums of learned weights of its affixes (the first and last one to three letters), its
letter bigrams and trigrams with word edges, and lexicon features (the word itself, and in which languages' training
lexicons it occurs). Learned transitions tie neighbouring words, so that code-switched text is labelled in runs.
Forward-backward gives each word a posterior for each language; a text's language has the largest mean posterior.

Training: of each language at most `sample` distinct texts, the first by a hash of the text, and of each its first
`chars` characters (fewer with over 20 languages, see WORK), from documents with a language whose crc32(doc_id as text) mod 5 is not 0. Their words, cut into runs and joined
across languages, make the code-switched chains that the transitions are learned from. Weights are hashed into 2^BITS
rows, so the model's size depends on the number of languages alone.

Forward-backward is exact over chains of any length: the words of many texts form one chain in which each text starts
with a reset; products of transition matrices over blocks give the vectors at the blocks' edges, and within blocks all
blocks advance together.

Defined cases: null text, text without letters: `und`, score 0; ties go to the language first by name; without a
training document every text is `und`; rows are labelled one by one, repeated or not; null doc_ids are not held out
and don't train; other columns play no part.
"""

from __future__ import annotations

import functools
import random
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, widened
from .pretokens import slices

SAMPLE = 120
SAMPLE_CHARS = 20_000
#: Characters times languages that one text of each language may bring to training: with very many languages, texts
#: train by shorter starts, so that the driver's memory has a bound.
WORK = 80_000_000
BITS = 17
STEPS = 40
BLOCK = 256
#: Letters of a word that its identity goes by, with its length; affixes and n-grams cover the rest of longer words.
IDENTITY = 24
#: Characters labelled at a time.
SLICE = 1_500_000
#: Distinct words whose scores a Python worker remembers.
REMEMBERED = 250_000
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"

find_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # (2^BITS, languages)
    moves: np.ndarray  # (languages, languages) transition scores
    first: np.ndarray  # (languages,) scores of a text's first word
    lexicon: dict[str, int]  # word: bits of the languages that have it


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@functools.lru_cache(maxsize=65_536)
def _places(bits: int) -> tuple[int, ...]:
    """The places of the bits that are set, of an integer of any size."""
    return tuple(j for j in range(bits.bit_length()) if bits >> j & 1)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all words' features one after the other, where each word's begin)."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(n + 2)])[:-1]
    word = np.repeat(np.arange(len(words)), n + 2)
    place = np.arange(len(text)) - begin[word]
    k = np.uint64(0x1000193)
    two = text[:-1] * k + text[1:]
    three = two[:-1] * k + text[2:]
    rows, owner = [], []

    def add(hashed: np.ndarray, kind: int, of: np.ndarray) -> None:
        rows.append(_mix(hashed, kind))
        owner.append(of)

    ok = place[:-1] < n[word[:-1]] + 1
    add(two[ok], 1, word[:-1][ok])
    ok = place[:-2] < n[word[:-2]]
    add(three[ok], 2, word[:-2][ok])
    every = np.arange(len(words))
    ends = begin + n  # the last letter's place
    pre = np.zeros(len(words), np.uint64)
    suf = np.zeros(len(words), np.uint64)
    for j in range(1, 4):
        has = every[n >= j]
        pre = pre * k + text[np.minimum(begin + j, len(text) - 1)]
        suf = suf * k + text[np.maximum(ends - j + 1, 0)]
        add(pre[has], 10 + j, has)
        add(suf[has], 20 + j, has)
    whole = np.zeros(len(words), np.uint64)
    for j in range(min(IDENTITY, int(n.max()) if len(n) else 0)):
        has = n > j
        whole[has] = whole[has] * k + text[begin[has] + 1 + j]
    add(whole + n.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D), 30, every)
    known = [(i, j) for i, w in enumerate(words) if (bits := lexicon.get(w)) for j in _places(bits)]
    if known:
        has, lang = np.array(known, np.int64).T
        add(lang.astype(np.uint64) + np.uint64(1), 40, has)
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(words))
    return rows[order], np.concatenate([[0], np.cumsum(count)])[:-1]


def emissions(words: list[str], m: Model) -> np.ndarray:
    if not words:
        return np.zeros((0, len(m.langs)))
    rows, begin = features(words, m.lexicon)
    return np.add.reduceat(m.weights[rows], begin, axis=0)


def forward_backward(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray, want_moves: bool = False):
    """Posteriors (words, languages) of chains laid end to end; starts marks each chain's first word.

    With want_moves also the expected number of each move."""
    n, k = scores.shape
    size = min(BLOCK, max(1, int(n**0.5)))
    blocks = -(-n // size)
    e = np.ones((blocks * size, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    s = np.zeros(blocks * size, bool)
    s[:n] = starts
    if n < len(s):
        s[n] = True
    e, s = e.reshape(blocks, size, k).transpose(1, 0, 2).copy(), s.reshape(blocks, size).T[:, :, None].copy()
    t, pi = np.exp(moves - moves.max()), np.exp(first - first.max())
    p = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(size):
        p = np.where(s[i][:, :, None], p.sum(axis=2, keepdims=True) * pi, p @ t) * e[i][:, None, :]
        p /= p.max(axis=(1, 2), keepdims=True)
    a, b = np.ones((blocks, k)) / k, np.ones((blocks, k)) / k
    for c in range(blocks - 1):
        x = a[c] @ p[c]
        a[c + 1] = x / x.sum()
    for c in range(blocks - 1, 0, -1):
        x = p[c] @ b[c]
        b[c - 1] = x / x.sum()
    alpha = np.empty((size + 1, blocks, k))
    alpha[0] = a
    for i in range(size):
        x = np.where(s[i], pi, alpha[i] @ t) * e[i]
        alpha[i + 1] = x / x.sum(axis=1, keepdims=True)
    post, moved = np.empty((size, blocks, k)), np.zeros((k, k))
    for i in range(size - 1, -1, -1):
        x = alpha[i + 1] * b
        post[i] = x / x.sum(axis=1, keepdims=True)
        eb = e[i] * b
        x = eb @ t.T
        if want_moves:
            z = (alpha[i] * x).sum(axis=1, keepdims=True)
            moved += (np.where(s[i], 0, alpha[i] / z)).T @ eb * t
        b = np.where(s[i], (pi * eb).sum(axis=1, keepdims=True), x)
        b /= b.sum(axis=1, keepdims=True)
    return post.transpose(1, 0, 2).reshape(-1, k)[:n], moved


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Model:
    """rows: (text, language). The model of the most likely labels, by Adam over all words at each step."""
    langs = sorted({lang for _, lang in rows})
    of = {lang: j for j, lang in enumerate(langs)}
    k, pick = len(langs), random.Random(seed)
    lexicon: dict[str, int] = {}
    runs: list[tuple[int, list[str]]] = []
    for text, lang in sorted(rows):
        words, at = words_of(text), 0
        for w in words:
            lexicon[w] = lexicon.get(w, 0) | 1 << of[lang]
        while at < len(words):
            n = pick.randint(4, 60)
            runs.append((of[lang], words[at : at + n]))
            at += n
    if not runs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), {})
    # half of the lexicon's marks are withheld while training, or the other features would learn nothing
    shown = {w: bits for w, bits in lexicon.items() if pick.random() < 0.5}
    pick.shuffle(runs)
    kinds = {w: j for j, w in enumerate(sorted(lexicon))}
    word = np.array([kinds[w] for _, ws in runs for w in ws])
    label = np.array([j for j, ws in runs for _ in ws])
    starts = np.zeros(len(word), bool)
    at = 0
    for j, (_, ws) in enumerate(runs):
        starts[at] = j % 8 == 0
        at += len(ws)
    feats, begin = features(list(kinds), shown)
    per = np.diff(np.concatenate([begin, [len(feats)]]))
    truth = np.zeros((len(kinds), k))
    np.add.at(truth, (word, label), 1)
    inner = ~starts
    inner[0] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    begun = np.bincount(label[starts], minlength=k).astype(float)
    w, moves, first = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
    means = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves, first)]
    used = np.unique(feats)
    for step in range(1, steps + 1):
        scores = np.add.reduceat(w[feats], begin, axis=0)
        post, moved = forward_backward(scores[word], starts, moves, first, True)
        off = truth - np.stack([np.bincount(word, post[:, j], len(kinds)) for j in range(k)], axis=1)
        spread = np.repeat(off, per, axis=0)
        g = np.stack([np.bincount(feats, spread[:, j], 1 << BITS) for j in range(k)], axis=1)
        n = len(word)
        slopes = (g / n - 1e-7 * w, (seen - moved) / n, (begun - post[starts].sum(axis=0)) / max(1, starts.sum()))
        for x, gx, (m1, m2), rows_ in zip((w, moves, first), slopes, means, (used, slice(None), slice(None)), strict=True):
            m1[rows_] = 0.8 * m1[rows_] + 0.2 * gx[rows_]
            m2[rows_] = 0.98 * m2[rows_] + 0.02 * gx[rows_] ** 2
            x[rows_] += 0.2 * (m1[rows_] / (1 - 0.8**step)) / (np.sqrt(m2[rows_] / (1 - 0.98**step)) + 1e-7)
    return Model(langs, w.astype(np.float32), moves, first, lexicon)


class Labeller:
    """Labels texts; remembers the scores of words met before."""

    def __init__(self, model: Model):
        self.m, self.index = model, {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)
        self.n = 0

    def _learn(self, words: set[str]) -> None:
        unseen = words.difference(self.index)
        if len(self.index) + len(unseen) > REMEMBERED:
            self.index.clear()
            self.n, unseen = 0, words
        if unseen:
            asked = list(unseen)
            for lo in range(0, len(asked), 20_000):
                part = asked[lo : lo + 20_000]
                if self.n + len(part) > len(self.scores):
                    grown = np.zeros((max(65_536, 2 * (self.n + len(part))), self.scores.shape[1]), np.float32)
                    grown[: self.n] = self.scores[: self.n]
                    self.scores = grown
                self.scores[self.n : self.n + len(part)] = emissions(part, self.m)
                self.index.update(zip(part, range(self.n, self.n + len(part)), strict=True))
                self.n += len(part)

    def posteriors(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors of all words of texts that have words, the first word's place of each such text)."""
        self._learn(set().union(*found))
        flat = [w for f in found for w in f]
        ids = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        begin = np.cumsum([0, *(len(f) for f in found if f)])[:-1]
        starts = np.zeros(len(flat), bool)
        starts[begin] = True
        return forward_backward(self.scores[ids].astype(np.float64), starts, self.m.moves, self.m.first)[0], begin

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for some in slices(texts, SLICE * 4 // max(4, len(self.m.langs))):
            found = [words_of(t) for t in some]
            if not self.m.langs or not any(found):
                out += [("und", 0.0)] * len(some)
                continue
            post, begin = self.posteriors(found)
            n = np.array([len(f) for f in found if f])
            mean = np.add.reduceat(post, begin, axis=0) / n[:, None]
            best = np.round(mean, 12).argmax(axis=1)
            each = iter(zip(best, mean[np.arange(len(best)), best], strict=True))
            for f in found:
                out.append((self.m.langs[(x := next(each))[0]], float(min(1.0, x[1]))) if f else ("und", 0.0))
        return out

    def runs(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words labelled alike; places in the lower-cased text."""
        at = [m.span() for m in re.finditer(r"[^\W\d_]+", text.lower())]
        if not at or not self.m.langs:
            return []
        best = self.posteriors([words_of(text)])[0].argmax(axis=1)
        out: list[tuple[int, int, str]] = []
        for (lo, hi), j in zip(at, best, strict=True):
            if out and out[-1][2] == self.m.langs[j]:
                out[-1] = (out[-1][0], hi, out[-1][2])
            else:
                out.append((lo, hi, self.m.langs[j]))
        return out


_labellers: dict[int, Labeller] = {}


def _labeller(shared) -> Labeller:
    key = shared.value.weights.ctypes.data
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(shared.value)
    return _labellers[key]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """sample: distinct texts of a language that train at most; chars: characters of each, from its start."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    some = some.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    one = some.select("lang", F.xxhash64("text").alias("h"), "doc_id").groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    # in two steps, so that a language of a third of all rows isn't gathered in one task
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        one = one.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= sample).drop("r")
    chosen = one.select("doc_id", "lang").collect()
    langs = len({r.lang for r in chosen})
    chars = max(40, min(chars, WORK // max(1, langs * langs * sample)))
    rows = some.filter(F.col("doc_id").isin([r.doc_id for r in chosen])).groupBy("doc_id", "lang").agg(F.min(F.substring("text", 1, chars)).alias("text")).select("text", "lang").collect() if chosen else []
    return fit([(r.text, r.lang) for r in rows])


def _predict(shared):
    def predict(batches):
        label = _labeller(shared)
        for b in batches:
            got = label.documents(b.column(b.schema.get_field_index("text")).to_pylist())
            cols = [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "lang_pred", "lang_score"])

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs, which has a string column text, with lang_pred and lang_score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared), widened(docs.schema, "lang_pred string, lang_score double"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    model = train(docs, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
