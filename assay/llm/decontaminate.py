"""Benchmark decontamination by an FM-index of each training shard.

Words are runs of [0-9a-z] and of any non-ASCII characters, after lowering A-Z. A shard is a bounded run of documents.
Its text is the sequence of its words' numbers in the benchmark's vocabulary, cut wherever a word is not in it, as no
benchmark window spans such a word; runs shorter than the shortest window can't hold one and are left out, so that
the index holds every place where a window can occur and little else. The suffix array comes from prefix doubling;
its Burrows-Wheeler transform lies in a wavelet matrix. All windows are searched backwards together, two ranks for
each word and level; occurrences are located by walking to sampled suffix positions. The word spans of all
occurrences are merged into removal spans.

The benchmark is dealt into blocks of at most BLOCK_BYTES of text by Spark; a block's windows are arrays of some 60 bytes
a word, its vocabulary some 150 bytes a distinct word. Each block is searched by itself and the spans of all blocks are
merged, so that what the driver and a worker hold doesn't grow with the benchmark.

Defined cases: null text has no words; an item without words occurs nowhere; items with equal text occur alike; null
item_ids are left out; repeated documents are searched each; empty tables give no rows, or rows without hits; other
columns play no part.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, texts, widened

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words of documents that one index covers before the runs are filtered (a longer document has one of its own).
SHARD_WORDS = 1_000_000
SAMPLED = 8
FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"

_is_word = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_fold = bytes(b + 32 if 65 <= b <= 90 else b if b in _is_word else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_fold).split() if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane a level, highest bit first, zeros before ones below it."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        lo = np.zeros_like(i)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            before, low = self.ones[k][i], self.ones[k][lo]
            i = np.where(one, self.zeros[k] + before, i - before)
            lo = np.where(one, self.zeros[k] + low, lo - low)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            one = self.ones[k][i + 1] - self.ones[k][i]
            out = out << 1 | one
            i = np.where(one == 1, self.zeros[k] + self.ones[k][i], i - self.ones[k][i])
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Of a sequence whose last symbol is its only smallest, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FmIndex:
    """Of runs of words (numbers from 1), for searches within runs."""

    def __init__(self, text: np.ndarray, runs: np.ndarray, symbols: int):
        """text: the runs one after the other; runs: where each begins."""
        n, r = len(text), len(runs)
        ends = np.append(runs[1:], n)
        # run k is followed by a separator of its own, smaller than any word, so that no order needs a look beyond it
        whole = np.empty(n + r, np.int64)
        at = np.arange(n) + np.repeat(np.arange(r), ends - runs)
        whole[at] = text + r
        whole[ends + np.arange(r)] = np.arange(r)[::-1]
        order = suffix_array(whole)
        word = np.zeros(n + r, np.int64)
        word[at] = text
        first = np.zeros(n + r, bool)
        first[runs + np.arange(r)] = True
        before = np.where(first[order], 0, word[order - 1])  # a run's first word has a separator before it
        count = np.bincount(word, minlength=symbols + 1)
        self.below = np.concatenate([[0], np.cumsum(count)])[: symbols + 1]
        self.matrix = WaveletMatrix(before, max(1, int(symbols).bit_length()))
        source = np.full(n + r, -1, np.int64)
        source[at] = np.arange(n)
        offset = np.zeros(n + r, np.int64)
        offset[at] = np.arange(n) - np.repeat(runs, ends - runs)
        kept = (source >= 0) & (offset % SAMPLED == 0)
        self.sampled = kept[order]
        self.place = np.cumsum(self.sampled) - 1
        self.at = source[order[self.sampled]]
        self.n = n + r

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of windows: rows of word numbers, padded on the left with 0."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[:, j]
            on = np.nonzero((c > 0) & (lo < hi))[0]
            if len(on):
                c = c[on]
                lo[on] = self.below[c] + self.matrix.rank(c, lo[on])
                hi[on] = self.below[c] + self.matrix.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin in the text of runs."""
        out, row, on, walked = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(on):
            hit = self.sampled[row]
            out[on[hit]] = self.at[self.place[row[hit]]] + walked
            on, row = on[~hit], row[~hit]
            if len(on):
                c = self.matrix.access(row)
                row = self.below[c] + self.matrix.rank(c, row)
            walked += 1
        return out


class Windows:
    """A block of items: its vocabulary, its distinct windows and the items that have each, as arrays."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        number: dict[bytes, int] = {}
        words = [np.fromiter((number.setdefault(x, len(number) + 1) for x in words_of(text)), np.int32) for _, text in items]
        self.number = number
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate([np.zeros(WINDOW, np.int32), *words, np.zeros(0, np.int32)])  # zeros pad windows on the left
        per = np.where(sizes > 0, np.maximum(1, sizes - WINDOW + 1), 0)
        of = np.repeat(np.arange(len(sizes)), per)
        first = WINDOW + np.repeat(np.cumsum(sizes) - sizes, per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        length = np.minimum(sizes[of], WINDOW)
        rows = np.zeros((len(of), WINDOW), np.int32)
        for j in range(WINDOW):
            back = WINDOW - j  # the column holds the word that is so far before the window's end
            rows[:, j] = np.where(back <= length, flat[first + length - back], 0)
        key = rows.view(np.dtype((np.void, rows.itemsize * WINDOW))).ravel()
        order = np.argsort(np.unique(key, return_inverse=True)[1], kind="stable")
        opens = np.concatenate([np.ones(min(1, len(key)), bool), key[order][1:] != key[order][:-1]])
        self.rows, self.length = rows[order][opens], length[order][opens]
        self.shortest = int(self.length.min()) if len(self.length) else 0
        # items of each window: those of the rows from its first on
        self.owner, self.begin = of[order].astype(np.int32), np.append(np.nonzero(opens)[0], len(key))

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in dict.fromkeys(self.owner[self.begin[window] : self.begin[window + 1]].tolist())]


def _search(found: list[list[bytes]], block: Windows) -> list[tuple[list[tuple[int, int]], list[str]]]:
    none: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in found]
    if not len(block.rows):
        return none
    get, sizes = block.number.get, [len(f) for f in found]
    ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, f, repeat(0)), np.int64, len(f)) for f in found if f)])
    base = np.concatenate([[0], np.cumsum(sizes)])
    cut = ids == 0
    first = ~cut
    first[1:] &= cut[:-1] | np.isin(np.arange(1, len(ids)), base)
    begin = np.nonzero(first)[0]
    if not len(begin):
        return none
    stop = np.minimum(np.append(begin[1:], len(ids)), _next_cut(cut, begin))
    long = stop - begin >= block.shortest
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return none
    n = stop - begin
    runs = np.cumsum(n) - n
    source = np.arange(int(n.sum())) + np.repeat(begin - runs, n)
    index = FmIndex(ids[source], runs, len(block.number))
    lo, hi = index.search(block.rows.astype(np.int64))
    hits = np.nonzero(hi > lo)[0]
    times = (hi - lo)[hits]
    if not len(hits):
        return none
    rows = np.arange(int(times.sum())) + np.repeat(lo[hits] - (np.cumsum(times) - times), times)
    window = np.repeat(hits, times)
    at = source[index.locate(rows)]
    doc = np.searchsorted(base, at, side="right") - 1
    order = np.lexsort((at, doc))
    spans: list[list[list[int]]] = [[] for _ in found]
    items: list[dict[str, None]] = [{} for _ in found]
    for d, s, w in zip(doc[order].tolist(), (at - base[doc])[order].tolist(), window[order].tolist(), strict=True):
        e, have = s + int(block.length[w]), spans[d]
        if have and s <= have[-1][1]:
            have[-1][1] = max(have[-1][1], e)
        else:
            have.append([s, e])
        items[d].update(dict.fromkeys(block.items(w)))
    return [([(s, e) for s, e in have], list(i)) for have, i in zip(spans, items, strict=True)]


def _next_cut(cut: np.ndarray, begin: np.ndarray) -> np.ndarray:
    at = np.nonzero(cut)[0]
    k = np.searchsorted(at, begin)
    return np.append(at, len(cut))[k]


def _finder(shared):
    def find(batches):
        block: Windows = shared.value
        for b in batches:
            column, done, have, shard, size = b.column(b.schema.get_field_index("text")).to_pylist(), 0, [], [], 0

            def flush(b=b, have=have):
                nonlocal shard, size, done
                got = _search(shard, block)
                cols = [c.slice(done, len(shard)) for c in b.columns]
                n = pa.array([len(f) for f in shard], pa.int64())
                spans = pa.array([[{"start": s, "end": e} for s, e in x] for x, _ in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                items = pa.array([i for _, i in got], pa.list_(pa.string()))
                have.append(pa.RecordBatch.from_arrays([*cols, n, spans, items], [*b.schema.names, "n_words", "spans", "items"]))
                done, shard, size = done + len(shard), [], 0

            for t in column:
                w = words_of(t)
                if shard and size + len(w) > SHARD_WORDS:
                    flush()
                shard.append(w)
                size += len(w)
            if shard:
                flush()
            yield from have

    return find


def blocks(bench: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark's items in blocks of bounded size, one at a time on the driver."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter(F.col("item").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for k in range(n):
        some = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in some.distinct().collect()]


def find(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, which has a string column text, with n_words, spans (merged word spans to remove) and items (that occur)."""
    spark, out, names = docs.sparkSession, None, docs.columns
    ship(spark)
    schema = widened(docs.schema, FOUND)
    for block in blocks(bench, block_bytes):
        shared = spark.sparkContext.broadcast(Windows(block))
        if out is None:
            out = docs.mapInArrow(_finder(shared), schema)
        else:  # a further block: its finds join those of the blocks before, row by row
            more = out.withColumns({"_n": F.col("n_words"), "_s": F.col("spans"), "_i": F.col("items")}).drop("n_words", "spans", "items")
            both = more.mapInArrow(_finder(shared), widened(more.schema, FOUND))
            out = both.select(*names, "n_words", merged(F.array_sort(F.concat("_s", "spans"))).alias("spans"), F.array_distinct(F.concat("_i", "items")).alias("items"))
    return out


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap joined."""
    empty = F.expr("cast(array() as array<struct<start:long,end:long>>)")

    def step(have: Column, x: Column) -> Column:
        last = F.element_at(have, -1)
        return F.when((F.size(have) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(have, 1, F.size(have) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))).otherwise(F.concat(have, F.array(x)))

    return F.aggregate(spans, empty, step)


def contamination(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated, and the spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = find(texts(docs), bench, block_bytes).withColumn("n_hit", n_hit)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")
