"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct shingles of n words (all words as one shingle if it has fewer). Documents with equal
word sequences have equal sets: they collapse to one node before anything is compared, so a group of copies costs a row
each. Each node's set is hashed once; the hash gives a bin and a value, a bin keeps its least value, and an empty bin
copies a bin that isn't, tried in an order that depends on the bins' numbers alone (optimal densification). BANDS bands
of ROWS bins are buckets.

Candidates are stars, never all pairs. A node's weight is the number of others that it meets, summed over its buckets:
what lies in the middle of a family meets most. The first star of a bucket has its heaviest member as centre. Where a
bucket's members aren't one class after that, STARS more centres, drawn by weight and a hash of their own, are compared
with its members of other classes. So candidates are at most (1 + STARS) for each membership of a bucket, whatever the
size of a family, and there are two passes, whatever the classes. All candidates are confirmed on the full sets.

What can be missed: a pair of similarity s shares no bucket with probability (1 - s^ROWS)^BANDS, 1.2e-5 at 0.8, 1e-8 at
0.85; and a document whose only links go to members of its buckets that are centres of none of them. README has the
measured share of both.

Defined cases: null text or no words: an empty set, linked with nothing, its own class; each row is a document, so rows
that repeat a doc_id with equal words are copies, and with other words are documents of their own that have the same
doc_id; null doc_ids are left out; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, texts, written
from .components import components

BANDS, ROWS = 48, 7
BINS = BANDS * ROWS
#: Further centres of a bucket whose members aren't one class.
STARS = 4
#: Word hashes remembered by a Python worker.
REMEMBERED = 200_000
SIGNED = "doc_id long, same binary, n_shingles long, bands array<long>"

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _B
    h = (h ^ (h >> _U(27))) * _C
    return h ^ (h >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, _U(n))
    for j in range(n):
        out = _mix(out * _A + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def _tries() -> np.ndarray:
    """For each bin, the bins that it copies from, in order of trial; at least one of them is never empty."""
    order = np.empty((BINS, BINS), np.int64)
    for b in range(BINS):
        order[b] = np.argsort(_mix(np.arange(BINS, dtype=np.uint64) * _A + _U(b * 7919 + 13)), kind="stable")
    return order


_order = _tries()


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS values of a set that isn't empty."""
    h = _mix(hashes ^ _U(0x5851F42D4C957F2D))
    bins = ((h >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    none = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(BINS, none)
    np.minimum.at(out, bins, _mix(h + _A))
    empty = np.nonzero(out == none)[0]
    if len(empty):
        full = out != none
        source = np.empty(len(empty), np.int64)
        left = np.arange(len(empty))
        for tried in (_order[:, :24], _order):
            have = full[tried[empty[left]]]
            hit = have.any(axis=1)
            source[left[hit]] = tried[empty[left[hit]], have[hit].argmax(axis=1)]
            left = left[~hit]
            if not len(left):
                break
        out[empty] = out[source]
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """The bands' hashes of a signature."""
    s = s.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = _mix(out * _A + s[:, j])
    return out.astype(np.int64)


def _digest(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _signer(size: int):
    def sign(batches):
        for b in batches:
            same, n, keys = [], [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                h = shingles(w, size)
                n.append(len(h))
                same.append(_digest(w))
                keys.append(bands(signature(h)) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "n_shingles", "bands"])

    return sign


def _setter(size: int):
    def sets(batches):
        for b in batches:
            found = [words_of(t) for t in b.column(1).to_pylist()]
            made = [shingles(w, size).tobytes() for w in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(w) for w in found], pa.binary()), pa.array(made, pa.binary())], ["rep", "same", "shingles"])

    return sets


def _confirmer(percent: int):
    def confirm(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                h, g = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (h, g) if len(h) <= len(g) else (g, h)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(100 * both >= percent * (len(h) + len(g) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that are alike on their full sets. A centre's pairs may be many: their join has no
    aggregation beside it, so that Spark can split it."""
    theirs = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    both = theirs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    return both.select("u", "v", "su", "sv").mapInArrow(_confirmer(percent), "u long, v long")


def _able(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be alike at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _buckets(nodes: DataFrame) -> DataFrame:
    """(hash, node, n, weight): the members of buckets of two and more. A band's hash holds its number. What is counted
    or chosen of a bucket is written before it is joined, here and below, so that Spark can split a large bucket."""
    rows = nodes.select(F.explode("bands").alias("hash"), "node")
    shared = written(rows.groupBy("hash").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    members = written(rows.join(shared, "hash"), "members")
    weight = members.groupBy("node").agg(F.sum(F.col("m") - 1).alias("weight"))
    out = written(members.join(weight.join(nodes.select("node", F.col("n_shingles").alias("n")), "node"), "node").select("hash", "node", "n", "weight"), "buckets")
    remove(members, shared)
    return out


def _first_star(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of each bucket's heaviest member and the others."""
    centre = buckets.groupBy("hash").agg(F.max(F.struct("weight", F.xxhash64("node").alias("h"), F.col("node").alias("u"), F.col("n").alias("nu"))).alias("c"))
    met = buckets.join(written(centre.select("hash", "c.u", "c.nu"), "centres"), "hash").filter((F.col("u") != F.col("node")) & _able("n", "nu", percent))
    return met.select("u", F.col("node").alias("v")).distinct()


def _more_stars(buckets: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of further centres and members of other classes, where a bucket has several classes."""
    rows = written(buckets.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "classed")
    drawn = lambda j: (F.xxhash64("node", "hash", F.lit(j)).cast("double") / F.lit(2.0**63) + 1) * F.col("weight")
    centre = lambda j: F.max(F.struct(drawn(j).alias("key"), F.col("node").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu")))
    several = rows.groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.array(*(centre(j) for j in range(STARS))).alias("c")).filter("a < z")
    met = rows.join(written(several.select("hash", "c"), "centres"), "hash").select("node", "root", "n", F.explode(F.array_distinct(F.transform("c", lambda x: F.struct(x["u"].alias("u"), x["ru"].alias("ru"), x["nu"].alias("nu"))))).alias("c"))
    across = met.select("node", "root", "n", "c.*").filter((F.col("root") != F.col("ru")) & _able("n", "nu", percent))
    return across.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()


def links(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """nodes: (node, rep, same, n_shingles, bands). Confirmed links (u, v) between nodes, enough to join each class."""
    buckets = _buckets(nodes)
    ends = nodes.select("node", "rep", "same").join(buckets.select("node").distinct(), "node", "left_semi")
    # texts of documents that are in a shared bucket; of rows that repeat one with equal words, one
    some = docs.join(ends.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_setter(size), "rep long, same binary, shingles binary")
    sets = written(some.join(ends, ["rep", "same"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    sure = written(_confirmed(written(_first_star(buckets, percent), "pairs"), sets, percent), "confirmed")
    more = written(_confirmed(written(_more_stars(buckets, components(sure), percent), "pairs"), sets, percent), "links")
    remove(sets, buckets)
    return sure.unionByName(more)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (whether that is its own)."""
    rows = texts(docs).filter(F.col("doc_id").isNotNull())
    signed = written(rows.mapInArrow(_signer(size), SIGNED), "signed")
    # one node stands for its copies
    one = signed.filter(F.col("same").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    root = written(components(links(nodes, rows, size, percent)), "roots")
    # a class is named by the least doc_id of its nodes
    named = written(root.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component")), "named")
    final = written(nodes.join(root.join(named, "root"), "node", "left").select("same", F.coalesce("component", "rep").alias("component")), "classes")
    out = signed.select("doc_id", "same", "n_shingles").join(final, "same", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
