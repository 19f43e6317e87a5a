"""Exact top-k search by inner product through distributed histogram selection.

Vectors become integers: floor(1024 * x) of each component. Queries are taken in chunks of at most CHUNK, so that what
is broadcast or gathered on the driver has a fixed bound; each chunk scores all candidates in blocks. Per query a range
is known to hold the kth highest score. Every round splits the ranges into BINS bins and adds up histograms of all
scores over tasks, then over chunks' queries; the bin of the kth score becomes the new range, until at most SLACK
scores lie at or above the range's start or the range is one score wide. The last pass keeps scores from that threshold
on, at most k of a block and query (highest first, smaller vec_id first), which loses none of the k; these few are
ranked.

Scores are exact: products run in float64 where every partial sum is below 2^53, else in Python integers; only rows and
queries with large components meet the latter. Components and scores beyond LIMIT in either direction count as LIMIT, so
that a result is a long.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null vec_ids;
vectors of another length than the query's are no candidates of it; rows with the query's vec_id are its own; a
repeated query vec_id is asked once, with its first vector in array order; repeated candidate rows all count; ties go
to the smaller vec_id; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, ship, written

CHUNK = 2048
BINS = 256
#: The largest score; the difference of any two fits 64 bits.
LIMIT = (1 << 62) - 1
SLACK = 64
#: Scores held at a time by one task.
HELD = 2_000_000
RANKED = "query_id long, rank int, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long>: the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(good).select("vec_id", F.transform("x", lambda c: F.greatest(F.least(F.floor(c * 1024), F.lit(LIMIT)), F.lit(-LIMIT))).alias("v"))


def _large(v: np.ndarray) -> np.ndarray:
    """Of rows of integers: whether sums of n products with another row that isn't large may reach 2^53."""
    return np.abs(v).max(axis=1).astype(np.float64) ** 2 * v.shape[1] >= 2**53


class Queries:
    """A chunk of queries, by length of vector and by whether they are large."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.by: list[tuple[int, bool, np.ndarray, np.ndarray]] = []
        for n in {len(v) for _, v in rows}:
            at = np.array([k for k, (_, v) in enumerate(rows) if len(v) == n])
            m = np.array([rows[k][1] for k in at], np.int64)
            big = _large(m)
            for large in (False, True):
                if (big == large).any():
                    self.by.append((n, large, at[big == large], m[big == large]))


def _scores(q: Queries, batch: pa.RecordBatch):
    """(places of queries, vec_ids, scores) in blocks; the queries' own rows are masked out by the third's mask."""
    ids = batch.column(0).to_numpy()
    v = batch.column(1)
    offsets, flat = v.offsets.to_numpy(), v.values.to_numpy()
    size = np.diff(offsets)
    for n, large, at, m in q.by:
        every = np.nonzero(size == n)[0]
        if not len(every):
            continue
        big = _large(flat[offsets[every][:, None] + np.arange(n)])
        for rows, exact in ((every[~big], large), (every[big], True)):
            step = max(1, (HELD // 64 if exact else HELD) // max(1, len(at)))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                c = flat[offsets[some][:, None] + np.arange(n)]
                if exact:
                    s = np.clip(np.array(m.astype(object).dot(c.T.astype(object)), object), -LIMIT, LIMIT).astype(np.int64)
                else:
                    s = (m.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
                yield at, ids[some], s, ids[some][None, :] != q.ids[at][:, None]


def _histogram(shared):
    def count(batches):
        q, lo, width = shared.value
        total = np.zeros((len(q.ids), BINS + 2), np.int64)
        for b in batches:
            for at, _, s, other in _scores(q, b):
                k = np.clip((s - lo[at][:, None]) // width[at][:, None], -1, BINS) + 1
                place = (np.arange(len(at))[:, None] * (BINS + 2) + k)[other]
                total[at] += np.bincount(place, minlength=len(at) * (BINS + 2)).reshape(len(at), BINS + 2)
        for lo_ in range(0, len(total), 64):
            part = total[lo_ : lo_ + 64]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([lo_]), "counts": pa.array([part.tobytes()], pa.binary())})

    return count


def _add(key, group):
    total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"block": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})


def _best(shared, k: int):
    def best(batches):
        q, least = shared.value
        have: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for at, ids, s, other in _scores(q, b):
                hit = (s >= least[at][:, None]) & other
                for j in np.nonzero(hit.any(axis=1))[0].tolist():
                    own = np.nonzero(hit[j])[0]
                    order = np.lexsort((ids[own], -s[j, own]))[:k]
                    have[at[j]] = sorted(have.get(at[j], []) + list(zip((-s[j, own][order]).tolist(), ids[own][order].tolist(), strict=True)))[:k]
        if have:
            rows = [(q.ids[j], i, -s) for j, found in have.items() for s, i in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return best


def _chunk(q: Queries, vectors: DataFrame, top: float, k: int) -> DataFrame:
    spark = vectors.sparkSession
    n = len(q.ids)
    norm = np.ones(n)
    for _, _, at, m in q.by:
        norm[at] = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    reach = np.ceil(norm * top * (1 + 1e-9) + 1)
    reach = np.array([min(int(x), LIMIT) for x in reach], np.int64)
    lo, hi = -reach, reach + 1  # the kth score lies in [lo, hi); fewer than k scores lie from hi on
    above, settled = np.zeros(n, np.int64), np.zeros(n, bool)
    while not settled.all():
        width = (hi - lo - 1) // BINS + 1
        shared = spark.sparkContext.broadcast((q, lo, width))
        rows = vectors.mapInArrow(_histogram(shared), "block long, counts binary").groupBy("block").applyInArrow(_add, "block long, counts binary").collect()
        shared.unpersist()
        counts = np.zeros((n, BINS + 2), np.int64)
        for r in rows:
            x = np.frombuffer(r.counts, np.int64).reshape(-1, BINS + 2)
            counts[r.block : r.block + len(x)] = x
        # scores from each bin's start on; the kth lies in the last bin from whose start on there are k
        from_ = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        for j in np.nonzero(~settled)[0]:
            enough = np.nonzero(from_[j] >= k)[0]
            if not len(enough):  # fewer than k candidates in all
                settled[j] = True
                continue
            b = int(enough[-1])
            lo[j], hi[j] = lo[j] + b * width[j], lo[j] + (b + 1) * width[j]
            above[j] = from_[j, b]
            settled[j] = above[j] <= SLACK or width[j] == 1
    shared = spark.sparkContext.broadcast((q, lo))
    return vectors.mapInArrow(_best(shared, k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, chunk: int = CHUNK) -> DataFrame:
    """vectors, queries: as from integers(). Each query's k highest scores over all other vectors."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = written(vectors, "vectors")  # every round of every chunk reads them
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    n = asked.count()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = math.sqrt(vectors.agg(F.coalesce(F.max(norm2), F.lit(0.0))).first()[0]) if n else 0.0
    chunks = max(1, -(-2 * n // chunk)) if n > chunk else 1
    path, found = scratch(spark, "found"), None
    for j in range(chunks):
        some = asked if chunks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == j)
        q = Queries([(r.vec_id, r.v) for r in some.collect()])
        if len(q.ids):
            found = _chunk(q, vectors, top, k)
            if chunks > 1:  # else the plan would grow with the chunks
                found.write.mode("append").parquet(path)
    if found is None:
        return spark.createDataFrame([], RANKED)
    if chunks > 1:
        found = spark.read.schema(found.schema).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
