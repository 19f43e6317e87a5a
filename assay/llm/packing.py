"""Best-fit packing into sequences of bounded length, with certified bounds.

Documents become pieces: only documents longer than a sequence are cut. Full pieces are sequences of their own. The
others are dealt by hash into bounded partitions, each packed by best-fit decreasing. A dual-feasible function f maps
lengths to shares so that lengths that fit one sequence together have shares of at most 1; the ceiling of the shares'
sum is then a lower bound on sequences, and the largest bound over a family of such functions certifies a partition
whose count equals it. The same bound over all lengths certifies the whole.

Partitions with a gap between count and bound exchange documents: those of their loosely filled sequences (short by more
than a LOOSE-th) are pooled, dealt anew by another hash, and packed again by best-fit decreasing, which counts only if it
uses fewer sequences. Where no such exchange saves any more, but the whole isn't certified, what is left are the ends
that partitions' bounds were rounded up by; then the loose sequences of all partitions are pooled. Exchanges go on until
the whole is certified or neither kind saves a sequence.

Defined cases: null text is empty and packs as its end id alone; repeated rows are packed each (a repeated doc_id is
told apart by its text's place only in what it gives, so its pieces may share doc_id and piece); null doc_ids stay; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, texts, written
from .pretokens import pretokens

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, salt long, sequence_id long, offset long, filled long"
#: Pieces that one task packs at a time, and how many more there may be by chance of the hash.
GROUP = 4096
LOOSE = 64


def _cutter(tokenizer: str, capacity: int, end_id: int):
    def cut(batches):
        encode, end = pretokens(tokenizer).ids, np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, lengths, crc, start, piece, of = b.column(0).to_pylist(), [], [], [], [], []
            for k, x in enumerate(encode(b.column(1).to_pylist())):
                x = memoryview(x + end)
                for j, at in enumerate(range(0, len(x), 4 * capacity)):
                    part = x[at : at + 4 * capacity]
                    of.append(doc[k])
                    piece.append(j)
                    start.append(at // 4)
                    lengths.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, lengths, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return texts(docs).mapInArrow(_cutter(tokenizer, capacity, end_id), PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each item, filled length of each bin) by best-fit decreasing; ties keep the items' order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms: list[int] = []  # rooms that some bin has, ascending
    filled: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = left[room].pop()
            if not left[room]:
                rooms.pop(k)
        else:
            b, room = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        room -= n
        if room:
            if not left[room]:
                insort(rooms, room)
            left[room].append(b)
    return bins, offsets, np.array(filled, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, count: np.ndarray | None = None) -> int:
    """The largest bound on bins from families of dual-feasible functions, in exact integers. count: of each length,
    where lengths are distinct."""
    if not len(lengths):
        return 0
    if count is None:
        lengths, count = np.unique(lengths, return_counts=True)
    sizes = lengths.astype(np.int64)
    best = -(-int((sizes * count).sum()) // capacity)
    for e in np.unique(np.minimum(sizes, capacity - sizes))[:: max(1, len(sizes) // 256)]:
        # threshold: lengths over capacity - e count whole, lengths under e not at all
        share = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int((share * count).sum()) // capacity))
    for k in range(1, 33):
        # rounding: u(k) of x is x where (k + 1) x is a multiple of the capacity, else floor((k + 1) x / capacity) / k
        whole, rest = np.divmod((k + 1) * sizes, capacity)
        share = np.where(rest == 0, k * sizes, whole * capacity)
        best = max(best, -(-int((share * count).sum()) // (k * capacity)))
    for e in {int(x) for x in sizes[sizes * 2 <= capacity][:: max(1, len(sizes) // 64)] if x}:
        # counting: small lengths by how many fit one bin, large ones by how many they displace
        top = capacity // e
        share = np.where(2 * sizes > capacity, 2 * (top - (capacity - sizes) // e), np.where(2 * sizes == capacity, top, np.where(sizes >= e, 2 * (sizes // e), 0)))
        best = max(best, -(-int((share * count).sum()) // (2 * top)))
    return best


def _packer(capacity: int, round_: int):
    def pack(key, group):
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        lengths = group.column("length").to_numpy()
        bins, offsets, filled = best_fit(lengths, capacity)
        gap = len(filled) - lower_bound(lengths, capacity)
        base = (round_ << 48) | (key[0].as_py() << 16)
        out = group.select(["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        return pa.Table.from_arrays([*out.columns, pa.array(base + bins), pa.array(offsets), pa.array(filled[bins]), pa.array(np.full(len(bins), gap, np.int64))], [*out.column_names, "sequence_id", "offset", "filled", "gap"])

    return pack


def _dealt(rows: DataFrame, groups: int, capacity: int, round_: int) -> DataFrame:
    by = F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(round_)), F.lit(groups))
    return rows.withColumn("deal", by).groupBy("deal").applyInArrow(_packer(capacity, round_), f"{PLACED}, gap long")


def _sequences(rows: DataFrame) -> int:
    return rows.filter(F.col("offset") == 0).count()


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. group: pieces that a task packs at a time (65,536 at most)."""
    spark = docs.sparkSession
    # salt tells repeated rows apart in the hash only, so that a third of all rows with one doc_id is dealt out too
    made = written(pieces(docs, tokenizer, capacity, end_id).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    cols = [c.split()[0] for c in PIECE.split(", ")]
    full = made.filter(F.col("length") == capacity).select(*cols, (-F.col("salt") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = made.filter(F.col("length") < capacity)
    sizes = short.groupBy("length").count().collect()  # no more rows than the capacity
    if not sizes:
        return full
    least = lower_bound(np.array([r.length for r in sizes]), capacity, np.array([r["count"] for r in sizes], np.int64))
    deal = lambda rows, n, round_: written(_dealt(rows, max(1, -(-n // group)), capacity, round_), "packed")
    loose = F.col("filled") < capacity - capacity // LOOSE
    closed, first = scratch(spark, "closed"), deal(short, sum(r["count"] for r in sizes), 1)
    first.filter(~loose).select(*cols, "sequence_id", "offset").write.parquet(closed)
    total, open_, round_, every = _sequences(first), first.filter(loose), 1, False
    while total > least:
        pool = open_ if every else open_.filter(F.col("gap") > 0)
        n, before = pool.count(), _sequences(pool)
        if before > 1:
            round_ += 1
            again = deal(pool.select(*cols, "salt"), n, round_)
            if (saved := before - _sequences(again)) > 0:
                again.filter(~loose).select(*cols, "sequence_id", "offset").write.mode("append").parquet(closed)
                left = again.filter(loose) if every else open_.filter(F.col("gap") <= 0).unionByName(again.filter(loose))
                total, open_, every = total - saved, written(left, "open"), False
                continue
            remove(again)
        if every:
            break
        every = True
    rest = spark.read.schema(full.schema).parquet(closed).unionByName(open_.select(*cols, "sequence_id", "offset"))
    return full.unionByName(rest)
