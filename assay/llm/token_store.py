"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

A store is a folder of shards. Shard k holds documents of the k-th range of doc_id:
  shard-k.bin  the ids, little-endian uint16 (vocabularies of up to 65,536 ids) or uint32
  shard-k.idx  little-endian int64 offsets in ids from the shard's start, one more than documents
  shard-k.doc  little-endian int64 doc_ids; the first `nulls` of them stand for null
manifest.json comes last and commits the store: for each shard its counts and base, the ids in all shards before it,
from prefix sums over the shards' counts.

Defined cases: null text is empty and gives the end id alone; null doc_ids come first; rows with equal doc_id are all
kept, ordered by text; an empty table gives a store without shards; other columns play no part.
A task writes each file under a name of its own and renames it, so that a repeated task replaces a shard whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, parts, scratch, texts
from .pretokens import pretokens

#: Distinct pre-tokens remembered by a Python worker: with fewer, rare words of a large corpus push out all others again and
#: again, and a third of the time goes into encoding them anew.
REMEMBERED = 1_000_000
WRITTEN = "shard long, docs long, nulls long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _put(folder: str, name: str, data: bytes) -> None:
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, f"{folder}/{name}")


def _writer(tokenizer: str, folder: str, end_id: int, dtype: str):
    def write(batches):
        from pyspark import TaskContext

        p, end = pretokens(tokenizer), np.array([end_id], "<u4").tobytes()
        p.remembered, encode = REMEMBERED, p.ids
        shard = TaskContext.get().partitionId()
        own = f"{folder}/.shard-{shard:06d}.bin.{uuid.uuid4().hex}"
        ids, lengths, names, nulls = 0, [], [], 0
        with open(own, "wb") as out:
            for b in batches:
                doc = b.column(0)
                nulls += doc.null_count
                names.append(doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for x in encode(b.column(1).to_pylist()):
                    a = np.frombuffer(x + end, "<u4")
                    out.write(a.astype(dtype).tobytes())
                    lengths.append(len(a))
                    ids += len(a)
        if not lengths:
            os.remove(own)
            return
        os.replace(own, f"{folder}/shard-{shard:06d}.bin")
        _put(folder, f"shard-{shard:06d}.idx", np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes())
        _put(folder, f"shard-{shard:06d}.doc", np.concatenate(names).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(lengths)], "nulls": [nulls], "ids": [ids]})

    return write


def write(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 0, shards: int | None = None) -> str:
    """Encode every whole text and write the store; its path. shards: spark.sql.shuffle.partitions unless given."""
    spark = docs.sparkSession
    out = out or scratch(spark, "tokens")
    folder = local_path(out)
    os.makedirs(folder, exist_ok=True)
    dtype = "<u2" if pretokens(tokenizer).tokenizer.get_vocab_size() <= 65_536 and end_id < 65_536 else "<u4"
    ranged = texts(docs).repartitionByRange(shards or parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = ranged.mapInArrow(_writer(tokenizer, folder, end_id, dtype), WRITTEN).collect()  # a row a shard
    base, listed = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        listed.append({"shard": r.shard, "docs": r.docs, "nulls": r.nulls, "ids": r.ids, "base": base})
        base += r.ids
    _put(folder, "manifest.json", json.dumps({"dtype": dtype, "end_id": end_id, "tokenizer": os.path.basename(tokenizer), "shards": listed}).encode())
    return out


def _reader(folder: str, dtype: str):
    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                at = f"{folder}/shard-{r['shard']:06d}"
                ids, idx, doc = (np.memmap(f"{at}.{end}", kind, "r") for end, kind in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                for lo in range(0, r["docs"], 4096):
                    hi = min(lo + 4096, r["docs"])
                    edge = idx[lo : hi + 1]
                    crc = [zlib.crc32(ids[edge[i] : edge[i + 1]].astype("<u4").tobytes()) for i in range(hi - lo)]
                    names = pa.array(np.asarray(doc[lo:hi]), mask=np.arange(lo, hi) < r["nulls"])
                    yield pa.RecordBatch.from_arrays([names, pa.array(edge[:-1] + r["base"]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, from the memory-mapped files."""
    folder = local_path(path)
    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        m = json.load(f)
    rows = [(s["shard"], s["docs"], s["nulls"], s["base"]) for s in m["shards"]]
    frame = spark.createDataFrame(rows, "shard long, docs long, nulls long, base long")
    return frame.repartition(max(1, min(len(rows), parts(spark)))).mapInArrow(_reader(folder, m["dtype"]), READ)


def token_ids(path: str, shard: int, doc: int) -> np.ndarray:
    """The ids of one document of a shard by its place there, without reading the rest."""
    folder = local_path(path)
    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        dtype = json.load(f)["dtype"]
    idx = np.memmap(f"{folder}/shard-{shard:06d}.idx", "<i8", "r")
    return np.asarray(np.memmap(f"{folder}/shard-{shard:06d}.bin", dtype, "r")[idx[doc] : idx[doc + 1]])
