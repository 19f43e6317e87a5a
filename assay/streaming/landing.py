"""Deliveries as a stream: batch headers that land in a folder are recorded, and each batch is judged by the rules.

A producer writes a batch's rows to the store first and its header, as Parquet, last. reference_watermark stays what it
is, a bound on batch_id; it is no event-time watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assay.engine.runner import BatchScope, Engine
from assay.engine.store import SCHEMAS

#: Header files of one micro-batch, which bounds the batches judged in a row.
FILES = 32


def watch(engine: Engine, folder: str, checkpoint: str, *, once: bool = False, each: Callable = lambda result: None) -> StreamingQuery:
    """Starts the stream. A header that is recorded already is judged again, which adds no finding: a micro-batch that
    is repeated after a failure leaves what one leaves. once: stop when all that has landed is done. each: gets every
    RunResult."""

    def judge(headers: DataFrame, _: int) -> None:
        ids = [r.batch_id for r in headers.select("batch_id").distinct().orderBy("batch_id").toLocalIterator()]
        with engine.store.lock:
            have = {r.batch_id for r in engine.store.read("data_batch").filter(F.col("batch_id").isin(ids)).collect()}
            new = headers.filter(~F.col("batch_id").isin(have)) if have else headers
            engine.store.append("data_batch", new.dropDuplicates(["batch_id"]))
        for batch in ids:
            each(engine.run(BatchScope(batch)))

    stream = engine.spark.readStream.schema(SCHEMAS["data_batch"]).option("maxFilesPerTrigger", FILES).parquet(folder)
    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
