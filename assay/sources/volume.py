"""One clean batch of any size: sales, people, goods and alignments that agree, made on the executors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.engine.store import SCHEMAS, Store
from assay.functions.scalars import check_digit

START, END = dt.date(2025, 9, 1), dt.date(2025, 10, 1)
UNIT = ("BOX", "VIAL", "TUBE")


def _typed(df: DataFrame, name: str) -> DataFrame:
    fields = (f.split(" ", 1) for f in SCHEMAS[name].split(", "))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields))


def fill(store: Store, sales: int, people: int, goods: int, areas: int) -> int:
    """Appends the batch and gives its id. Every person is aligned to one area; every sale is by an aligned person, of a
    known good in its unit."""
    spark, batch, source = store.spark, store.next("data_batch", "batch_id"), store.next("source_system", "source_system_id")
    stem = f"cast({300_000_000 + batch % 60 * 10_000_000} + id as string)"  # up to 10 million people a batch have numbers of their own
    own = F.lit(source).alias("source_system_id"), F.lit(batch).alias("batch_id"), F.lit(START).alias("valid_from"), F.lit(False).alias("is_deleted")
    hcp = spark.range(people).select(
        (F.col("id") + 1).alias("hcp_id"), *own, F.expr("'P' || id").alias("source_key"), F.expr(f"{stem} || {check_digit(stem)}").alias("npi"), F.expr("'First' || id % 97").alias("first_name"), F.expr(f"'Last{batch}x' || id").alias("last_name"),
        F.expr("cast(10000 + id % 90000 as string)").alias("postal_code"), F.expr("'S' || id % 50").alias("licence_state"),
    )
    unit = lambda k: F.element_at(F.array(*map(F.lit, UNIT)), (F.col(k) % 3 + 1).cast("int"))
    product = spark.range(goods).select((F.col("id") + 1).alias("product_id"), *own, F.expr("'G' || id").alias("source_key"), F.expr("'Good ' || id").alias("name"), unit("id").alias("uom"), F.lit("ACTIVE").alias("status"))
    aligned = spark.range(people).select((F.col("id") + 1).alias("alignment_id"), F.lit(batch).alias("batch_id"), F.lit(source).alias("source_system_id"), F.expr("'P' || id").alias("hcp_source_key"), F.expr(f"'A' || id % {areas}").alias("territory_code"), F.lit(START).alias("effective_from"))
    sold = spark.range(sales).select("id", (F.col("id") % people).alias("person"), (F.col("id") * 7 % goods).alias("good")).select(
        (F.col("id") + 1).alias("txn_id"), F.lit(batch).alias("batch_id"), F.lit(source).alias("source_system_id"), F.expr("'S' || id").alias("source_txn_key"), F.expr("'G' || good").alias("product_key"), F.expr("'P' || person").alias("hcp_key"),
        F.expr(f"'A' || person % {areas}").alias("territory_code"), F.date_add(F.lit(START), (F.col("id") % 30).cast("int")).alias("txn_date"), F.lit(10).alias("quantity"), unit("good").alias("uom"),
    )
    for name, df in (("hcp", hcp), ("product", product), ("territory_alignment", aligned), ("sales_transaction", sold)):
        store.append(name, _typed(df, name))
    store.append("source_system", [(source, f"VOLUME-{source}", "Volume")])
    store.append("data_batch", [(batch, source, dt.datetime(2025, 10, 2, tzinfo=dt.timezone.utc), START, END, sales + 2 * people + goods)])
    return batch
