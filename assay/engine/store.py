"""An append-only store of Parquet tables. What changes is an event; views fold events to the latest state.

What is delivered lies in a folder for each batch, findings in one for each scope, so that a run reads its own batch and
its scope's earlier findings only."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHAIN = "source_system_id smallint, source_key string, valid_from date, batch_id long, is_deleted boolean"
SCHEMAS = {
    "rule": "rule_id int, rule_key string, domain string, dimension string, owning_function string, is_active boolean, seq long",
    "rule_version": "rule_version_id long, rule_id int, version_no int, severity string, subject_type string, predicate_sql string, parameters string",
    "rule_run": "rule_run_id long, replay_of_rule_run_id long, scope_key string, scope string, as_of_date date, reference_watermark long, session_settings string, status string, error_detail string, correlation_id string, happened_at timestamp, seq long",
    "rule_run_rule_version": "rule_run_id long, rule_version_id long, outcome string, finding_count long, error_detail string",
    "finding": "rule_run_id long, rule_version_id long, batch_id long, scope_key string, subject_type string, subject_key string, offending_value string, observed_value string, expected_value string, severity string, detected_at timestamp",
    "source_system": "source_system_id smallint, code string, name string",
    "data_batch": "batch_id long, source_system_id smallint, arrival_ts timestamp, period_start date, period_end date, record_count int",
    "hcp": f"hcp_id long, {_CHAIN}, npi string, first_name string, last_name string, postal_code string, licence_state string, hco_source_key string",
    "hco": f"hco_id long, {_CHAIN}, name string, postal_code string",
    "product": f"product_id long, {_CHAIN}, name string, uom string, status string, retired_on date",
    "territory": f"territory_id long, {_CHAIN}, code string, name string",
    "territory_alignment": "alignment_id long, batch_id long, source_system_id smallint, hcp_source_key string, territory_code string, effective_from date, effective_to date",
    "sales_transaction": "txn_id long, batch_id long, source_system_id smallint, source_txn_key string, product_key string, hcp_key string, territory_code string, txn_date date, quantity decimal(18,4), uom string",
    "feed_expectation": "feed_expectation_id int, source_system_id smallint, cadence string, delivery_days int, active_from date, active_to date, seq long",
}


PARTITIONS = dict.fromkeys(("hcp", "hco", "product", "territory", "territory_alignment", "sales_transaction"), "batch_id") | {"finding": "scope_key"}


MASTER = ("hcp", "hco", "product", "territory")
COMMERCIAL = ("source_system", "data_batch", *MASTER, "territory_alignment", "sales_transaction", "feed_expectation")
REGISTRY = ("rule", "rule_version")
LOG = ("rule_run", "rule_run_rule_version", "finding")
#: What each role may read and append; nothing is ever changed or removed.
ROLES = {
    "owner": ({*SCHEMAS}, {*SCHEMAS}),
    "ingest": ({*COMMERCIAL}, {*COMMERCIAL}),
    "author": ({*REGISTRY, *LOG, "feed_expectation"}, {*REGISTRY, "feed_expectation"}),
    "engine": ({*SCHEMAS}, {*LOG}),
    "readonly": ({*SCHEMAS}, set()),
}


class RoleError(PermissionError): ...


class ChainError(ValueError):
    """A delivery brings a version of a master record that the store, or the delivery itself, has already."""


class Store:
    def __init__(self, spark: SparkSession, path: str, role: str = "owner", lock=None):
        self.spark, self.path, self.role, self.lock = spark, path.rstrip("/"), role, lock or threading.RLock()
        self.readable, self.writable = ROLES[role]

    def acting_as(self, role: str) -> Store:
        """The same store with the rights of a role, which may not go beyond one's own."""
        readable, writable = ROLES[role]
        if not (readable <= self.readable and writable <= self.writable):
            raise RoleError(f"{self.role} may not act as {role}")
        return Store(self.spark, self.path, role, self.lock)

    def read(self, name: str) -> DataFrame:
        if name not in self.readable:
            raise RoleError(f"{self.role} may not read {name}")
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        return df.select(*(c.split()[0] for c in SCHEMAS[name].replace("(18,4)", "").split(", "))) if name in PARTITIONS else df

    def append(self, name: str, rows: list[tuple] | DataFrame) -> None:
        if name not in self.writable:
            raise RoleError(f"{self.role} may not append to {name}")
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1)
        if name in MASTER:
            self._one_chain(name, df)
        by = PARTITIONS.get(name)
        (df.write.partitionBy(by) if by else df.write).mode("append").parquet(f"{self.path}/{name}")

    @contextmanager
    def exclusive(self, name: str, wait: float = 60.0):
        """Held by one thread of one process at a time: a file that only its maker may make. Atomic where the file system
        makes files so. What a dead process left is named in the error, to be removed by hand."""
        jvm, at = self.spark.sparkContext._jvm, f"{self.path}/_locks/{name.replace('/', '_').replace(':', '_')}"
        path = jvm.org.apache.hadoop.fs.Path(at)
        fs, until = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), time.monotonic() + wait
        with self.lock:
            while True:
                try:
                    fs.create(path, False).close()
                    break
                except Exception as e:
                    if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                        raise
                    if time.monotonic() > until:
                        raise TimeoutError(f"{at} is held by another process, or left by one that died") from None
                    time.sleep(0.05)
            try:
                yield
            finally:
                fs.delete(path, False)

    def _one_chain(self, name: str, df: DataFrame) -> None:
        """Versions of a master record differ in the day they hold from."""
        key = ["source_system_id", "source_key", "valid_from"]
        new = df.select(*key)
        twice = new.groupBy(*key).count().filter("count > 1").select(*key).unionByName(new.join(self.read(name).select(*key), key, "left_semi"))
        if bad := twice.first():
            raise ChainError(f"{name} {bad.source_key} of source {bad.source_system_id} has a version from {bad.valid_from} already")

    def latest(self, name: str, key: str) -> DataFrame:
        """The last event of each key."""
        df = self.read(name)
        cols = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.expr(f"max_by(struct({', '.join(cols)}), seq) as s")).select(key, "s.*")

    def next(self, name: str, column: str) -> int:
        return (self.read(name).agg({column: "max"}).first()[0] or 0) + 1

