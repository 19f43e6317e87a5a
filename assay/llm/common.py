"""What the operators share: reading tables, the shared folder, written tables, removal at exit."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parents[1]
    at = f"{tempfile.mkdtemp(prefix='assay-ship-')}/{top.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only (doc_id long, text string): extra columns, whatever their names, play no part."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session within one process may do without and gets a
    temporary one; a cluster's executors wouldn't see that."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="assay-")
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/assay/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def local_path(uri: str) -> str:
    """The mounted path behind a file URI. Memory-mapped files need a POSIX mount."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped token files need a mounted shared folder, not {uri}")
    return unquote(at.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._assay_path = path
    return out


def remove(*frames: DataFrame | None) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_assay_path", None)
        if path:
            _delete(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what was written so far. It does so when the driver's JVM collects the plans,
    which a driver with a large heap may not do before an operator ends."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM has gone: what is left can only be removed if it is mounted here
            at = re.sub("^file://", "", path)
            if os.path.isdir(at):
                import shutil

                shutil.rmtree(at, ignore_errors=True)


def one_row(rows: DataFrame, key: str) -> DataFrame:
    """Of rows that repeat a key, the least by the other columns in their order, nulls first; null keys stay as they
    are. Only keys are shuffled to find what repeats, and only what repeats is shuffled then, with partial minima."""
    again = written(rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key), "again")
    if again.isEmpty():
        return rows
    rest = [c for c in rows.columns if c != key]
    least = rows.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("least")).select(key, "least.*")
    return rows.join(again, key, "left_anti").unionByName(least)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def widened(schema: StructType, more: str) -> StructType:
    """The schema with further fields, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])
