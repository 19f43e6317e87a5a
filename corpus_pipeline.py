"""A corpus made fit for training in five stages, each an operator of assay.llm over all that the one before kept.

Each function takes (spark, docs, sf_dir), docs being what the stage before wrote as Parquet. All but the last return
the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, langid, near_dup, packing, secret_scan
from assay.llm.common import one_row, table, written
from assay.llm.queries import WORD_TOKENIZER, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents go whose text has no letters, or no language that holds at least this share of its words.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose words are of some learned language. Defined cases: null text and text without letters go;
    without a training document all go; repeated rows and null doc_ids are judged each; an empty table stays empty."""
    rows = docs.select(*COLUMNS)
    marked = langid.predict(rows, langid.train(rows))
    return marked.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the smallest doc_id, once. Defined cases: of rows
    that repeat a doc_id only the least by text, lang, source and n_chars (nulls first) is a document, the others go;
    rows without a doc_id belong to no class and stay; documents without words stay; an empty table stays empty."""
    rows = one_row(docs.select(*COLUMNS), "doc_id")
    kept = near_dup.near_duplicates(rows).filter("kept").select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").unionByName(rows.filter(F.col("doc_id").isNull()))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Defined cases: null and empty texts hold none and stay; repeated rows
    and null doc_ids are judged each; an empty table stays empty."""
    found = decontaminate.find(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("spans") == 0).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text gives way to a mark and n_chars follows; all rows stay. Defined cases: null text stays null;
    repeated rows and null doc_ids stay each; an empty table stays empty."""
    rows = docs.select(*COLUMNS)
    found = secret_scan.Ledger(spark).findings(rows.select(F.col("doc_id").alias("path"), "text")).withColumnRenamed("spans", "found")
    out = rows.withColumn("blob", secret_scan.blob_id(F.col("text"))).join(found, "blob", "left")
    clean = F.when(F.col("found").isNotNull(), secret_scan.redacted(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    # under a name of its own: in one select, the length's lambda would read the new column of the name text
    out = out.withColumn("clean", clean)
    return out.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(F.col("found").isNotNull(), F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Defined cases: null text packs as its end id alone; repeated rows are
    packed each; null doc_ids stay; an empty table gives no pieces."""
    return packing.pack(docs, vocabulary(WORD_TOKENIZER))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the language model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
