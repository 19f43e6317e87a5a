"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by its content (SHA-256). The ledger remembers which (blob, rule version)
pairs were scanned, and their findings. A scan takes the versions' distinct blobs, leaves out pairs that the ledger
has, runs the rules over the rest once each, adds both to the ledger, and joins findings back to all paths that have
or had the blob. Of copies only one text is scanned.

A rule is a regular expression, the least length of what it finds, and substrings one of which any match contains;
texts without them never meet the expression. Positions come from splitting the text at the matches: a match starts
after all pieces and matches before it.

Defined cases: null text is the empty blob; repeated rows are versions with one blob; null paths stay; an empty table
gives no rows; other columns play no part; spans of different kinds may overlap and all stay.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  # whose length counts
    least: int
    lower: bool  # whether `any_of` is looked for in the lower-cased text
    any_of: tuple[str, ...]


# The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, False, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, False, ()),
)
#: What this method adds: private key headers, signed web tokens, tokens of code hosts.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False, ("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False, ("eyJ",)),
    Rule("host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE + MORE


def _spans(text: Column, low: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in code points, in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(sized, F.length).alias("own"))
    none = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(have: Column, x: Column) -> Column:
        start = have["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(have["out"], F.array(span))).otherwise(have["out"]).alias("out"))

    spans = F.aggregate(rows, none, step, lambda x: x["out"])
    empty = F.expr(f"cast(array() as {SPAN})")
    if rule.any_of:
        where = low if rule.lower else text
        gate = F.lit(False)
        for s in rule.any_of:
            gate = gate | F.contains(where, F.lit(s))
    else:
        gate = text.rlike(rule.pattern)
    return F.when(gate, spans).otherwise(empty)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


KEPT = f"blob string, rules array<string>, found array<struct<rule:string,spans:{SPAN}>>"


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, as Parquet under a path that all executors share. A row
    holds what one scan added for a blob: the rule versions it ran and those that found something."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, (path or scratch(spark, "ledger")).rstrip("/"), rules
        self.names = [f"{r.kind}@{r.version}" for r in rules]

    def _read(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(KEPT).parquet(self.path)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """blob, text, due: the distinct blobs of versions with the rule versions that the ledger lacks for them, each
        from its first path (repeated where rows are). Which path is a blob's first is found on addresses alone, with
        partial sums, so a blob in a third of all versions is one row by then. Texts meet it by (address, path), so that
        its copies are spread; Spark broadcasts the addresses only while their measured size is under its own bound."""
        every = F.array(*map(F.lit, self.names))
        rows = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
        first = rows.groupBy("blob").agg(F.min("path").alias("first"))
        seen = self._read()
        if seen is None:
            first = first.withColumn("due", every)
        else:
            had = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))
            due = F.when(F.col("had").isNull(), every).otherwise(F.array_except(every, "had"))
            first = first.join(had, "blob", "left").withColumn("due", due).filter(F.size("due") > 0).drop("had")
        first = written(first.withColumnRenamed("blob", "own"), "blobs")
        return rows.join(first, (F.col("blob") == F.col("own")) & F.col("path").eqNullSafe(F.col("first"))).select("blob", "text", "due")

    def findings(self, versions: DataFrame) -> DataFrame:
        """versions: (path, text), any number of versions of any paths. blob, spans of all of the ledger's blobs in which
        this ledger's rules find something, after scanning what was unseen of versions. One append commits the scan;
        an append that fails leaves the ledger as it was, and what two scans add at once for a blob agrees."""
        rows, low = self.unseen(versions).withColumn("low", F.lower("text")), F.col("low")
        found = []
        for rank, (rule, name) in enumerate(zip(self.rules, self.names, strict=True)):
            spans = _spans(F.col("text"), low, rule, rank)
            found.append(F.when(F.array_contains("due", name), F.struct(F.lit(name).alias("rule"), spans.alias("spans"))))
        hits = F.filter(F.array(*found), lambda x: x.isNotNull() & (F.size(x["spans"]) > 0))
        rows.select("blob", F.col("due").alias("rules"), hits.alias("found")).write.mode("append").parquet(self.path)
        kept = self.spark.read.schema(KEPT).parquet(self.path).filter(F.size("found") > 0)
        mine = kept.select("blob", F.explode("found").alias("x")).filter(F.col("x.rule").isin(self.names)).distinct()
        # written before it is joined to paths, so that Spark can split a blob that very many paths have
        return written(mine.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("x.spans"))).alias("spans")), "findings")

    def scan(self, versions: DataFrame) -> DataFrame:
        """versions: (path, text). Each version with its blob and all spans of this ledger's rules."""
        spans = self.findings(versions)
        paths = versions.select("path", blob_id(F.col("text")).alias("blob"))
        return paths.join(spans, "blob", "left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; documents are versions whose path is their doc_id."""
    ledger = ledger or Ledger(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("path"), F.col("text").cast("string").alias("text"))
    out = ledger.scan(rows)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return out.select(F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "blob")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with each run of overlapping or touching spans replaced by the mark."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(have: Column, s: Column) -> Column:
        more = F.concat(have["out"], F.substring(text, have["at"] + 1, s["start"] - have["at"]), F.lit(mark))
        return F.struct(F.greatest(have["at"], s["end"]).alias("at"), F.when((s["start"] > have["at"]) | (have["out"] == ""), more).otherwise(have["out"]).alias("out"))

    return F.aggregate(spans, none, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
