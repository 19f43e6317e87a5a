"""Registration, runs, replay, findings and summaries over a Store. The engine knows no rule and no domain table."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.rules.definition import RuleDefinition
from assay.rules.predicates import COLUMNS, names, validate

from .store import Store

#: What a run pins of its session, as the value of a predicate may depend on it.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "false", "spark.sql.legacy.timeParserPolicy": "CORRECTED"}


class ScopeNotFoundError(LookupError): ...


class InvalidRunRequestError(ValueError): ...


class ReplaySourceError(ValueError): ...


@dataclass(frozen=True)
class BatchScope:
    batch_id: int


@dataclass(frozen=True)
class SourcePeriodScope:
    code: str
    start: dt.date
    end: dt.date  # exclusive

    def __post_init__(self):
        if self.start >= self.end:
            raise InvalidRunRequestError(f"a period from {self.start} can't end at {self.end}")


def month(text: str) -> tuple[dt.date, dt.date]:
    """The half-open range of a month written YYYY-MM."""
    if not re.fullmatch(r"[0-9]{4}-(0[1-9]|1[0-2])", text) or text[:4] == "0000":
        raise ValueError(f"a period is YYYY-MM, not {text!r}")
    y, m = int(text[:4]), int(text[5:])
    return dt.date(y, m, 1), dt.date(y + m // 12, m % 12 + 1, 1)


@dataclass(frozen=True)
class RunResult:
    rule_run_id: int
    scope_key: str
    status: str
    outcomes: dict[str, tuple[str, int, str | None]]  # rule_key: (outcome, new findings, error)

    @property
    def finding_count(self) -> int:
        return sum(n for _, n, _ in self.outcomes.values())


class Engine:
    """store: where rules, runs and findings live. The session's views are the readable tables."""

    def __init__(self, store: Store, refresh=None):
        """refresh: called before a scope is resolved, to make the views anew where their tables grow."""
        self.store, self.spark, self.refresh = store, store.spark, refresh or (lambda: None)

    @property
    def author(self) -> Store:
        return self.store.acting_as("author")

    @property
    def log(self) -> Store:
        return self.store.acting_as("engine")

    # --- registry

    def register(self, d: RuleDefinition) -> str:
        """created, versioned or unchanged."""
        store = self.author
        validate(d.predicate_sql, d.parameters, self.spark)
        with self.store.exclusive("rule"):
            old = store.latest("rule", "rule_key").filter(F.col("rule_key") == d.rule_key).first()
            rule_id = old.rule_id if old else store.next("rule", "rule_id")
            last = store.read("rule_version").filter(F.col("rule_id") == rule_id).orderBy(F.desc("version_no")).first() if old else None
            if old is None or old.owning_function != d.owning_function:  # domain and dimension keep their first values
                self._rule(rule_id, d.rule_key, old.domain if old else d.domain, old.dimension if old else d.dimension, d.owning_function, old.is_active if old else True)
            if last and not d.differs_from(last.severity, last.subject_type, last.predicate_sql, json.loads(last.parameters)):
                return "unchanged"
            version = (store.next("rule_version", "rule_version_id"), rule_id, last.version_no + 1 if last else 1, d.severity, d.subject_type, d.predicate_sql, json.dumps(d.parameters, sort_keys=True))
            store.append("rule_version", [version])
            return "versioned" if last else "created"

    def _rule(self, *row) -> None:
        store = self.author
        store.append("rule", [(*row, store.next("rule", "seq"))])

    def set_active(self, rule_key: str, active: bool) -> bool:
        old = self.store.latest("rule", "rule_key").filter(F.col("rule_key") == rule_key).first()
        if old is None:
            return False
        self._rule(old.rule_id, rule_key, old.domain, old.dimension, old.owning_function, active)
        return True

    def active_versions(self, subject_types: tuple[str, ...], rule_keys: list[str] | None = None) -> list:
        newest = Window.partitionBy("rule_id").orderBy(F.desc("version_no"))
        v = self.store.read("rule_version").withColumn("n", F.row_number().over(newest)).filter("n = 1")
        rules = self.store.latest("rule", "rule_key").filter("is_active")
        out = v.join(rules, "rule_id").filter(F.col("subject_type").isin(*subject_types))
        return sorted((out.filter(F.col("rule_key").isin(rule_keys)) if rule_keys is not None else out).collect(), key=lambda r: r.rule_key)

    # --- runs

    def _resolve(self, scope) -> dict:
        self.refresh()
        if isinstance(scope, BatchScope):
            b = self.spark.table("data_batch").filter(F.col("batch_id") == scope.batch_id).first()
            if b is None:
                raise ScopeNotFoundError(f"no batch {scope.batch_id}")
            at = {"scope_key": f"b:{b.batch_id}", "batch_id": b.batch_id, "source_system_id": b.source_system_id, "start": b.period_start, "end": b.period_end, "types": ("record", "batch")}
        else:
            s = self.spark.table("source_system").filter(F.col("code") == scope.code).first()
            if s is None:
                raise ScopeNotFoundError(f"no source {scope.code}")
            at = {"scope_key": f"sp:{scope.code}:{scope.start:%Y-%m}", "batch_id": None, "source_system_id": s.source_system_id, "start": scope.start, "end": scope.end, "types": ("source_period",)}
        at["watermark"] = self.spark.table("data_batch").agg(F.coalesce(F.max("batch_id"), F.lit(0))).first()[0]
        return at | {"as_of": at["end"] - dt.timedelta(days=1)}

    def _bindings(self, version, at: dict) -> dict:
        have = json.loads(version.parameters) | {"batch_id": at["batch_id"], "as_of_date": at["as_of"], "reference_watermark": at["watermark"], "scope_period_start": at["start"], "scope_period_end": at["end"], "scope_source_system_id": at["source_system_id"]}
        return {n: have[n] for n in names(version.predicate_sql)}

    def _evaluate(self, run_id: int, version, at: dict) -> tuple[str, int, str | None]:
        """Rows are complete in a cache before any is appended, so a predicate that fails leaves none. The lock, one
        for each scope and version, covers only the step from what is known to what is appended."""
        least = None
        try:
            found = self.spark.sql(version.predicate_sql, args=self._bindings(version, at)).select(*(F.col(c).cast("string") for c in COLUMNS))
            least = found.groupBy("subject_key").agg(F.min(F.struct(*COLUMNS[1:])).alias("s")).select("subject_key", "s.*").persist()
            bare = least.agg(F.count(F.when(F.col("offending_value").isNull(), 1))).first()[0]  # fills the cache
            if version.subject_type == "record" and bare:
                raise ValueError("a record finding needs an offending value")
            batch = at["batch_id"] if version.subject_type == "record" else None
            with self.store.exclusive(f"{at['scope_key']}-{version.rule_version_id}"):
                have = self.store.read("finding").filter((F.col("scope_key") == at["scope_key"]) & (F.col("rule_version_id") == version.rule_version_id)).select("subject_key")
                new = least.join(have, "subject_key", "left_anti")
                n = new.count()
                if n:
                    self.log.append("finding", new.select(
                        F.lit(run_id).cast("long").alias("rule_run_id"), F.lit(version.rule_version_id).cast("long").alias("rule_version_id"), F.lit(batch).cast("long").alias("batch_id"), F.lit(at["scope_key"]).alias("scope_key"),
                        F.lit(version.subject_type).alias("subject_type"), *COLUMNS, F.lit(version.severity).alias("severity"), F.lit(dt.datetime.now(dt.timezone.utc)).alias("detected_at"),
                    ))
            return "EVALUATED", n, None
        except Exception as e:
            return "ERRORED", 0, f"{type(e).__name__}: {str(e).splitlines()[0]}"
        finally:
            if least is not None:
                least.unpersist()

    def run(self, scope=None, *, rule_keys: list[str] | None = None, replay_of: int | None = None) -> RunResult:
        if (scope is None) == (replay_of is None) or replay_of is not None and rule_keys is not None:
            raise InvalidRunRequestError("a scope, or a run to replay without rule keys")
        if replay_of is None:
            at, settings = self._resolve(scope), SETTINGS
        else:
            self.refresh()
            at, settings, versions = self._recorded(replay_of)
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        if replay_of is None:
            versions = self.active_versions(at["types"], rule_keys)
        at = at | {"correlation_id": str(uuid.uuid4())}
        with self.store.exclusive("rule_run"):
            run_id = self.store.next("rule_run", "rule_run_id")
            self._event(run_id, replay_of, at, settings, "RUNNING", None)
        try:
            outcomes = {}
            for v in versions:
                outcomes[v.rule_key] = self._evaluate(run_id, v, at)
                self.log.append("rule_run_rule_version", [(run_id, v.rule_version_id, *outcomes[v.rule_key])])
        except BaseException as e:
            self._event(run_id, replay_of, at, settings, "FAILED", f"{type(e).__name__}: {e}")
            raise
        status = "COMPLETED_WITH_ERRORS" if any(o == "ERRORED" for o, _, _ in outcomes.values()) else "COMPLETED"
        self._event(run_id, replay_of, at, settings, status, None)
        return RunResult(run_id, at["scope_key"], status, outcomes)

    def _event(self, run_id, replay_of, at, settings, status, error) -> None:
        scope = json.dumps({k: str(v) if isinstance(v, dt.date) else v for k, v in at.items() if k != "correlation_id"}, sort_keys=True)
        self.log.append("rule_run", [(run_id, replay_of, at["scope_key"], scope, at["as_of"], at["watermark"], json.dumps(settings, sort_keys=True), status, error, at.get("correlation_id"), dt.datetime.now(dt.timezone.utc), self.store.next("rule_run", "seq"))])

    def _recorded(self, run_id: int):
        r = self.store.latest("rule_run", "rule_run_id").filter(F.col("rule_run_id") == run_id).first()
        if r is None or r.status != "COMPLETED" or r.replay_of_rule_run_id is not None:
            raise ReplaySourceError(f"run {run_id} is not an original, completed run")
        settings = json.loads(r.session_settings)
        if settings != SETTINGS:
            odd = sorted(k for k in settings.keys() | SETTINGS.keys() if settings.get(k) != SETTINGS.get(k))
            raise ReplaySourceError(f"run {run_id} was under other settings: {', '.join(odd)}")
        at = json.loads(r.scope)
        if at["watermark"] != r.reference_watermark or at["as_of"] != str(r.as_of_date) or at["scope_key"] != r.scope_key:
            raise ReplaySourceError(f"run {run_id} contradicts its own log")
        at = at | {k: dt.date.fromisoformat(at[k]) for k in ("start", "end", "as_of")} | {"types": tuple(at["types"])}
        ids = [x.rule_version_id for x in self.store.read("rule_run_rule_version").filter(F.col("rule_run_id") == run_id).collect()]
        v = self.store.read("rule_version").filter(F.col("rule_version_id").isin(ids)).join(self.store.latest("rule", "rule_key"), "rule_id").collect()
        if len(v) != len(ids) or len(set(ids)) != len(ids):
            raise LookupError("recorded rule versions are missing or repeated")
        if bad := sorted(x.rule_key for x in v if x.subject_type not in at["types"]):
            raise ReplaySourceError(f"run {run_id} has rules of other subjects: {', '.join(bad)}")
        return at, settings, sorted(v, key=lambda x: x.rule_key)

    # --- what is read back

    def findings(self, *, domain=None, rule_key=None, severity=None, batch_id=None, detected_from=None, detected_to=None, ordered: bool = True) -> DataFrame:
        """Findings with their rules' names. Ordered for those who show them all; counts need no order."""
        rules = self.store.latest("rule", "rule_key").select("rule_id", "rule_key", "domain", "dimension", "owning_function")
        named = self.store.read("finding").withColumn("finding_id", F.xxhash64("rule_version_id", "scope_key", "subject_key"))
        df = named.join(self.store.read("rule_version").select("rule_version_id", "rule_id", "version_no"), "rule_version_id").join(rules, "rule_id")
        for column, value in (("domain", domain), ("rule_key", rule_key), ("severity", severity), ("batch_id", batch_id)):
            if value is not None:
                df = df.filter(F.col(column) == value)
        if detected_from is not None:
            df = df.filter(F.col("detected_at") >= F.lit(detected_from))
        if detected_to is not None:
            df = df.filter(F.col("detected_at") < F.lit(detected_to))
        return df.orderBy("detected_at", "rule_version_id", "scope_key", "subject_key") if ordered else df

    def scope_key(self, scope) -> str:
        return self._resolve(scope)["scope_key"]

    def errored(self, scope_key: str) -> list:
        """(rule_key, version_no, error_detail) of the rules that the scope's latest run could not evaluate."""
        last = self.store.read("rule_run").filter(F.col("scope_key") == scope_key).agg(F.max("rule_run_id").alias("rule_run_id"))
        bad = self.store.read("rule_run_rule_version").filter("outcome = 'ERRORED'").join(F.broadcast(last), "rule_run_id", "left_semi")
        named = bad.join(self.store.read("rule_version").select("rule_version_id", "rule_id", "version_no"), "rule_version_id").join(self.store.latest("rule", "rule_key"), "rule_id")
        return named.select("rule_key", "version_no", "error_detail").orderBy("rule_key").collect()

    def retire_feed(self, source_system_id: int, end: dt.date) -> bool:
        """Ends the source's newest expectation at a day, by an event that supersedes it; False if there is none."""
        with self.store.exclusive("feed_expectation"):
            old = self.store.latest("feed_expectation", "feed_expectation_id").filter(F.col("source_system_id") == source_system_id).orderBy(F.desc("feed_expectation_id")).first()
            if old is None:
                return False
            if end <= old.active_from:
                raise ValueError(f"an expectation from {old.active_from} can't end at {end}")
            self.author.append("feed_expectation", [(old.feed_expectation_id, old.source_system_id, old.cadence, old.delivery_days, old.active_from, end, self.store.next("feed_expectation", "seq"))])
        return True

    def summary(self, scope) -> dict[str, dict[str, int]]:
        """Findings of a scope by domain, rule and severity; a subject that several versions of a rule found counts once."""
        at = self._resolve(scope)
        keys = [at["scope_key"]]
        if at["batch_id"] is not None:
            code = self.spark.table("source_system").filter(F.col("source_system_id") == at["source_system_id"]).first().code
            keys.append(f"sp:{code}:{at['start']:%Y-%m}")
        first = Window.partitionBy("rule_id", "subject_key").orderBy(F.desc("version_no"), "scope_key")
        once = self.findings(ordered=False).filter(F.col("scope_key").isin(keys)).withColumn("n", F.row_number().over(first)).filter("n = 1")
        rows = once.groupingSets([["domain"], ["rule_key"], ["severity"]], "domain", "rule_key", "severity").agg(F.count("*").alias("findings")).collect()
        return {c: {r[c]: r.findings for r in sorted(rows, key=lambda r: r[c] or "") if r[c] is not None} for c in ("domain", "rule_key", "severity")}
