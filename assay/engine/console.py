"""The nightly read-model of one month: deliveries, runs, findings and counts; and its small HTTP server."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from collections.abc import Callable
from email.message import Message
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import NamedTuple
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runner import BatchScope, Engine, SourcePeriodScope, month

#: Findings shown; the counts are of all.
SHOWN = 500
#: Bytes of a request's body at most.
BODY = 4096
# What a request to run must carry.
ACTION = ("x-dq-demo-action", "run-nightly-load")
PAGE = """<!doctype html><meta charset=utf-8><title>Nightly load</title><h1>Nightly load</h1><pre id=out></pre>
<script>fetch('/api/nightly-load').then(r => r.json()).then(s => out.textContent = JSON.stringify(s, null, 2))</script>"""


class Refusal(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status, self.why = status, why


class JSON:
    KIND = "application/json"

    @staticmethod
    def reply(status: int, value: object) -> tuple[int, str, bytes]:
        shown = lambda x: x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else str(x)
        return status, f"{JSON.KIND}; charset=utf-8", json.dumps(value, default=shown).encode()


class Request(NamedTuple):
    query: str
    headers: dict[str, str]
    body: bytes


def query_fields(r: Request) -> list[tuple[str, object]]:
    return parse_qsl(r.query, keep_blank_values=True, strict_parsing=True) if r.query else []


def json_fields(r: Request) -> list[tuple[str, object]]:
    """The members of the body's object in order, repeated ones too."""
    kind = Message()
    kind["content-type"] = r.headers.get("content-type", "")
    if kind.get_content_type() != JSON.KIND:
        raise Refusal(400, f"send {JSON.KIND}")
    if len(r.body) > BODY:
        raise Refusal(400, f"send {BODY} bytes at most")
    got = json.loads(r.body, object_pairs_hook=_Members)
    if not isinstance(got, _Members):
        raise Refusal(400, "send one JSON object")
    return list(got)


class _Members(list):
    """An object's members; a nested object or list is no field's value."""


class Route(NamedTuple):
    """What answers, the fields it takes (all of them texts), where they come from, and a header that must be there."""

    answer: Callable[..., object]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    fields: Callable[[Request], list[tuple[str, object]]] = lambda r: []
    header: tuple[str, str] | None = None
    media: str | None = None  # of an answer in bytes; JSON otherwise

    def arguments(self, r: Request) -> dict[str, str]:
        if self.header and r.headers.get(self.header[0]) != self.header[1]:
            raise Refusal(403, f"the header {self.header[0]} is missing or wrong")
        pairs = self.fields(r)
        given = Counter(k for k, _ in pairs)
        wrong = [f"unknown: {k}" for k in given if k not in self.required + self.optional] + [f"repeated: {k}" for k, n in given.items() if n > 1]
        wrong += [f"missing: {k}" for k in self.required if k not in given] + [f"not a text: {k}" for k, v in pairs if not isinstance(v, str)]
        if wrong:
            raise Refusal(400, "; ".join(wrong))
        return dict(pairs)


class Console:
    def __init__(self, engine: Engine):
        self.engine, self.store, self.spark = engine, engine.store, engine.spark

    def health(self) -> dict:
        return {"status": "healthy", "engine": f"Spark {self.spark.version}"}

    def periods(self) -> list[str]:
        p = self.store.read("data_batch").select(F.date_format("period_start", "yyyy-MM").alias("p")).distinct()
        return [r.p for r in p.orderBy(F.desc("p")).collect()]

    def _period(self, period: str | None) -> tuple[str, list[str], dt.date, dt.date]:
        have = self.periods()
        if not have:
            raise ValueError("no batches; seed first")
        period = period or have[0]
        start, end = month(period)
        if period not in have:
            raise ValueError(f"no batch for {period}")
        return period, have, start, end

    def _batches(self, start: dt.date, end: dt.date) -> DataFrame:
        b = self.store.read("data_batch").filter((F.col("period_start") == F.lit(start)) & (F.col("period_end") == F.lit(end)))
        return b.join(self.store.read("source_system"), "source_system_id").select("batch_id", "code", "name", "record_count", "arrival_ts").orderBy("code", "arrival_ts")

    def _runs(self, keys: list[str]) -> list:
        """The latest run of each scope with its outcomes, newest first."""
        log = self.store.read("rule_run").filter(F.col("scope_key").isin(keys))
        run = log.groupBy("scope_key", "rule_run_id").agg(
            F.max_by("status", "seq").alias("status"), F.max("replay_of_rule_run_id").alias("replay_of_rule_run_id"), F.max("correlation_id").alias("correlation_id"), F.max("reference_watermark").alias("reference_watermark"),
            F.min("happened_at").alias("started_at"), F.max(F.when(F.col("status") != "RUNNING", F.col("happened_at"))).alias("finished_at"),
        )
        every = [c for c in run.columns if c != "scope_key"]
        latest = run.groupBy("scope_key").agg(F.max_by(F.struct(*every), F.struct("started_at", "rule_run_id")).alias("r")).select("scope_key", "r.*")
        counts = self.store.read("rule_run_rule_version").groupBy("rule_run_id").agg(
            F.count("*").alias("rules_evaluated"), F.count(F.when(F.col("outcome") == "ERRORED", 1)).alias("rules_errored"), F.coalesce(F.sum("finding_count"), F.lit(0)).alias("new_findings")
        )
        return latest.join(counts, "rule_run_id", "left").fillna(0, ["rules_evaluated", "rules_errored", "new_findings"]).orderBy(F.desc("started_at"), F.desc("rule_run_id")).collect()

    def load(self, period: str | None = None) -> dict:
        """The month's state. Counts are of all findings, also where versions of a rule found a subject twice."""
        period, have, start, end = self._period(period)
        batches = self._batches(start, end).collect()
        codes = [r.code for r in self.store.read("source_system").orderBy("code").collect()]
        keys = sorted({f"b:{b.batch_id}" for b in batches} | {f"sp:{c}:{period}" for c in codes})
        runs = self._runs(keys)
        found = self.engine.findings(ordered=False).filter(F.col("scope_key").isin(keys)).persist()
        rank = F.when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
        columns = ("finding_id", "subject_key", "subject_type", "offending_value", "observed_value", "expected_value", "severity", "detected_at", "rule_run_id", "rule_key", "domain", "dimension", "owning_function", "version_no")
        shown = found.orderBy(rank, F.desc("detected_at"), "finding_id").limit(SHOWN).select(*columns).collect()

        def counted(column: str) -> list[dict]:
            return [{"label": r[column], "count": r.n} for r in found.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).collect()]

        severities, dimensions = counted("severity"), counted("dimension")
        found.unpersist()
        rules = sorted(self.engine.active_versions(("record", "batch", "source_period")), key=lambda r: (r.domain, r.rule_key))
        states = {r.status for r in runs}
        status = "NOT RUN" if not runs else "COMPLETED_WITH_ERRORS" if "COMPLETED_WITH_ERRORS" in states else "COMPLETED" if states == {"COMPLETED"} else "INCOMPLETE"
        return {
            "generated_at": dt.datetime.now(dt.timezone.utc), "period": period, "available_periods": have, "batches": [b.asDict() for b in batches],
            "records_evaluated": sum(b.record_count for b in batches), "findings_count": sum(s["count"] for s in severities), "new_findings": sum(r.new_findings for r in runs),
            "rules_evaluated": min(len(rules), sum(r.rules_evaluated for r in runs)), "rules_errored": sum(r.rules_errored for r in runs),
            "run_duration_seconds": sum((r.finished_at - r.started_at).total_seconds() for r in runs if r.finished_at), "run_status": status,
            "reference_watermark": max((r.reference_watermark for r in runs), default=None), "dimensions": dimensions, "severities": severities, "findings": [f.asDict() for f in shown],
            "rules": [{k: r[k] for k in ("rule_key", "domain", "dimension", "owning_function", "version_no", "severity", "subject_type")} for r in rules], "runs": [r.asDict() for r in runs],
        }

    def run(self, period: str) -> dict:
        """Every batch of the month by id, then every source's month by code."""
        period, _, start, end = self._period(period)
        for batch in sorted(b.batch_id for b in self._batches(start, end).collect()):
            self.engine.run(BatchScope(batch))
        for source in self.store.read("source_system").orderBy("code").collect():
            self.engine.run(SourcePeriodScope(source.code, start, end))
        return self.load(period)

    # --- HTTP

    def routes(self) -> dict[str, dict[str, Route]]:
        """By path, then by method."""
        page = Route(lambda: PAGE.encode(), media="text/html; charset=utf-8")
        return {
            "/": {"GET": page},
            "/index.html": {"GET": page},
            "/api/health": {"GET": Route(self.health)},
            "/api/nightly-load": {"GET": Route(self.load, optional=("period",), fields=query_fields)},
            "/api/nightly-load/run": {"POST": Route(self.run, required=("period",), fields=json_fields, header=ACTION)},
        }

    def dispatch(self, method: str, target: str, headers: dict[str, str], body: bytes) -> tuple[int, str, bytes]:
        """(status, content type, body). Header names are in lower case."""
        path, _, query = target.partition("?")
        route = self.routes().get(path, {}).get(method)
        try:
            if route is None:
                raise Refusal(404, f"nothing is served at {method} {path}")
            out = route.answer(**route.arguments(Request(query, headers, body)))
        except Refusal as e:
            return JSON.reply(e.status, {"error": e.why})
        except ValueError as e:
            return JSON.reply(400, {"error": str(e)})
        except Exception as e:
            print(f"{method} {path} broke off: {type(e).__name__}: {e}")
            return JSON.reply(500, {"error": "this went wrong on the server, whose log says how"})
        return JSON.reply(200, out) if route.media is None else (200, route.media, out)

    def serve(self, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """A bound server; call serve_forever() on it."""
        console = self

        class Handler(BaseHTTPRequestHandler):
            def _do(self):
                size = self.headers.get("content-length", "0")
                size = int(size) if size.isdecimal() else 0
                status, kind, out = console.dispatch(self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, self.rfile.read(min(size, BODY + 1)))
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            do_GET = do_POST = _do

        return ThreadingHTTPServer((host, port), Handler)
