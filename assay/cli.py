"""python -m assay.cli --workspace FOLDER COMMAND: seed, rules, run-rules, findings, summarise, demo."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from assay.engine.console import Console
from assay.engine.runner import BatchScope, Engine, InvalidRunRequestError, ReplaySourceError, ScopeNotFoundError, SourcePeriodScope, month
from assay.engine.store import Store
from assay.rules.definition import RuleDefinitionError, export, load_definition, load_library
from assay.rules.library import shipped
from assay.sources import stored, world


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assay")
    p.add_argument("--workspace", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("seed", help="a synthetic world of three months")
    c.add_argument("--clean", action="store_true", help="without defects")
    c.add_argument("--show-expected", action="store_true")
    c.add_argument("--amend-master", action="store_true", help="a later batch with versions dated back")
    rules = sub.add_parser("rules").add_subparsers(dest="action", required=True)
    c = rules.add_parser("register", help="the shipped rules, or those of files and folders")
    c.add_argument("paths", nargs="*")
    rules.add_parser("export", help="the shipped rules as files").add_argument("folder")
    for action in ("activate", "deactivate"):
        rules.add_parser(action).add_argument("rule_key")
    for name in ("run-rules", "summarise"):
        c = sub.add_parser(name)
        c.add_argument("--batch-id", type=int)
        c.add_argument("--source")
        c.add_argument("--period", help="YYYY-MM")
        if name == "run-rules":
            c.add_argument("--rule", action="append")
            c.add_argument("--replay-of", type=int)
    c = sub.add_parser("findings")
    for flag in ("--domain", "--rule", "--severity", "--since", "--until"):
        c.add_argument(flag)
    c.add_argument("--batch-id", type=int)
    c.add_argument("--csv", help="write them to this folder")
    c = sub.add_parser("demo")
    c.add_argument("action", choices=("prepare", "serve"))
    c.add_argument("--port", type=int, default=8000)
    return p


def _scope(a):
    if (a.batch_id is None) == (a.source is None and a.period is None) or (a.source is None) != (a.period is None):
        raise InvalidRunRequestError("give --batch-id, or both --source and --period")
    return BatchScope(a.batch_id) if a.batch_id is not None else SourcePeriodScope(a.source, *month(a.period))


def _rules(engine: Engine, a) -> int:
    if a.action == "export":
        print(*export(shipped(), a.folder), sep="\n")
        return 0
    if a.action != "register":
        if not engine.set_active(a.rule_key, a.action == "activate"):
            raise LookupError(f"no rule {a.rule_key}")
        return 0
    from pathlib import Path

    given = [d for p in a.paths for d in (load_library(p) if Path(p).is_dir() else [load_definition(p)])]
    for d in given if a.paths else shipped():
        print(f"{d.rule_key:<22} {engine.register(d)}")
    return 0


def _run(engine: Engine, a) -> int:
    if a.replay_of is not None:
        if a.batch_id is not None or a.source or a.period or a.rule:
            raise InvalidRunRequestError("--replay-of goes alone")
        r = engine.run(replay_of=a.replay_of)
    else:
        r = engine.run(_scope(a), rule_keys=a.rule)
    print(f"run {r.rule_run_id} of {r.scope_key}: {r.status}, {r.finding_count} new findings")
    for key, (outcome, n, error) in r.outcomes.items():
        print(f"  {key:<22} {outcome:<10} {n}{f'  {error}' if error else ''}")
    return 2 if any(o == "ERRORED" for o, _, _ in r.outcomes.values()) else 0


def _findings(engine: Engine, a) -> int:
    since, until = (dt.datetime.fromisoformat(x) if x else None for x in (a.since, a.until))
    df = engine.findings(domain=a.domain, rule_key=a.rule, severity=a.severity, batch_id=a.batch_id, detected_from=since, detected_to=until)
    if a.csv:
        df.write.mode("errorifexists").option("header", True).csv(a.csv)
        return 0
    none = True
    for f in df.toLocalIterator():
        none = False
        print(f"{f.finding_id:<21} {f.rule_key:<22} v{f.version_no:<3} {f.severity:<7} {f.subject_type:<14} {f.subject_key:<24} {f.offending_value or '':<20} {f.detected_at.isoformat()}")
    if none:
        print("no findings match")
    return 0


def _summarise(engine: Engine, a) -> int:
    scope = _scope(a)
    s = engine.summary(scope)
    print(f"total findings: {sum(s['rule_key'].values())}")
    for column, counts in s.items():
        print(f"by {column}:", *(f"  {k:<22} {n}" for k, n in counts.items()), sep="\n")
    for e in engine.errored(engine.scope_key(scope)):
        print(f"errored: {e.rule_key} v{e.version_no} {e.error_detail}")
    return 0


def _seed(store: Store, a) -> int:
    if a.amend_master:
        print(f"amendment batch: {world.amend(store)}")
        return 0
    made = world.seed(store, not a.clean)
    for (code, period), batch in made.batches.items():
        print(f"batch {batch} {code} {period}")
    print(f"expected findings: {len(made.expected)}")
    if a.show_expected:
        print(*(f"  {rule:<22} {subject}" for rule, subject in sorted(made.expected)), sep="\n")
    return 0


def _demo(engine: Engine, console: Console, a) -> int:
    if a.action == "prepare":
        for d in shipped():
            engine.register(d)
        if not console.periods():
            world.seed(engine.store)
        state = console.run(console.periods()[0])
        print(f"{state['period']}: {state['run_status']}, {state['findings_count']} findings")
    else:
        console.serve(a.port).serve_forever()
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    """The exit code: 2 if a rule errored, 1 for a request that can't be met."""
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("assay").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.workspace)
    stored.register(store)
    engine = Engine(store, lambda: stored.register(store))
    try:
        if a.command == "demo":
            return _demo(engine, Console(engine), a)
        if a.command == "seed":
            return _seed(store, a)
        return {"rules": _rules, "run-rules": _run, "findings": _findings, "summarise": _summarise}[a.command](engine, a)
    except (InvalidRunRequestError, ReplaySourceError, ScopeNotFoundError, RuleDefinitionError, LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
