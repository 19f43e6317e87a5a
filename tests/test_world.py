"""The seeded world against its declared findings, the amendment, the console, the command line and the stream."""

import datetime as dt
import json
from collections import Counter

import pytest

from assay import cli
from assay.engine.console import ACTION, Console
from assay.engine.runner import BatchScope, Engine, SourcePeriodScope, month
from assay.engine.store import SCHEMAS, Store
from assay.rules.library import shipped
from assay.sources import stored, world
from assay.streaming.landing import watch

MARCH = (dt.date(2025, 3, 1), dt.date(2025, 4, 1))


def engine_of(spark, path) -> Engine:
    store = Store(spark, str(path))
    stored.register(store)
    return Engine(store, lambda: stored.register(store))


def found(engine, batch):
    engine.run(BatchScope(batch))
    for code in world.SOURCES:
        engine.run(SourcePeriodScope(code, *MARCH))
    return {(r.rule_key, r.subject_key): r for r in engine.findings().collect()}


def test_planted_defects_are_found_and_no_others(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    made = world.seed(engine.store)
    stored.register(engine.store)
    for d in shipped():
        engine.register(d)
    per_rule = {"HCP-NPI-FORMAT": 5, "HCP-DUP-NPI": 3, "HCP-DUP-COMPOSITE": 2, "SALES-ORPHAN-REF": 3, "SALES-NO-ALIGNMENT": 2, "SALES-UOM-MISMATCH": 2, "ALIGN-OVERLAP-GAP": 3, "VOL-DEVIATION": 1, "FEED-LATE-MISSING": 1}
    assert Counter(rule for rule, _ in made.expected) == per_rule and set(per_rule) == {d.rule_key for d in shipped()}
    assert sorted(made.batches.values()) == [1, 2, 3, 4, 5]
    headers = engine.store.read("data_batch").collect()
    counts = engine.store.read("sales_transaction").groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in counts if r.batch_id != 3} == {b: 60 for b in (1, 2, 4, 5)}
    assert [r.record_count for r in sorted(headers)] == [108, 90, 90, 108, 90]
    first = engine.run(BatchScope(3))
    got = found(engine, 3)
    assert set(got) == made.expected
    volume = got["VOL-DEVIATION", "A1.02:G1.00"]
    assert (volume.offending_value, volume.observed_value, volume.expected_value) == (None, "35.0", "20")
    feed = got["FEED-LATE-MISSING", "BIRCH:2025-03-01"]
    assert (feed.observed_value, feed.expected_value) == ("never delivered", "2025-04-06 00:00:00")
    assert {r.offending_value for (k, _), r in got.items() if k == "SALES-NO-ALIGNMENT"} == {"A1.01", "A1.02"}
    assert {r.offending_value for (k, _), r in got.items() if k == "SALES-ORPHAN-REF"} == {"hcp:P-later", "product:G-never", "hcp:P-never"}
    assert {r.offending_value for (k, _), r in got.items() if k == "HCP-DUP-COMPOSITE"} == {"odellray|q|70707|me"}
    assert {r.expected_value for (k, _), r in got.items() if k == "SALES-UOM-MISMATCH"} == {"VIAL"}

    # the world moves: a replay keeps to its pins, a fresh run sees units that no longer agree
    assert world.amend(engine.store) == 6
    assert engine.run(replay_of=first.rule_run_id).finding_count == 0
    assert engine.run(BatchScope(3)).outcomes["SALES-UOM-MISMATCH"][1] > 0
    assert engine.retire_feed(2, dt.date(2025, 4, 1)) and not engine.retire_feed(9, dt.date(2025, 4, 1))
    october = engine.run(SourcePeriodScope("BIRCH", *month("2025-04")))
    assert october.outcomes["FEED-LATE-MISSING"] == ("EVALUATED", 0, None)


def test_clean_world_and_console(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    for d in shipped():
        engine.register(d)
    console = Console(engine)
    assert console.dispatch("GET", "/api/nightly-load", {}, b"")[0] == 400
    made = world.seed(engine.store, with_defects=False)
    assert len(made.batches) == 6 and not made.expected
    assert console.load()["run_status"] == "NOT RUN"
    asked = {ACTION[0]: ACTION[1], "content-type": "application/json"}
    status, _, body = console.dispatch("POST", "/api/nightly-load/run", asked, b'{"period": "2025-03"}')
    state = json.loads(body)
    assert status == 200 and state["run_status"] == "COMPLETED" and state["findings_count"] == 0 and state["records_evaluated"] == 180
    assert len(state["runs"]) == 4 and state["rules_evaluated"] == 9 and state["reference_watermark"] == 6
    for method, target, headers, body, want in [
        ("GET", "/api/health", {}, b"", 200), ("GET", "/", {}, b"", 200), ("GET", "/secret", {}, b"", 404), ("GET", "/api/nightly-load?period=2026-13", {}, b"", 400),
        ("GET", "/api/nightly-load?other=1", {}, b"", 400), ("POST", "/api/nightly-load/run", {}, b"{}", 403), ("POST", "/api/nightly-load/run", asked, b'{"period": "2025-03", "x": 1}', 400),
        ("POST", "/api/nightly-load/run", asked, b" " * 5000, 400), ("GET", "/api/nightly-load?period=2020-01", {}, b"", 400),
        ("GET", "/api/nightly-load?period=2025-03&period=2025-02", {}, b"", 400), ("POST", "/api/nightly-load/run", asked, b'{"period": "2025-03", "period": "2025-03"}', 400), ("POST", "/api/nightly-load/run", asked, b'{"period": 3}', 400),
        ("POST", "/api/nightly-load/run", asked, b'["period"]', 400), ("POST", "/api/nightly-load/run", asked, b"{", 400), ("POST", "/api/nightly-load/run", asked | {"content-type": "text/plain"}, b'{"period": "2025-03"}', 400), ("POST", "/api/health", {}, b"", 404),
    ]:
        assert console.dispatch(method, target, headers, body)[0] == want, target


def test_command_line(spark, tmp_path, capsys):
    def run(*argv):
        code = cli.main(["--workspace", str(tmp_path / "w"), *argv], spark)
        return code, capsys.readouterr().out

    assert "expected findings: 22" in run("seed", "--show-expected")[1]
    assert run("rules", "register")[1].count("created") == 9 and run("rules", "register")[1].count("unchanged") == 9
    assert "COMPLETED" in run("run-rules", "--batch-id", "3", "--rule", "HCP-NPI-FORMAT")[1]
    assert run("findings", "--rule", "HCP-NPI-FORMAT")[1].count("HCP-NPI-FORMAT") == 5
    assert "total findings: 5" in run("summarise", "--batch-id", "3")[1]
    assert run("rules", "deactivate", "HCP-NPI-FORMAT")[0] == 0 and run("rules", "activate", "NONE")[0] == 1
    assert run("run-rules", "--batch-id", "3", "--source", "ALDER")[0] == 1 and run("run-rules", "--replay-of", "99")[0] == 1
    assert "amendment batch: 6" in run("seed", "--amend-master")[1]


def test_stream_of_headers(spark, tmp_path):
    engine = engine_of(spark, tmp_path / "w")
    for d in shipped()[4:5]:
        engine.register(d)
    world.seed(engine.store)
    header = (7, 1, dt.datetime(2025, 5, 3, tzinfo=dt.timezone.utc), *month("2025-04"), 1)
    engine.store.append("hcp", [(900, 1, "HCP-LATE", dt.date(2025, 4, 1), 7, False, "12", "A", "B", "1", "CA", None)])
    landing = str(tmp_path / "landing")
    spark.createDataFrame([header, header], SCHEMAS["data_batch"]).write.parquet(landing)
    results = []
    watch(engine, landing, str(tmp_path / "ck"), once=True, each=results.append).awaitTermination()
    assert [(r.scope_key, r.finding_count) for r in results] == [("b:7", 1)]
    watch(engine, landing, str(tmp_path / "ck"), once=True, each=results.append).awaitTermination()
    assert len(results) == 1 and engine.store.read("data_batch").filter("batch_id = 7").count() == 1


@pytest.mark.parametrize("bad", ["2026-13", "2026-9", "26-09", "2026-00", "2026/09"])
def test_month(bad):
    assert month("2026-12") == (dt.date(2026, 12, 1), dt.date(2027, 1, 1))
    with pytest.raises(ValueError):
        month(bad)
