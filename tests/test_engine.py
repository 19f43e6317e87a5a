"""The rule engine over the derived world: registration, idempotent runs, errors, replay, summaries, and the gate."""

import datetime as dt

import duckdb
import pytest

from assay.engine.runner import BatchScope, Engine, InvalidRunRequestError, ReplaySourceError, ScopeNotFoundError, SourcePeriodScope
from assay.engine.store import ChainError, RoleError, Store
from assay.functions.scalars import npi_check_digit
from assay.operators import catalogue
from assay.rules.definition import RuleDefinition, RuleDefinitionError, export, load_definition, load_library
from assay.rules.library import shipped
from assay.rules.predicates import validate
from assay.sources.derived import register

SF = "/root/testdata/sf0.01"
GOOD = "select h.source_key as subject_key, 'x' as offending_value, cast(null as string) as observed_value, cast(null as string) as expected_value from hcp h where h.batch_id = :batch_id and h.valid_from <= :as_of_date and h.batch_id <= :reference_watermark"


@pytest.fixture()
def engine(spark, tmp_path):
    register(spark, SF)
    return Engine(Store(spark, str(tmp_path / "store")))


def test_runs_are_idempotent_and_replay_equals(engine):
    rules = [r for r in shipped() if r.rule_key in ("HCP-NPI-FORMAT", "HCP-DUP-NPI", "VOL-DEVIATION")]
    assert [engine.register(r) for r in rules] == ["created"] * 3 and engine.register(rules[0]) == "unchanged"
    first = engine.run(BatchScope(1))
    assert first.status == "COMPLETED" and first.finding_count > 0 and "VOL-DEVIATION" not in first.outcomes
    assert engine.run(BatchScope(1)).finding_count == 0
    assert engine.run(replay_of=first.rule_run_id).finding_count == 0
    assert sum(engine.summary(BatchScope(1))["rule_key"].values()) == engine.findings(batch_id=1).count() == first.finding_count
    period = engine.run(SourcePeriodScope("ASIA", dt.date(1998, 3, 1), dt.date(1998, 4, 1)))
    assert list(period.outcomes) == ["VOL-DEVIATION"]
    with pytest.raises(InvalidRunRequestError):
        engine.run(BatchScope(1), replay_of=1)
    with pytest.raises(ReplaySourceError):
        engine.run(replay_of=3)
    with pytest.raises(ScopeNotFoundError):
        engine.run(BatchScope(-1))


def test_errors_leave_other_rules_alone(engine):
    bad = RuleDefinition("BAD-RULE", "HCP", "validity", "LOW", "Somebody", "record", GOOD.replace("cast(null as string) as observed", "cast(1 div (h.hcp_id - h.hcp_id) as string) as observed"), {})
    good = RuleDefinition("GOOD-RULE", "HCP", "validity", "LOW", "Somebody", "record", GOOD, {})
    engine.register(bad), engine.register(good)
    got = engine.run(BatchScope(1))
    assert got.status == "COMPLETED_WITH_ERRORS" and got.outcomes["BAD-RULE"][0] == "ERRORED" and got.outcomes["GOOD-RULE"][1] > 0
    assert engine.set_active("GOOD-RULE", False) and not engine.set_active("NONE", True)
    assert list(engine.run(BatchScope(2)).outcomes) == ["BAD-RULE"]


@pytest.mark.parametrize("label, sql", [
    ("1", GOOD + "; drop table hcp"), ("1", "delete from hcp"), ("2", GOOD.replace("as observed_value", "as seen")), ("3", GOOD + " and h.valid_from < current_date"),
    ("4", GOOD + " and exists (select 1 from explode(array(1)))"), ("5", GOOD + " and exists (select 1 from other o)"), ("5", GOOD.replace("from hcp h", "from dq.hcp h")),
    ("6", GOOD + " limit 3"), ("7", GOOD.replace("h.valid_from <= :as_of_date", "true")), ("7", GOOD + " and exists (select 1 from hcp o where o.npi = h.npi)"),
    ("8", GOOD + " and h.npi = :unknown"), ("8b", GOOD.replace(":batch_id", ":batch_id::int")), ("FR-016d", GOOD + " and levenshtein(h.npi, 'x') < 2"),
])
def test_gate(label, sql):
    validate(GOOD, {})
    with pytest.raises(RuleDefinitionError, match=f"^rule {label}:"):
        validate(sql, {})


PARITY = [
    ("3", GOOD + " and h.valid_from < now()"), ("3", GOOD.replace(":as_of_date", "current_date")), ("3", GOOD + " and rand() < 0.5"), ("FR-016d", GOOD + " and levenshtein(h.last_name, 'Smith') < 3"),
    ("FR-016d", GOOD + " and similarity(h.last_name, 'Smith') > 0.8"), ("2", GOOD.replace("as offending_value", "as bad_value")), ("5", GOOD.replace("from hcp h", "from hcp h, pg_catalog.pg_class pc")),
    ("7", GOOD.replace("and h.batch_id <= :reference_watermark", "")), ("8", GOOD + " and h.npi rlike :some_pattern"), ("1", GOOD + "; drop table hcp"), ("4", GOOD.replace("from hcp h", "from range(1, 10) g, hcp h")),
    ("8b", GOOD.replace(":as_of_date", ":as_of_date::date")),
    # by the plan alone: the text of these looks well
    ("5", GOOD.replace("from hcp h", "from hcp h, orders o")), ("7", GOOD.replace("from hcp h", "from hcp h, product p")), ("7", GOOD + " or true"), ("6", GOOD + " order by h.source_system_id limit 3"),
    ("3", GOOD + " and uniform(1, 10) > 3"), ("3", GOOD + " and h.valid_from < curdate()"), ("7", GOOD + " and exists (select 1 from hcp o where o.npi = h.npi and h.valid_from <= :as_of_date and h.batch_id <= :reference_watermark)"),
    ("7", GOOD.replace("h.valid_from <= :as_of_date", "h.valid_from <= date'1801-02-03' + 1")), ("7", GOOD.replace("from hcp h", "from hcp h left join product p on h.valid_from <= :as_of_date and h.batch_id <= :reference_watermark").replace("and h.valid_from", "and p.valid_from").replace("and h.batch_id", "and p.batch_id", 1)),
    ("4", GOOD.replace("from hcp h", "from hcp h lateral view explode(array(1, 2)) e as x")), ("6", GOOD.replace("'x' as offending_value", "first_value(h.npi) over (partition by h.source_key order by h.npi) as offending_value")),
]
ADMITTED = [
    GOOD, GOOD + " order by h.npi, h.hcp_id limit 3", GOOD.replace("h.valid_from <= :as_of_date", ":as_of_date >= h.valid_from"), GOOD.replace("'x' as offending_value", "lag(h.npi) over (partition by h.source_key order by h.valid_from) as offending_value"),
    "with v as (select * from hcp x where x.valid_from <= :as_of_date and x.batch_id <= :reference_watermark) select v.source_key as subject_key, v.npi as offending_value, cast(null as string) as observed_value, cast(null as string) as expected_value from v where v.batch_id = :batch_id",
]


@pytest.mark.parametrize("k", range(len(PARITY)))
def test_gate_on_the_analysed_plan(spark, k):
    register(spark, SF)
    label, sql = PARITY[k]
    with pytest.raises(RuleDefinitionError, match=f"^rule {label}:"):
        validate(sql, {}, spark)


def test_gate_admits(spark):
    register(spark, SF)
    for sql in ADMITTED:
        validate(sql, {}, spark)
    for r in shipped():
        validate(r.predicate_sql, r.parameters, spark)
    d = RuleDefinition("CONFORMITY-RULE", "HCP", "conformity", "LOW", "Somebody", "record", GOOD, {})
    assert d.dimension == "conformity"
    for bad in ({"dimension": "accuracy"}, {"predicate_sql": " "}, {"owning_function": ""}, {"rule_key": "lower"}, {"parameters": {"1x": 1}}):
        with pytest.raises(RuleDefinitionError):
            RuleDefinition(**{**d.__dict__, **bad})


def test_rules_as_files(tmp_path):
    made = export(shipped(), tmp_path / "rules")
    assert len(made) == 9 and load_library(tmp_path / "rules") == sorted(shipped(), key=lambda r: r.rule_key.lower().replace("-", "_"))
    (tmp_path / "rules" / "again.json").write_text(made[0].read_text())
    with pytest.raises(RuleDefinitionError, match="repeated"):
        load_library(tmp_path / "rules")
    odd = tmp_path / "odd.json"
    for text in ('{"rule_key": "X"}', "[1]", "{", made[0].read_text().replace('"domain"', '"realm"')):
        odd.write_text(text)
        with pytest.raises(RuleDefinitionError, match=str(odd)):
            load_definition(odd)


def test_roles(engine):
    rule = next(r for r in shipped() if r.rule_key == "HCP-DUP-NPI")
    author, runner, reader = (Engine(engine.store.acting_as(role)) for role in ("author", "engine", "readonly"))
    for other in (runner, reader, Engine(engine.store.acting_as("ingest"))):
        with pytest.raises(RoleError):
            other.register(rule)
    assert author.register(rule) == "created"
    for other in (author, reader):
        with pytest.raises(RoleError):
            other.run(BatchScope(1))
    assert runner.run(BatchScope(1)).finding_count > 0 and reader.findings().count() == engine.findings().count() > 0
    ingest = engine.store.acting_as("ingest")
    for store, table in ((ingest, "finding"), (ingest, "rule")):
        with pytest.raises(RoleError):
            store.read(table)
    with pytest.raises(RoleError):
        runner.store.append("source_system", [(1, "X", "X")])
    with pytest.raises(RoleError):
        reader.store.acting_as("owner")


def test_a_version_is_delivered_once(engine):
    row = (1, 1, "A", dt.date(2025, 1, 1), 1, False, "T", "Area")
    store = engine.store
    store.append("territory", [row, (2, 1, "A", dt.date(2025, 2, 1), 1, False, "T", "Area")])
    for rows in ([row], [(3, 1, "B", dt.date(2025, 1, 1), 2, False, "T", "x"), (4, 1, "B", dt.date(2025, 1, 1), 2, False, "T", "y")]):
        with pytest.raises(ChainError):
            store.append("territory", rows)
    assert store.read("territory").count() == 2


def test_replay_is_refused(engine):
    engine.register(next(r for r in shipped() if r.rule_key == "HCP-DUP-NPI"))
    done = engine.run(BatchScope(1)).rule_run_id
    again = engine.run(replay_of=done).rule_run_id
    log = engine.store.read("rule_run").filter(f"rule_run_id = {done} and status = 'COMPLETED'").first()
    for k, change in enumerate(({"status": "RUNNING"}, {"status": "FAILED"}, {"status": "COMPLETED_WITH_ERRORS"}, {"session_settings": log.session_settings.replace("UTC", "CET")}, {"session_settings": "{}"}, {"reference_watermark": 7})):
        engine.store.append("rule_run", [tuple((log.asDict() | {"rule_run_id": 900 + k, "seq": 900 + k} | change).values())])
    for run in (again, 999, *range(900, 906)):
        with pytest.raises(ReplaySourceError):
            engine.run(replay_of=run)
    with pytest.raises(InvalidRunRequestError):
        SourcePeriodScope("ASIA", dt.date(1998, 4, 1), dt.date(1998, 4, 1))


def test_check_digit():
    assert npi_check_digit("123456789") == 3


def test_one_process_at_a_time(engine):
    here, there = engine.store, Store(engine.spark, engine.store.path)
    with here.exclusive("b:1-1"), pytest.raises(TimeoutError, match="b_1-1"), there.exclusive("b:1-1", wait=0.2):
        pass
    with here.exclusive("b:1-1"), there.exclusive("b:1-2"):
        pass
    with there.exclusive("b:1-1", wait=0.2):
        pass


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue_agrees_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(catalogue.oracle_sql()[name])
    cols = sorted(got.columns)
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())
