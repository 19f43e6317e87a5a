"""The registered queries: each operator applied to the derived commercial world, with its SQL for DuckDB.

A query is one statement; Catalyst chooses joins, prunes columns and pushes filters into the Parquet scans."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.engine.runner import BatchScope, Engine
from assay.engine.store import Store
from assay.functions.scalars import covers, overlaps, range_text
from assay.rules.definition import RuleDefinition
from assay.rules.library import shipped
from assay.sources.derived import PINS, duck_with, register, scratch, with_views

from . import oracles

RULES = {r.rule_key: r for r in shipped()}
EVERY_BATCH = "in (select batch_id from data_batch)"
EVERY_SOURCE = "in (select source_system_id from source_system)"


def bound(sql: str) -> str:
    """The statement over the scopes of every batch or every source, with the values that a run pins."""
    values = {"as_of_date": f"date'{PINS['as_of_date']}'", "reference_watermark": str(PINS["reference_watermark"]), "scope_period_start": f"date'{PINS['period_start']}'", "scope_period_end": f"date'{PINS['period_end']}'", "threshold_pct": "20"}
    sql = sql.replace("= :batch_id", EVERY_BATCH).replace("= :scope_source_system_id", EVERY_SOURCE)
    return re.sub(r":(\w+)", lambda m: values.get(m[1], m[0]), sql)


def _rule(key: str) -> str:
    return bound(RULES[key].predicate_sql)


#: Late and missing feeds of all months in one statement; the shipped rule's is for the scope of one.
_LATE = f"""select s.code || ':' || cast(p.period_start as string) as subject_key, cast(null as string) as offending_value, coalesce(cast(max(b.arrival_ts) as string), 'never delivered') as observed_value,
  cast(cast(date_add(p.period_end, cast(max(f.delivery_days) as int)) as timestamp) as string) as expected_value
from source_system s join feed_expectation f on f.source_system_id = s.source_system_id cross join (select distinct period_start, period_end from data_batch) p
left join data_batch b on b.source_system_id = s.source_system_id and {overlaps("b.period_start", "b.period_end", "p.period_start", "p.period_end")}
where {covers("f.active_from", "f.active_to", "p.period_start")}
group by s.code, p.period_start, p.period_end
having min(b.arrival_ts) is null or min(b.arrival_ts) > cast(date_add(p.period_end, cast(max(f.delivery_days) as int)) as timestamp)"""

_UNION = " union all ".join(
    f"select '{k}' as rule_key, '{r.domain}' as domain, '{r.dimension}' as dimension, '{r.owning_function}' as owning_function, '{r.severity}' as severity, '{r.subject_type}' as subject_type, subject_key, offending_value, observed_value, expected_value from ({_rule(k)}) f{i}"
    for i, (k, r) in enumerate(RULES.items())
    if r.subject_type == "record"
)
#: Findings as two versions of each rule would leave them: version 2 found every subject but those that end in 7.
_VERSIONED = f"select u.*, v.version_no, case when v.version_no = 1 then 'b:1' else 'b:2' end as scope_key from ({_UNION}) u cross join (select 1 as version_no union all select 2 as version_no) v where v.version_no = 1 or right(u.subject_key, 1) <> '7'"
_DEDUPED = f"select * from (select f.*, row_number() over (partition by rule_key, subject_key order by version_no desc, coalesce(offending_value, ''), coalesce(observed_value, '')) as rn from ({_VERSIONED}) f) g where rn = 1"
#: A run of each rule over each batch: outcomes as the run log would hold them.
_OUTCOMES = f"""select b.batch_id as rule_run_id, 'b:' || cast(b.batch_id as string) as scope_key, k.rule_key, case when (b.batch_id + length(k.rule_key)) % 3 = 0 then 'ERRORED' else 'EVALUATED' end as outcome,
  cast((b.batch_id * length(k.rule_key)) % 11 as int) as finding_count from data_batch b cross join ({" union all ".join(f"select '{k}' as rule_key" for k in RULES)}) k """
_SEVERITY = "case severity when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end"
_WINDOWED = "select source_system_id, source_key, valid_from, hcp_id"

QUERIES: dict[str, str] = {
    **{"rule_" + k.lower().replace("-", "_"): _rule(k) for k, r in RULES.items() if r.subject_type == "record"},
    "rule_feed_late_missing": _rule("FEED-LATE-MISSING"),
    "rule_vol_deviation": _rule("VOL-DEVIATION"),
    "feeds_late_every_period": _LATE,
    "asof_latest_version": f"select source_system_id, source_key, max(valid_from) as valid_from, max_by(uom, valid_from) as uom, max_by(is_deleted, valid_from) as is_deleted from product where valid_from <= date'{PINS['as_of_date']}' and batch_id <= 195 group by source_system_id, source_key",
    "latest_rule_version": f"select rule_key, max(version_no) as version_no from ({_VERSIONED}) f group by rule_key",
    "watermark_scalar": "select coalesce(max(batch_id), 0) as watermark from data_batch",
    "scope_resolution": "select 'b:' || cast(b.batch_id as string) as scope_key, s.code, b.period_start, b.period_end, date_add(b.period_end, -1) as as_of_date from data_batch b join source_system s on s.source_system_id = b.source_system_id",
    "findings_union_contract": _UNION,
    "findings_filtered": f"select rule_key, severity, subject_key, offending_value from ({_UNION}) f where domain = 'SALES' and severity = 'HIGH'",
    "findings_top500": f"select rule_key, severity, subject_key, version_no from ({_VERSIONED}) f order by {_SEVERITY}, rule_key desc, subject_key desc, version_no, coalesce(offending_value, '') limit 500",
    "findings_text_search": f"select rule_key, owning_function, subject_key from ({_UNION}) f where severity = 'HIGH' and contains(lower(subject_key || ' ' || rule_key || ' ' || owning_function), 'commercial')",
    "summary_by_domain": f"select domain, count(*) as findings from ({_DEDUPED}) d group by domain",
    "summary_by_rule": f"select rule_key, domain, count(*) as findings from ({_DEDUPED}) d group by rule_key, domain",
    "summary_by_severity": f"select severity, count(*) as findings from ({_DEDUPED}) d group by severity",
    "summary_grouping_sets": f"select domain, rule_key, severity, count(*) as findings from ({_DEDUPED}) d group by grouping sets ((domain), (rule_key), (severity), ())",
    "summary_version_dedup": f"select rule_key, subject_key, version_no from ({_DEDUPED}) d",
    "distinct_subjects": f"select rule_key, count(distinct subject_key) as subjects from ({_VERSIONED}) d group by rule_key",
    "counts_by_dimension": f"select dimension, count(*) as findings from ({_VERSIONED}) f group by dimension",
    "counts_by_severity_raw": f"select severity, count(*) as findings from ({_VERSIONED}) f group by severity",
    "owner_tally": f"select owning_function, count(*) as findings from ({_UNION}) f group by owning_function",
    "run_views": f"select rule_run_id, scope_key, count(*) as evaluated, count(*) filter (where outcome = 'ERRORED') as errored, cast(coalesce(sum(finding_count), 0) as bigint) as new_findings from ({_OUTCOMES}) o group by rule_run_id, scope_key",
    "latest_run_per_source": "select source_system_id, max(batch_id) as latest_batch, max_by(arrival_ts, batch_id) as arrival_ts from data_batch group by source_system_id",
    "errored_rules_latest_run": f"select rule_key, outcome from ({_OUTCOMES}) o where outcome = 'ERRORED' and rule_run_id = (select max(rule_run_id) from ({_OUTCOMES}) p)",
    "nightly_batches": f"select b.batch_id, s.code, b.record_count, b.arrival_ts from data_batch b join source_system s on s.source_system_id = b.source_system_id where b.period_start = date'{PINS['period_start']}' and b.period_end = date'{PINS['period_end']}'",
    "nightly_totals": "select period_start, cast(sum(record_count) as bigint) as records, max(batch_id) as watermark, count(*) as batches from data_batch group by period_start",
    "period_list": "select distinct substr(cast(period_start as string), 1, 7) as period from data_batch",
    "historical_vs_fresh_watermark": "select h.batch_id, count(*) as versions, count(*) filter (where h.batch_id <= 190) as historical, count(*) filter (where h.batch_id <= 195) as fresh from hcp h group by h.batch_id",
    "master_chain_uniqueness_check": "select source_system_id, source_key, valid_from, count(*) as versions from hcp group by source_system_id, source_key, valid_from having count(*) > 1",
    "range_overlap_self_join": f"select a.alignment_id, b.alignment_id as other_id, {range_text('a.effective_from', 'a.effective_to')} as effective from territory_alignment a join territory_alignment b on a.source_system_id = b.source_system_id and a.hcp_source_key = b.hcp_source_key and a.alignment_id < b.alignment_id and {overlaps('a.effective_from', 'a.effective_to', 'b.effective_from', 'b.effective_to')}",
    "range_containment": f"select alignment_id from territory_alignment where {covers('effective_from', 'effective_to', chr(100) + 'ate' + chr(39) + '1998-01-01' + chr(39))}",
    "null_safe_row_diff": "select a.source_key, a.valid_from from hcp a join hcp b on a.source_system_id = b.source_system_id and a.source_key = b.source_key and a.hcp_id < b.hcp_id where a.npi is distinct from b.npi or a.batch_id is distinct from b.batch_id",
    "null_marker_projection": "select source_key, hcp_id, coalesce(npi, '<absent>') as npi, cast(null as string) as observed_value from hcp where npi is null or length(npi) < 10",
    "semi_join_partners": "select h.source_key, h.hcp_id from hcp h where exists (select 1 from hcp o where o.npi = h.npi and o.source_key <> h.source_key)",
    "anti_join_uncovered": f"select t.source_txn_key, t.txn_date from sales_transaction t where not exists (select 1 from territory_alignment a where a.source_system_id = t.source_system_id and a.hcp_source_key = t.hcp_key and a.territory_code = t.territory_code and {covers('a.effective_from', 'a.effective_to', 't.txn_date')})",
    "left_outer_batches": "select s.code, count(b.batch_id) as batches from source_system s left join data_batch b on b.source_system_id = s.source_system_id and b.record_count > 10 group by s.code",
    "window_ranking": f"{_WINDOWED}, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(3) over w as nt from hcp window w as (partition by source_system_id, source_key order by valid_from, hcp_id)",
    "window_offsets": f"{_WINDOWED}, lead(hcp_id) over w as next_id, lag(hcp_id) over w as previous_id, first_value(hcp_id) over w as first_id, last_value(hcp_id) over w as last_id, nth_value(hcp_id, 2) over w as second_id from hcp window w as (partition by source_system_id, source_key order by valid_from, hcp_id)",
    "set_union_subjects": f"select subject_key from ({_rule('HCP-DUP-NPI')}) a union select subject_key from ({_rule('HCP-NPI-FORMAT')}) b",
    "set_intersect_subjects": f"select subject_key from ({_rule('HCP-DUP-NPI')}) a intersect select subject_key from ({_rule('HCP-NPI-FORMAT')}) b",
    "set_except_subjects": f"select subject_key from ({_rule('HCP-DUP-NPI')}) a except select subject_key from ({_rule('HCP-NPI-FORMAT')}) b",
    "volume_single_pass": "select territory_code, product_key, sum(case when txn_date >= date'1998-03-01' then quantity end) as now_units, sum(case when txn_date < date'1998-03-01' then quantity end) as prior_units from sales_transaction where txn_date >= date'1998-01-29' and txn_date < date'1998-04-01' group by territory_code, product_key",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        register(spark, sf_dir)
        return spark.sql(QUERIES[name])

    return run


#: Rules that the engine's queries run, over these batches' scopes; the second time with one that can't be evaluated.
RUN, BATCHES = ("HCP-DUP-NPI", "HCP-NPI-FORMAT", "SALES-UOM-MISMATCH"), (191, 192)
BROKEN = RuleDefinition(
    "SALES-BROKEN", "SALES", "validity", "LOW", "Nobody", "record",
    "select cast(t.txn_id as string) as subject_key, cast(1 div (t.txn_id - t.txn_id) as string) as offending_value, cast(null as string) as observed_value, cast(null as string) as expected_value from sales_transaction t where t.batch_id = :batch_id",
)
_ran: dict[tuple[str, str], Engine] = {}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine after three runs in a store of its own, made once for an application and input: of the first batch, its
    replay, and of the second batch with the broken rule too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    register(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ran:
        engine = Engine(Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}"))
        for rule in (*(RULES[k] for k in RUN), BROKEN):
            engine.register(rule)
        first = engine.run(BatchScope(BATCHES[0]), rule_keys=list(RUN))
        engine.run(replay_of=first.rule_run_id)
        engine.run(BatchScope(BATCHES[1]))
        _ran[key] = engine
    return _ran[key]


def engine_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three runs of the engine, one of them a replay, left as findings."""
    return _engine(spark, sf_dir).findings().select("rule_run_id", "rule_key", "scope_key", "subject_key", "offending_value", "severity")


def engine_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's rules with their outcomes, from the engine's log."""
    engine = _engine(spark, sf_dir)
    runs = engine.store.latest("rule_run", "rule_run_id").select("rule_run_id", "scope_key", "status", "replay_of_rule_run_id")
    rules = engine.store.read("rule_version").join(engine.store.latest("rule", "rule_key"), "rule_id").select("rule_version_id", "rule_key")
    log = engine.store.read("rule_run_rule_version").select("rule_run_id", "rule_version_id", "outcome", "finding_count")
    return log.join(runs, "rule_run_id").join(rules, "rule_version_id").drop("rule_version_id")


def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's own summary of both batches' scopes."""
    engine = _engine(spark, sf_dir)
    rows = [(batch, kind, label, n) for batch in BATCHES for kind, counts in engine.summary(BatchScope(batch)).items() for label, n in counts.items()]
    return spark.createDataFrame(rows, "batch_id int, kind string, label string, findings long")


ENGINE = {f.__name__: f for f in (engine_findings, engine_run_log, engine_summary)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in QUERIES} | ENGINE


def oracle_sql() -> dict[str, str]:
    """The nine rules by statements of their own; all other queries by theirs in the other dialect."""
    own = {name: with_views(sql) for name, sql in oracles.RULES.items()}
    return {name: duck_with(sql) for name, sql in QUERIES.items() if name not in own} | own | {name: with_views(sql) for name, sql in oracles.engine({k: RULES[k] for k in RUN}, BATCHES, BROKEN.rule_key).items()}
