"""The nine shipped rules. Each predicate is one SELECT of failing subjects in four text columns."""

from __future__ import annotations

from assay.functions.scalars import covers, folded, luhn_sum, overlaps, range_text

from .definition import RuleDefinition

VISIBLE = "{a}.valid_from <= :as_of_date and {a}.batch_id <= :reference_watermark"


def _seen(a: str) -> str:
    return VISIBLE.format(a=a)


_KEYS = [("last_name", "{}"), ("first_name", "left({}, 1)"), ("postal_code", "left({}, 5)"), ("licence_state", "{}")]


def _key(a: str) -> list[str]:
    return [shape.format(folded(f"{a}.{c}")) for c, shape in _KEYS]


NPI_FORMAT = f"""
select cast(h.hcp_id as string) as subject_key, coalesce(h.npi, '<absent>') as offending_value, cast(null as string) as observed_value, '10 digits with a valid NPI check digit' as expected_value
from hcp h where h.batch_id = :batch_id and {_seen("h")} and not h.is_deleted
  and (h.npi is null or not (h.npi rlike '^[0-9]{{10}}\\\\z') or case when h.npi rlike '^[0-9]{{10}}\\\\z' then {luhn_sum("h.npi")} % 10 <> 0 else false end)"""

DUP_NPI = f"""
select cast(h.hcp_id as string) as subject_key, h.npi as offending_value, cast(null as string) as observed_value, cast(null as string) as expected_value
from hcp h where h.batch_id = :batch_id and {_seen("h")} and not h.is_deleted and h.npi is not null
  and exists (select 1 from hcp o where o.npi = h.npi and {_seen("o")} and not o.is_deleted and (o.source_system_id <> h.source_system_id or o.source_key <> h.source_key))"""

DUP_COMPOSITE = f"""
select cast(h.hcp_id as string) as subject_key, {" || '|' || ".join(_key("h"))} as offending_value, cast(null as string) as observed_value, cast(null as string) as expected_value
from hcp h where h.batch_id = :batch_id and {_seen("h")} and not h.is_deleted and {" and ".join(f"h.{c} is not null" for c, _ in _KEYS)}
  and exists (select 1 from hcp o where {_seen("o")} and not o.is_deleted and {" and ".join(f"{a} = {b}" for a, b in zip(_key("o"), _key("h"), strict=True))} and (o.source_system_id <> h.source_system_id or o.source_key <> h.source_key))"""

_NO_HCP = f"not exists (select 1 from hcp h where h.source_system_id = t.source_system_id and h.source_key = t.hcp_key and {_seen('h')} and not h.is_deleted)"
_NO_PRODUCT = f"not exists (select 1 from product p where p.source_system_id = t.source_system_id and p.source_key = t.product_key and {_seen('p')} and not p.is_deleted)"
ORPHAN_REF = f"""
select cast(x.txn_id as string) as subject_key, case when x.no_hcp then 'hcp:' || x.hcp_key else 'product:' || x.product_key end as offending_value, cast(null as string) as observed_value, cast(null as string) as expected_value
from (select t.txn_id, t.hcp_key, t.product_key, {_NO_HCP} as no_hcp, {_NO_PRODUCT} as no_product from sales_transaction t where t.batch_id = :batch_id) x
where x.no_hcp or x.no_product"""

NO_ALIGNMENT = f"""
select cast(t.txn_id as string) as subject_key, t.territory_code as offending_value, cast(t.txn_date as string) as observed_value, cast(null as string) as expected_value
from sales_transaction t where t.batch_id = :batch_id and not exists (
  select 1 from territory_alignment a where a.source_system_id = t.source_system_id and a.hcp_source_key = t.hcp_key and a.territory_code = t.territory_code
    and a.batch_id <= :reference_watermark and {covers("a.effective_from", "a.effective_to", "t.txn_date")})"""

_SAME = "{o}.source_system_id = a.source_system_id and {o}.hcp_source_key = a.hcp_source_key and {o}.alignment_id <> a.alignment_id and {o}.batch_id <= :reference_watermark"
OVERLAP_GAP = f"""
select cast(a.alignment_id as string) as subject_key, {range_text("a.effective_from", "a.effective_to")} as offending_value, a.hcp_source_key as observed_value, cast(null as string) as expected_value
from territory_alignment a where a.batch_id = :batch_id and (
  exists (select 1 from territory_alignment o where {_SAME.format(o="o")} and {overlaps("a.effective_from", "a.effective_to", "o.effective_from", "o.effective_to")})
  or (exists (select 1 from territory_alignment n where {_SAME.format(o="n")} and n.effective_from > a.effective_to)
      and not exists (select 1 from territory_alignment c where {_SAME.format(o="c")} and {covers("c.effective_from", "c.effective_to", "a.effective_to")})))"""

UOM_MISMATCH = f"""
select cast(t.txn_id as string) as subject_key, t.uom as offending_value, t.uom as observed_value, m.uom as expected_value
from sales_transaction t join (
  select p.source_system_id, p.source_key, max_by(p.uom, p.valid_from) as uom, max_by(p.is_deleted, p.valid_from) as is_deleted
  from product p where {_seen("p")} group by p.source_system_id, p.source_key) m
on m.source_system_id = t.source_system_id and m.source_key = t.product_key and not m.is_deleted
where t.batch_id = :batch_id and m.uom is not null and t.uom <> m.uom"""

LATE_MISSING = f"""
select s.code || ':' || cast(:scope_period_start as string) as subject_key, cast(null as string) as offending_value,
  coalesce(cast(b.latest as string), 'never delivered') as observed_value, cast(cast(date_add(:scope_period_end, f.delivery_days) as timestamp) as string) as expected_value
from feed_expectation f join source_system s on s.source_system_id = f.source_system_id
left join (select d.source_system_id, max(d.arrival_ts) as latest, min(d.arrival_ts) as first from data_batch d
  where d.batch_id <= :reference_watermark and {overlaps("d.period_start", "d.period_end", "cast(:scope_period_start as date)", "cast(:scope_period_end as date)")} group by d.source_system_id) b on b.source_system_id = f.source_system_id
where f.source_system_id = :scope_source_system_id and {covers("f.active_from", "f.active_to", "cast(:scope_period_start as date)")}
  and (b.first is null or b.first > cast(date_add(:scope_period_end, f.delivery_days) as timestamp))"""

VOLUME = """
select x.territory_code || ':' || x.product_key as subject_key, cast(null as string) as offending_value,
  cast(cast(((cast(abs(x.units - x.prior) * 10000 as bigint) * 2000 + cast(x.prior * 10000 as bigint)) div (2 * cast(x.prior * 10000 as bigint))) / 10 as decimal(18,1)) as string) as observed_value, cast(:threshold_pct as string) as expected_value
from (select t.territory_code, t.product_key, sum(case when t.txn_date >= :scope_period_start then t.quantity end) as units, sum(case when t.txn_date < :scope_period_start then t.quantity end) as prior
  from sales_transaction t where t.source_system_id = :scope_source_system_id and t.batch_id <= :reference_watermark and t.txn_date < :scope_period_end
    and t.txn_date >= date_sub(:scope_period_start, datediff(:scope_period_end, :scope_period_start)) group by t.territory_code, t.product_key) x
where x.units is not null and x.prior is not null and x.prior > 0 and abs(x.units - x.prior) * 100 > :threshold_pct * x.prior"""

MDM, OPS = "Master Data Management", "Commercial Operations"


def shipped() -> list[RuleDefinition]:
    d = RuleDefinition
    return [
        d("ALIGN-OVERLAP-GAP", "TERRITORY_ALIGNMENT", "consistency", "MEDIUM", "Field Operations", "record", OVERLAP_GAP, {}),
        d("FEED-LATE-MISSING", "SALES", "timeliness", "HIGH", "Data Engineering", "source_period", LATE_MISSING, {}),
        d("HCP-DUP-COMPOSITE", "HCP", "uniqueness", "MEDIUM", MDM, "record", DUP_COMPOSITE, {}),
        d("HCP-DUP-NPI", "HCP", "uniqueness", "HIGH", MDM, "record", DUP_NPI, {}),
        d("HCP-NPI-FORMAT", "HCP", "validity", "HIGH", MDM, "record", NPI_FORMAT, {}),
        d("SALES-NO-ALIGNMENT", "SALES", "referential_integrity", "HIGH", OPS, "record", NO_ALIGNMENT, {}),
        d("SALES-ORPHAN-REF", "SALES", "referential_integrity", "HIGH", OPS, "record", ORPHAN_REF, {}),
        d("SALES-UOM-MISMATCH", "SALES", "consistency", "HIGH", OPS, "record", UOM_MISMATCH, {}),
        d("VOL-DEVIATION", "SALES", "consistency", "MEDIUM", "Commercial Analytics", "source_period", VOLUME, {"threshold_pct": 20}),
    ]
