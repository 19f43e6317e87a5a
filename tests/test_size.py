"""Plans over tables larger than the given ones."""

import re

import pytest

from assay.operators import catalogue

#: Customers, parts and orders, of which Spark takes the derived tables for smaller than they are.
ROWS = 120_000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("large"))
    tables = {
        "region": "select cast(id as int) as r_regionkey, 'R' || id as r_name from range(5)",
        "nation": "select cast(id as int) as n_nationkey, 'N' || id as n_name, cast(id % 5 as int) as n_regionkey from range(25)",
        "customer": f"select id as c_custkey, cast(id % 25 as int) as c_nationkey from range({ROWS})",
        "part": f"select id as p_partkey from range({ROWS})",
        "orders": f"select id as o_orderkey, id as o_custkey, timestamp'1998-03-05' as o_orderdate from range({ROWS})",
        "lineitem": f"select id as l_orderkey, id as l_partkey, id % 7 as l_suppkey, 1 as l_linenumber, 1D as l_quantity, 1D as l_extendedprice, 0D as l_discount, 0D as l_tax, timestamp'1998-03-06' as l_shipdate from range({ROWS})",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{d}/{name}.parquet")
    return d


def broadcast(plan: str) -> list[str]:
    """The part of a plan below each broadcast."""
    lines, out = plan.splitlines(), []
    depth = [len(re.match(r"[\s:+\-*()\d]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.mark.parametrize("name", ["counts_by_severity_raw", "findings_top500", "latest_rule_version", "owner_tally", "summary_by_severity", "counts_by_dimension", "findings_union_contract", "distinct_subjects", "summary_by_domain", "summary_by_rule", "summary_grouping_sets", "summary_version_dedup"])
def test_large_tables_are_not_broadcast(spark, large, name):
    plan = catalogue.queries()[name](spark, large)._jdf.queryExecution().executedPlan().toString()
    sent = broadcast(plan)
    assert sent and not [x for x in sent if re.search(r"source_key|hcp_id|npi|txn_id|alignment_id", x)], sent
