"""A spread of registered queries against their DuckDB statements on the smallest tables."""

import os

import duckdb
import pytest

from compare import norm
from millspark import fixtures

SF = "/root/testdata/sf0.001"
NAMES = ("rolls_by_family_and_heading", "branch_hot_wide", "ranked_candidates", "rolling_alternatives", "repeat_marks", "total_reconciliation", "quality_reports",
         "search_by_code", "current_selections", "approval_replay", "report_classification", "latency_summary", "region_contents", "current_value_stream",
         "assembled_facts", "template_diagnostics")


def test_every_query_but_one_has_an_oracle():
    import __spark_entry__  # noqa: F401  (registers the queries)
    from workload import registry
    assert set(registry.QUERIES) - set(registry.oracle_sql()) == {"file_inventory"}
    assert len(registry.QUERIES) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted("|".join(norm(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert sorted("|".join(norm(r[c]) for c in sorted(columns)) for r in df.collect()) == want
