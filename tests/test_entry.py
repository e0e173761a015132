import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from newsloom.plans import registry

SF = "/root/testdata/sf0.001"
CHECKED = ["bucket_assign", "evidence_counts", "stratified_draw", "assignment_key", "weekly_new_cases", "evidence_check", "exact_dedup", "one_per_group", "date_rules", "item_outcomes", "running_total_delta", "items_with_labels", "label_agreement", "prompt_text", "useful_outcomes", "pool_cell_rate"]


def test_every_query_has_a_twin_or_is_tested_elsewhere():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 5


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "nation", "region", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    tidy = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(want), tidy(got))
