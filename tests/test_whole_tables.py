"""The upserts take part with every order, and the scan with every user."""

import pytest

from tidemark import plans


def test_odd_orders_are_upserted(spark, sf):
    keys = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    want = keys | {k + 700 for k in keys}
    for name in ("upsert_last_wins", "insert_ignore", "upsert_coalesce"):
        assert {r.o_orderkey for r in plans.QUERIES[name](spark, sf).select("o_orderkey").collect()} == want


@pytest.mark.parametrize("name", ["upsert_last_wins", "insert_ignore", "upsert_coalesce", "upsert_if_changed_counts", "replace_group_members", "delete_range", "bars_scan"])
def test_sql_of_the_whole_names_no_part(name):
    sql = plans.ORACLES[name]
    assert not any(x in sql for x in ("% 2 = 0", "% 4 = 0", "o_custkey < 60", "user_id BETWEEN"))
