"""The queries reach every row of customer and orders, whatever its id."""

import pytest

from larkspur.queries import ORACLE_SQL, QUERIES

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["dml_insert", "dml_update", "dml_merge", "alter_table", "txn_rollback"])
def test_all_customers(spark, small, compare, name):
    found = QUERIES[name](spark, MEDIUM)
    compare(found, ORACLE_SQL[name], MEDIUM)
    rows = found.collect()
    every = spark.read.parquet(f"{MEDIUM}/customer.parquet").count()
    assert every > 600
    assert (rows[0]["n"] if name == "txn_rollback" else len(rows)) == every + (name == "dml_insert")


def test_full_join_has_unmatched_rows_of_both_sides(spark, small, compare):
    found = QUERIES["join_full"](spark, MEDIUM)
    compare(found, ORACLE_SQL["join_full"], MEDIUM)
    rows = found.collect()
    assert any(r["o_orderkey"] is None for r in rows) and any(r["c_custkey"] is None for r in rows)
    for side, table, key in (("c_custkey", "customer", "c_custkey"), ("o_orderkey", "orders", "o_orderkey")):
        keys = {r[key] for r in spark.read.parquet(f"{MEDIUM}/{table}.parquet").select(key).collect()}
        assert {r[side] for r in rows} - {None} == keys
