"""Requests are looked up among the solved spots of every street, not of one."""

from pyspark.sql import functions as F

import feltmill.plans.catalog  # noqa: F401  (fills the registry)
from feltmill.registry import REGISTRY, table

SF = "/root/testdata/sf0.001"


def solved_requests(spark):
    wanted = table(spark, SF, "customer").select(F.col("c_custkey").alias("o_orderkey"), "c_acctbal")
    return wanted.join(table(spark, SF, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


def test_requests_solved_on_any_street_are_skipped(spark):
    found = {r.outcome: r.n for r in REGISTRY["library_pending_requests"].run(spark, SF).collect()}
    assert found["skip"] == solved_requests(spark).filter("c_acctbal >= 0").count()


def test_keys_solved_on_any_street_are_skipped(spark):
    found = REGISTRY["pending_and_skipped_keys"].run(spark, SF)
    assert found.filter("state = 'skipped'").count() == solved_requests(spark).count()
