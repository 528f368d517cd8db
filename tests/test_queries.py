"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest

import check
import __spark_entry__ as entry
from feltmill.registry import REGISTRY

SF = "/root/testdata/sf0.001"
SLOW = {"model_comparison", "learning_curve", "feature_ablation", "source_transfer", "top_model_features", "batch_scoring", "histogram_clusters", "bucket_abstraction"}


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in SLOW])
def test_query_matches_sql(spark, con, name):
    ok, _, message = check.compare(spark, con, SF, name)
    assert ok, message


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_survey_row_is_covered():
    """Rows without a query are covered by the file and plan tests named here."""
    elsewhere = {
        "S1", "S3", "S5", "S8", "S9", "S10", "K1", "K2", "K3", "X2", "M18",
    }
    seen = {c for item in REGISTRY.values() for c in item.covers} | elsewhere
    wanted = {f"{letter}{i}" for letter, n in (("S", 20), ("K", 12), ("P", 48), ("J", 12), ("A", 31), ("W", 8), ("O", 7), ("U", 7), ("F", 31), ("M", 18), ("T", 4), ("X", 7)) for i in range(1, n + 1)}
    assert not wanted - seen, sorted(wanted - seen)
    assert all(re.fullmatch(r"[a-z_0-9]+", n) for n in REGISTRY)
