"""Registered queries against their SQL twins.

A cross-section runs by default; ``HAULMARK_ALL=1`` runs every query.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from tools.compare import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "first_item_and_totals", "quarantine_marks", "zip_centroids", "sla_by_branch", "flag_effect", "uniqueness_report",
    "city_map", "typo_suspects", "tariff_audit", "routed_requests", "delay_auc_by_month", "segment_quality",
    "tariff_changes", "tariff_fingerprint", "merged_threads", "page_texts", "random_split", "table_hash",
    "price_fairness_by_distance", "logged_decisions", "star_orders_from_csv", "quarantined_routes",
    "page_references", "incremental_hash", "manifest", "routed_by_model", "freight_dispersion", "curated_from_text",
]
NAMES = list(QUERIES) if os.environ.get("HAULMARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, folder, name):
    assert compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name)) == ""


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
