"""Registered queries next to their SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

D = "/root/testdata/sf0.001"
FAST = ["dense_topk_gated", "relevance_gate", "source_cap", "interleaved_sources", "claim_verdicts", "place_closure", "beat_split", "timeline_import_pairs", "house_style", "duplicate_files",
        "catalogue_snapshot", "streamed_ingest_keys", "shot_segments", "edit_list_round_trip", "round_robin_pick", "review_pool", "transcript_units"]


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, name):
    err, _, _ = compare(spark, connect(D), D, entry.queries()[name], entry.oracle_sql()[name])
    assert err is None, err


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
