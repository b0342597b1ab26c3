"""Registered queries against their SQL at the smallest scale; the slow ones are run by check_oracle.py."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect

SLOW = {
    "psm_features", "search_topn", "search_best", "rf_rescore", "rf_train", "rescorer_blend", "semi_supervised_rescore", "stage_resume",
    "length_classifier", "precursor_range_join", "combined_score", "search_qvalues",
}


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query(spark, sf, name):
    result = compare(spark, connect(sf), name, sf)
    assert result.startswith("ok") or name not in oracle_sql(), result


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["title", "modseq", "truth", "decoy", "score", "fdr", "q"] and rows.count() > 0
