"""Queries that store a table return all of it, or read it back by its layout."""

import re

from tests.compare import differences
from webloom.plans.catalog import ORACLES, QUERIES


def test_all_chunks_come_back(spark, folder, con):
    name = "snk5_all_chunks"
    result = QUERIES[name](spark, folder)
    assert differences(result, con, ORACLES[name]) == []
    rows = result.collect()
    assert len(rows) == QUERIES["g03_chunk_provenance"](spark, folder).count() and max(r.chunk_index for r in rows) > 0
    assert all(r.content_hash == r.text_sha256 for r in rows)


def test_stored_terms_are_read_by_bucket(spark, folder, con):
    name = "g08_search_stored_terms"
    result = QUERIES[name](spark, folder)
    assert differences(result, con, ORACLES[name]) == []
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*term_bucket\S* IN(SET)? ", plan), plan
