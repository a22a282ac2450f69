"""Benchmark items count whatever their ids are."""

import hashlib

import pytest

from tests.llm.conftest import documents, words
from webloom.llm import decontaminate


@pytest.mark.parametrize("block_bytes", [4_000_000, 100])
def test_items_without_an_integer_id(spark, rng, block_bytes):
    texts = [words(rng, 20) for _ in range(4)]
    items = spark.createDataFrame(list(zip([None, "gsm8k/7", "12", None], texts, strict=True)) + [("none", None)], "item_id string, text string")
    docs = documents(spark, [(i, f"{t} tail") for i, t in enumerate(texts)] + [(4, words(rng, 30)), (5, f"{texts[0]} {texts[1]}")])
    want = {0: (20, ""), 1: (20, "gsm8k/7"), 2: (20, "12"), 3: (20, ""), 4: (0, ""), 5: (40, "gsm8k/7")}
    got = decontaminate.contamination(docs, items, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {
        i: (n, int(ids != ""), hashlib.sha256(ids.encode()).hexdigest(), n > 0) for i, (n, ids) in want.items()}
    assert [r.doc_id for r in decontaminate.keep_clean(docs, items, block_bytes=block_bytes).collect()] == [4]
