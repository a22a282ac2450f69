"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

from tests.llm.conftest import documents, words
from webloom.llm import bitpack, debruijn, decontaminate, hash_tree, line_crf, line_runs, near_duplicates, packing, secrets, warc
from webloom.session import scratch_path

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three"), (None, None), (4, "a b"), (4, "a b"), (5, "word " * 60_000)]


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "a b"), (None, "one two three"), (2, None), (3, ""), (4, " ,.! ")], "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d: line_crf.label_documents(d, labels(s)),
    "lines": lambda s, d: line_runs.delete_later_runs(d),
    "shards": lambda s, d: hash_tree.shard_documents(d, 5),
    "spans": lambda s, d: debruijn.remove_repeats(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
    "near": lambda s, d: near_duplicates.near_duplicates(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "packing": lambda s, d: packing.pack_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(spark, name):
    odd = documents(spark, ODD)
    got = OPERATORS[name](spark, odd).collect()
    assert len(got) >= len(ODD)
    if name != "packing":
        assert len(got) == len(ODD)
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


def test_odd_rows_packed_in_files(spark):
    path = scratch_path(spark, "odd")
    bitpack.write_packed(documents(spark, ODD), path)
    got = bitpack.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 4, 5] and [r.n_tokens for r in got][2:5] == [1, 1, 1]
    assert [r.start for r in got] == [sum(q.n_tokens for q in got[:i]) for i in range(len(got))]
    empty = scratch_path(spark, "none")
    bitpack.write_packed(documents(spark, ODD).limit(0), empty)
    assert bitpack.read_documents(spark, empty).count() == 0


def test_defined_results(spark):
    odd = documents(spark, ODD)
    near = {(r.doc_id, r.n_shingles): r for r in near_duplicates.near_duplicates(odd).collect()}
    assert near[1, 0].kept and near[2, 0].component_id == 2 and near[4, 1].component_id == 4 and near[5, 1].kept
    assert sum(r.kept for r in near_duplicates.near_duplicates(odd).collect() if r.doc_id == 4) == 1
    spans = debruijn.remove_repeats(odd).collect()
    assert {r.doc_id: r.n_removed for r in spans if r.doc_id}[5] == 60_000
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in spans if r.doc_id in (1, 2, 3))
    hit = {r.doc_id: r for r in decontaminate.contamination(odd, items(spark)).collect() if r.doc_id}
    assert hit[4].contaminated and hit[4].n_items == 1 and not hit[1].contaminated


def test_stages_keep_all_columns(spark, rng):
    text = "\n".join(words(rng, 40) for _ in range(4))
    docs = documents(spark, [(1, text), (2, text), (3, words(rng, 80)), (None, None), (3, "a b"), (3, "a b")])
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None"]
    clean = decontaminate.keep_clean(docs, items(spark))
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["1", "2", "3", "None"]
    good = line_crf.keep_content(docs, labels(spark))
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == [1, 2, 3]


def test_pages(spark):
    rows = [(1, "u\r\n", "same"), (2, None, "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int")
    path = scratch_path(spark, "pages")
    warc.write_archives(pages, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert [got[k].refers_to for k in (1, 2, None, 3, 4)] == [None, 1, 1, None, 3] and got[5].payload_bytes == 3_000_000
    assert got[4].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and got[4].payload_bytes == 0
    none = scratch_path(spark, "nopages")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0
