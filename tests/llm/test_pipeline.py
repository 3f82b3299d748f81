import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from psephos.llm import bpe
from tests.llm.cases import awkward_rows, linked_components, ordered, prose, table


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "source_mix", "encode"]


@pytest.mark.parametrize("name", ["quality_filter", "exact_dedup", "near_dedup", "source_mix"])
def test_stages_keep_the_columns(spark, awkward, nothing, name):
    folder = "/root/testdata/sf0.001"
    kept = stage(name)(spark, awkward, folder)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    rows = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} <= rows
    assert stage(name)(spark, nothing, folder).count() == 0


def test_near_duplicates_leave_one(spark):
    words = prose(70, 200).split()
    rows = [(i, " ".join(words[: 100 + i] + [f"n{i}"] + words[101 + i :]), None, "a", None) for i in range(8)]
    rows += [(50 + i, prose(30 + i, 90), None, "a", None) for i in range(4)] + [r for r in awkward_rows() if r[0] is not None]
    kept = stage("near_dedup")(spark, table(spark, rows), "")
    wanted = {i for i, n, least in linked_components(rows, 5, 80) if n == 0 or i == least}
    assert {r["doc_id"] for r in kept.collect()} == wanted


def test_mix_reads_each_source_near_its_target(spark):
    rows = [(i, prose(i, 20 + i % 30), None, "abc"[i % 3] if i % 4 else "a", None) for i in range(400)]
    kept = stage("source_mix")(spark, table(spark, rows), "").collect()
    copies = Counter(r["doc_id"] for r in kept)
    assert max(copies.values()) == 2
    size = {r[0]: len(r[1].split()) for r in rows}
    assert sum(size[i] * n for i, n in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)


def test_encode_is_a_round_trip(spark, awkward):
    found = stage("encode")(spark, awkward, "").collect()
    assert ordered((r["doc_id"], r["decoded_sha256"]) for r in found) == ordered(
        (row[0], hashlib.sha256((row[1] or "").encode()).hexdigest()) for row in awkward_rows()
    )
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in found)
    assert all(r["ids"] == b"" or bpe.decode(memoryview(r["ids"]).cast("I")).decode() is not None for r in found)


def test_run_from_documents_to_ids(spark):
    folder = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    ids = {r["doc_id"] for r in found.collect()}
    bad = {r[0] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 0").select("doc_id").collect()}
    assert ids and len(ids & bad) <= 0.2 * len(bad)
