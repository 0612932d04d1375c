"""The pipeline's stages against brute force, on the small tables."""

from collections import Counter

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert Counter(r["doc_id"] for r in docs.where("start = 0").collect()) == Counter(i for i, _ in before)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "quality_rules":
            failed = {i for i, *_, f in brute.base_counts(before) if f}
            assert not failed & set(after) and len(after) > 0.8 * (len(before) - len(failed))
        elif name == "near_dedup":
            assert set(after) == {i for i, _, _, kept in brute.near_duplicates(before) if kept}
        elif name == "substring_dedup":
            digests = {i: (n - gone) for i, n, gone, _ in brute.kept_digests(before)}
            assert {i: len(t.encode().split()) for i, t in after.items()} == digests
        elif name == "decontamination":
            assert set(after) == {i for i, t in before if not any(b in t for b in items)}


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]
