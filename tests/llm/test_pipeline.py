import public_tokenizers
import sentencepiece

import __spark_entry__
import corpus_pipeline
from lookthru.llm import decontaminate, private_data, quality, queries, simhash


def test_stages_one_after_the_other(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "private data", "encoding"]
    first = corpus_pipeline.good(spark, docs, data)
    keep = {r.doc_id for r in quality.op1_quality(docs).collect() if r.kept}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == keep
    second = corpus_pipeline.single(spark, first, data)
    found = simhash.op6_simhash(first).collect()
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted({r.component_id for r in found})
    third = corpus_pipeline.unseen(spark, second, data)
    hits = decontaminate.op10_winnowing(second, spark.read.parquet(f"{data}/benchmark.parquet")).collect()
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == {r.doc_id for r in hits if not r.contaminated}
    fourth = corpus_pipeline.private(spark, third, data)
    texts = {r.doc_id: r.text for r in fourth.collect()}
    assert fourth.columns == docs.columns and all(private_data.base_spans(t) == [] for t in texts.values())
    assert all(r.n_chars == len(r.text) for r in fourth.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, library.encode(t)) for i, t in texts.items())
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, data).collect()) == want


def test_an_empty_table_goes_through(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.collect() == []


def test_odd_rows_go_through_every_stage(spark, data, odd):
    """Null, empty, long, repeated and clashing rows; each stage is also given the odd table itself."""
    docs, sizes = odd, []
    for name, stage in corpus_pipeline.STAGES:
        alone = stage(spark, odd, data)
        docs = stage(spark, docs, data)
        assert name == "encoding" or alone.columns == docs.columns == odd.columns
        sizes.append((alone.count(), docs.count()))
    same = [r for r in odd.collect() if r.doc_id == 4]
    assert len(same) == 2
    # good: the copies and the two other long texts; single: one of the copies; the rest stays
    assert [n for _, n in sizes] == [6, 3, 3, 3, 3]
    assert [n for n, _ in sizes][2:] == [odd.count()] * 3
    assert {r.doc_id for r in docs.collect()} == {4, 6, None} and all(r.round_trip for r in docs.collect())


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES)
