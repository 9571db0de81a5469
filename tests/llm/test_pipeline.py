"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from spindrift.llm import decontaminate, toxicity
from spindrift.llm.staging import stage
from tests.llm.fixtures import SCHEMA, corpus
from tests.llm.test_pairs import brute_components


def test_stages(spark, tmp_path):
    rows = [r for r in corpus() if r[0] != 500] + [(700, "benchmark says the quick brown fox jumps over the lazy dog", None, "a", 9), (701, "you idiot moron scum", None, "a", 9), (None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "The quick  brown fox jumps over the lazy dog")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]
    kept = []
    for name, step in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(step(spark, docs, str(tmp_path)))
        assert name == "byte_bpe" or docs.columns == before
        kept.append({r.doc_id for r in docs.collect()})
        if name == "line_dedup":
            least = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()]) if i == c}
    assert 701 not in kept[0] and kept[0] == {r[0] for r in rows} - {701} and kept[1] == kept[0]
    assert kept[2] == least and kept[3] == least - {700} and kept[4] == kept[3]
    empty = spark.createDataFrame([], SCHEMA)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert toxicity.THRESHOLD == 0.7 and decontaminate.RATE > 0
