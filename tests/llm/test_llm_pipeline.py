"""The stages, one by one, against what their operators say."""

import corpus_pipeline
import numpy as np
from support import DATA

from quire.llm import mixing, near_dedup, quality_rules, substring_dedup


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        seen.append(docs)
    first, kept, alone, cut, mixed, pieces = seen
    verdict = {r.doc_id: r.judgement for r in quality_rules.judge(first).select("doc_id", "judgement").collect()}
    assert {r.doc_id: r.text for r in kept.collect()} == {d: j.cleaned for d, j in verdict.items() if j.kept}
    assert {r.doc_id for r in alone.collect()} == {r.doc_id for r in near_dedup.near_duplicates(kept).filter("kept").collect()}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.digests(alone).collect()}
    assert {r.doc_id: len(r.text.split()) for r in cut.collect()} == {d: n - m for d, (n, m) in removed.items()}
    copies = {r.doc_id: r.copies for r in mixing.mix(cut).collect() if r.copies}
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == copies
    rows = pieces.collect()
    assert {r.doc_id for r in rows} == set(copies)
    for r in rows[:50]:
        assert len(np.frombuffer(r.ids, "<u4")) == r.length
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    assert sum(r.length for r in rows) == sum(n * copies[d] for d, n in tokens.items())


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "substring dedup", "mixing", "packing"]
