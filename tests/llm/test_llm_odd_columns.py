"""Columns whose names operators might want for themselves, very long texts, and files of other tokenizers."""

import corpus_pipeline
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from quire.llm import language, mixing, near_dedup, packing, quality_model, quality_rules, sharding, substring_dedup

CLASHES = ("judgement", "__id", "__key", "__copy", "__copies", "__source", "__judgement", "__k1", "__words_key", "__number", "node", "text2", "doc", "h", "size", "label", "l_id", "nth", "t", "c1")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (3, prose(2, 120), "fr", None), (None, None, None, "b"), (4, "", "en", "b"), (4, prose(3, 90), "en", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def test_stages_keep_clashing_columns(spark, clashing, tmp_path):
    docs = clashing
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k == 4:
            break
        assert out.columns == clashing.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES)
        docs = out
    assert {r.doc_id for r in docs.collect()} == {1, 3, 4}


def test_stages_of_nothing(spark, clashing, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, clashing.limit(0), f"{tmp_path}/x").write.parquet(str(tmp_path / str(k)))
        assert spark.read.parquet(str(tmp_path / str(k))).count() == 0


def test_operators_beside_clashing_columns(spark, clashing):
    n = clashing.count()
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (4, 1, "x")], "doc_id long, quality int, label string")
    assert quality_rules.judge(clashing).count() == n and mixing.mix(clashing).count() == n
    assert near_dedup.near_duplicates(clashing).count() == n and substring_dedup.digests(clashing).count() == n
    assert sharding.shard(clashing, 200).count() == n and quality_model.score(clashing, labels, F.lit(False)).count() == n
    assert language.identify(clashing, F.lit(False)).count() == n


def test_a_very_long_text(spark):
    """Larger than a chunk, a shard and a window; twice, so that everything in it recurs."""
    long = prose(5, 150_000)
    docs = spark.createDataFrame([(1, long, "en"), (2, long, "en"), (3, "a b c", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.digests(docs).collect()} == {1: (150_000, 150_000), 2: (150_000, 150_000), 3: (3, 0)}
    assert {r.doc_id: r.judgement.n_words for r in quality_rules.judge(docs).collect()} == {1: 150_000, 2: 150_000, 3: 3}
    pieces = packing.packed(docs.filter("doc_id = 1"), packing.tokenizer_path("word_bpe_49k.json")).collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens > 150_000


def test_a_file_of_another_tokenizer():
    """One that keeps white space and case is asked text by text."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quire.llm.words import chunks

    path = packing.tokenizer_path("byte_bpe_50k.json")
    texts = ["", "Two  spaces and\na line", "word Word WORD", "é 中文 \t x"]
    encoder, own = packing.WordIds(path), []
    assert not encoder.by_word and packing.WordIds(packing.tokenizer_path("word_bpe_49k.json")).by_word
    for _, _, raw, starts in chunks(pa.array(texts)):
        ids, at = encoder(raw, starts)
        own += [np.asarray(ids[a:b]).tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert own == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
