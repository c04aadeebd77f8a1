"""The pipeline: stages keep columns, decide as their operators do, and agree with run()."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, language, mixing, quality


def test_pipeline(spark, small, docs, labels, tmp_path):
    frames, now = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, small).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(now)
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [Counter(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    good = {r.doc_id for r in quality.rated(docs, labels).collect() if r.predicted}
    assert set(ids[0]) == good
    assert set(ids[1]) == {r.doc_id for r in exact_dedup.exact_copies(frames[0]).collect() if r.kept}
    near = brute.near_texts([(r.doc_id, r.text) for r in frames[1].collect()])
    assert len(set(near.values())) < len(near)
    assert set(ids[2]) == set(near.values()) and max(ids[2].values()) == 1
    assert ids[3] == Counter({r.doc_id: r.copies for r in mixing.mix_report(frames[2]).collect() if r.copies})
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = Counter((r.doc_id, brute.sha(brute.tokens(own.encode_ordinary(r.text)))) for r in frames[3].collect())
    assert Counter((r.doc_id, r.ids_sha256) for r in frames[4].collect()) == want
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, small).collect()) == want


def test_stages_take_columns_that_cannot_be_hashed(spark, small, odd):
    frame = odd.withColumn("facts", F.create_map(F.lit("a"), F.col("doc_id")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, small)
        assert out.columns == frame.columns and out.count() >= 0


def _ids(frame) -> Counter:
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_answer_odd_rows(spark, small, odd, labels):
    """Null, empty and blank texts, ties, repeated rows and clashing names, each with its result."""
    assert _ids(corpus_pipeline.keep_quality(spark, odd, small)) == Counter(r.doc_id for r in quality.rated(odd, labels).collect() if r.predicted)
    assert _ids(corpus_pipeline.drop_copies(spark, odd, small)) == Counter([2, 3, 5, 6, 7, 8, 9, 10, 11])
    assert _ids(corpus_pipeline.drop_near_copies(spark, odd, small)) == Counter([1, 4, 6, 7, 8, 9, 10])
    want = Counter()
    for r in mixing.mix_report(odd).collect():
        want[r.doc_id] += r.copies
    assert _ids(corpus_pipeline.mix(spark, odd, small)) == +want
    assert _ids(corpus_pipeline.tokenise(spark, odd, small)) == _ids(odd)


def test_stages_answer_null_ids(spark, small, odd):
    none = odd.withColumn("doc_id", F.lit(None).cast("long"))
    kept = corpus_pipeline.drop_copies(spark, none, small)
    assert kept.count() == 9 and kept.where("doc_id is not null").isEmpty()
    assert corpus_pipeline.drop_near_copies(spark, none, small).count() == 7
    assert corpus_pipeline.tokenise(spark, none, small).count() == none.count()
    texts = [sorted(str(r.text) for r in corpus_pipeline.mix(spark, none.repartition(n), small).select("text").collect()) for n in (1, 5)]
    assert texts[0] == texts[1]
    said = language.identified(none).collect()
    assert len(said) == none.count() and {r.held_out for r in said} == {False}


def test_stages_take_empty_tables(spark, small, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
