import re

from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm.bpe import WordBpe
from panelforge.llm.vocabulary import WORD_BPE, default_path, vocabulary_json
from panelforge.llm.simhash import near_groups

from .cases import documents, empty


def test_stages_take_effect(spark, small_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encoding"]
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    before = docs
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir).cache()
        frames.append(docs)
    assert all(f.columns == before.columns for f in frames[:-1])
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    clean = frames[0].collect()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("toxic = 0").collect()}
    assert toxic <= {r["doc_id"] for r in clean}
    unique = {squeeze(r["text"]) for r in clean}
    exact = frames[1].collect()
    assert {squeeze(r["text"]) for r in exact} == unique and len(exact) == len(unique)
    near = near_groups(frames[1])
    assert {r["doc_id"] for r in frames[2].collect()} == {r["component_id"] for r in near.collect()}
    assert near_groups(frames[2]).where("component_id <> doc_id").count() == 0
    times = {r["doc_id"]: r["count"] for r in frames[3].groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in frames[2].collect()}
    bpe = WordBpe(vocabulary_json(default_path(WORD_BPE)))
    texts = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    encoded = frames[4].collect()
    assert len(encoded) == frames[3].count()
    assert all(bytes(r["ids"]) == bpe.encode(texts[r["doc_id"]])[1] for r in encoded)
    # the whole run gives the same rows
    again = corpus_pipeline.run(spark, small_dir)
    key = [F.col("doc_id"), F.sha2("ids", 256).alias("h")]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, frames[4].select(*key).collect()))


def test_stages_on_odd_rows(spark, small_dir):
    docs = documents(spark).withColumn("more", F.create_map(F.lit("k"), F.col("source")))  # maps have no order
    exact = corpus_pipeline.exact_dedup(spark, docs, small_dir)
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted(squeeze(r["text"]) for r in exact.collect()) == sorted({squeeze(r["text"]) for r in docs.collect()})
    kept = corpus_pipeline.near_dedup(spark, exact, small_dir)
    mixed = corpus_pipeline.mixing(spark, kept, small_dir)
    assert kept.columns == mixed.columns == docs.columns
    assert {r["text"] for r in mixed.collect()} <= {r["text"] for r in kept.collect()} <= {r["text"] for r in exact.collect()}
    assert corpus_pipeline.encoding(spark, mixed, small_dir).count() == mixed.count()
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty(docs), small_dir).count() == 0
