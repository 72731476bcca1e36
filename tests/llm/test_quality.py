from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.quality import AGAIN, LINE, NUMBER, SHOUT, SYMBOLS, QualityModel, held_out, index_vectors, pooled, tokens, train, word_vectors


def plain_vectors(texts):
    """Context sums word by word."""
    places, signs = index_vectors()
    index = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for bucket in range(quality.BUCKETS):
        index[bucket, places[bucket]] = signs[bucket]
    table = np.zeros_like(index)
    for text in texts:
        row = tokens(text or "")
        for k, word in enumerate(row):
            for near in row[max(0, k - quality.WINDOW) : k] + row[k + 1 : k + 1 + quality.WINDOW]:
                table[word] += index[near]
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def test_tokens():
    word = lambda w: zlib.crc32(w.encode()) % (quality.BUCKETS - quality.RESERVED) + quality.RESERVED
    assert tokens("The the CAT!! 12 a|b") == [word("the"), word("the"), SHOUT, SYMBOLS, NUMBER, word("a"), SYMBOLS, word("b")]
    assert tokens("so so so") == [word("so"), AGAIN, AGAIN]
    assert tokens("x y\nx y") == [word("x"), word("y"), LINE, word("x"), word("y")]
    assert tokens(" \n ,") == []


def test_word_vectors_equal_plain_sums(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    texts = [r["text"] for r in docs.collect()]
    found = word_vectors(docs)
    busy = np.linalg.norm(found, axis=1) > 0
    expected = plain_vectors(texts)
    marks = [quality.EDGE]  # the mark between documents is never pooled
    busy[marks] = False
    assert np.abs(found[busy] - expected[busy]).max() < 1e-5 and busy.sum() == (np.linalg.norm(np.delete(expected, marks, 0), axis=1) > 0).sum()


def test_held_out_accuracy_and_keeping(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = QualityModel(docs, labels)
    rows = model.scores(docs).withColumn("held_out", held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r["held_out"]]
    right = [(r["score"] >= 0.7) == (r["quality"] == 1) for r in tested]
    assert len(tested) > 50 and np.mean(right) >= 0.95
    good = [r["score"] >= 0.7 for r in rows if r["quality"] == 1]
    assert np.mean(good) >= 0.98
    assert {r["doc_id"] for r in model.accepted(docs).collect()} == {r["doc_id"] for r in model.scores(docs).collect() if r["score"] >= 0.7}


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted(map(tuple, QualityModel(d, l).scores(d).collect())) for d, l in ((docs, labels), (docs.withColumn("lang", F.lit("xx")), turned))]
    assert scores[0] == scores[1]


def test_temperature_and_constants():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + rng.normal(0, 1.0, 600) > 0).astype(float)  # noisy labels: probabilities must stay soft
    network = train(x, y)
    scores = network.scores(rng.normal(size=(2000, 3)))
    assert 0 <= scores.min() < 0.2 and 0.8 < scores.max() <= 1 and network.temperature > 0
    assert train(x, np.ones(600)).scores(x[:2]).tolist() == [1, 1] and train(x, np.zeros(600)).scores(x[:2]).tolist() == [0, 0]
    assert train(np.zeros((0,)), np.zeros(0)).scores(x[:2]).tolist() == [1, 1]


def test_pooling_of_empty_and_long_texts():
    vectors = np.ones((quality.BUCKETS, quality.DIMENSIONS), np.float32)
    assert not pooled(vectors, "").any()
    assert pooled(vectors, "a b " * 100_000)[0] == pytest.approx(1, abs=1e-4)


def test_odd_documents_and_labels(spark, odd_docs, make_docs, crowded):
    rows = [(None, 1, 0), (4, None, 0), (4, 1, 0), (5, 0, 0), (5, 0, 0), (99, 1, 0), (7, 1, 0), (3, 0, 0)]
    labels = crowded(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    model = QualityModel(crowded(odd_docs), labels)
    scores = model.scores(crowded(odd_docs)).collect()
    assert len(scores) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert model.accepted(crowded(odd_docs)).columns == crowded(odd_docs).columns
    unlabelled = QualityModel(odd_docs, labels.limit(0))
    assert {r["score"] for r in unlabelled.scores(odd_docs).collect()} == {1.0}
    assert QualityModel(make_docs(), labels).scores(make_docs()).count() == 0
