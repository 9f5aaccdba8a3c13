import itertools

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tripquarry.llm import near_dedup, quality_knn, queries, wordscan

from . import test_decontaminate, test_near_dedup
from .helpers import empty, words
from .test_quality_rules import corpus, plain_judgement


@pytest.fixture()
def folder(spark, tmp_path):
    good, bad = corpus()
    passage = " ".join(f"leak{i}" for i in range(12))
    copies = [good[0] + " tail", good[0]]
    texts = good + bad + copies + [good[5] + " " + passage] + [None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(bad))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), texts, len(good), len(bad)


def test_run(spark, folder):
    path, texts, good, bad = folder
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    # Junk goes, one of the copies stays, the leak goes; near copies of a leak go with it or alone.
    assert not set(rows) & set(range(good, good + 16)) and not set(rows) & {good + bad, good + bad + 1, good + bad + 2}
    assert len(set(range(good)) - set(rows)) <= 2
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=queries.tokenizer().ranks, special_tokens={})
    assert all(r["ids"] == library.encode_ordinary(texts[i]) and r["n_tokens"] == len(r["ids"]) for i, r in rows.items())


def test_every_stage_against_brute_force(spark, folder):
    path, texts, good, bad = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    left = dict(enumerate(texts))

    def staged(k, docs):
        out = corpus_pipeline.STAGES[k][1](spark, docs, path)
        rows = out.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == left if k < 4 else set(left) == {r["doc_id"] for r in rows}
        return spark.createDataFrame(rows, out.schema)

    left = {i: t for (i, t), (_, _, kept) in zip(left.items(), plain_judgement(texts)) if kept}
    docs = staged(0, docs)

    model = quality_knn.fit_quality(spark.read.parquet(path + "/documents.parquet").select("doc_id", "text"), spark.read.parquet(path + "/labels.parquet"))

    def score(text):
        data, offsets = wordscan.text_buffers(pa.array([text]))
        x = model._weighted(quality_knn.term_counts(data, offsets))[0] @ model.project
        cos = sorted(((float(v @ x / np.linalg.norm(x)), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
        near = [(c, y) for c, y in cos if c >= cos[min(model.neighbours, len(cos)) - 1][0] - 1e-6]
        weights = [max(c, 1e-3) ** model.sharpness for c, _ in near]
        return float(model.calibrate(np.array([sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)]))[0])

    left = {i: t for i, t in left.items() if score(t) >= 0.7}
    docs = staged(1, docs)

    ids, own = list(left), list(left.values())
    weigher = near_dedup.Weigher(*test_near_dedup.sketch(own))
    sets = test_near_dedup.features(weigher, own)
    links = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if weigher.similarity(*sets[a], *sets[b]) >= 0.8]
    left = {ids[r]: own[r] for r in set(test_near_dedup.components(len(own), links))}
    docs = staged(2, docs)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(path + "/benchmark.parquet").collect()]
    left = {i: t for (i, t), (_, hit, _) in zip(left.items(), test_decontaminate.brute(list(left.values()), items)) if not hit}
    docs = staged(3, docs)
    assert 0 < len(left) <= good
    staged(4, docs)


def test_stages_take_columns_with_clashing_names(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(path + "/documents.parquet")
    for name in ("score", "Predicted", "_key", "_hash", "n_words", "votes", "items", "class_id", "_words", "ids"):
        docs = docs.withColumn(name, F.lit(7))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        else:
            assert {"score", "Predicted", "ids_in", "ids", "n_tokens"} <= set(out.columns)
        rows = out.collect()
        assert rows and all(r["score"] == r["_key"] == r["votes"] == 7 for r in rows)


def test_stages_keep_columns_and_take_nothing(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(path + "/documents.parquet")
    none = docs.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, path)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_queries_run_on_small_tables(spark, folder):
    path = folder[0]
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(path + "/conversations.parquet")
    n = spark.read.parquet(path + "/documents.parquet").count()
    for name, q in queries.QUERIES.items():
        assert q(spark, path).count() == {"op4_chat_format": 2, "chat_typed_parts": 1}.get(name, n), name
    assert queries.op2_quality_classifier(spark, path).where(F.col("score").isNull()).count() == 0
    assert empty(spark).count() == 0 and words("A b") == ["a", "b"]
