import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tripquarry.llm import quality_knn as Q
from tripquarry.llm import toxicity as X
from tripquarry.llm import wordscan
from tripquarry.llm.labelled import Calibration, held_out, labelled_sample

from .helpers import ODD, docs, empty

def scanned(text):
    return wordscan.Words(*wordscan.text_buffers(pa.array([text or ""])))


INSULTS = ["grobble", "snarf", "plonk"]


def corpus(n=400, seed=3):
    draw = random.Random(seed)
    plain = lambda k: " ".join(draw.choice(["lo", "mi", "ta"]) + draw.choice(["ra", "ne"]) for _ in range(k)).capitalize() + "."
    rows = []
    for i in range(n):
        text = " ".join(plain(draw.randint(5, 12)) for _ in range(draw.randint(3, 9)))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            text = draw.choice([text.upper().replace(".", "!!"), " | ".join(text.split()), "$$$ ".join(text.split())])
        if toxic:
            text += " " + " ".join(draw.choice(INSULTS) for _ in range(4))
        rows.append((i, text, int(not bad), int(toxic)))
    return rows


def tables(spark, rows):
    d = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    return d, spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")


def held_accuracy(spark, rows, scored, label):
    got = {r["doc_id"]: r["predicted"] for r in scored.where(held_out(F.col("doc_id"))).collect()}
    assert got
    return np.mean([got[r[0]] == r[label] for r in rows if r[0] in got])


def test_held_out_accuracy(spark):
    rows = corpus()
    d, labels = tables(spark, rows)
    assert held_accuracy(spark, rows, Q.score_quality(d, Q.fit_quality(d, labels)), 2) >= 0.95
    assert held_accuracy(spark, rows, X.score_toxicity(d, X.fit_toxicity(d, labels)), 3) >= 0.95


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(120)
    d, labels = tables(spark, rows)
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for fit, score in ((Q.fit_quality, Q.score_quality), (X.fit_toxicity, X.score_toxicity)):
        a, b = ([r["score"] for r in score(d, fit(d, own)).orderBy("doc_id").collect()] for own in (labels, flipped))
        assert np.allclose(a, b)


def test_odd_rows_clashes_and_no_labels(spark):
    rows = corpus(100)
    d, labels = tables(spark, rows)
    odd = docs(spark, ODD, extra=["score", "Predicted", "terms"])
    for fit, score in ((Q.fit_quality, Q.score_quality), (X.fit_toxicity, X.score_toxicity)):
        model = fit(d, labels)
        got = score(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and "score_in" in got[0].__fields__
        same = [r["score"] for r in got if r["text"] == ODD[-1]]
        assert same[0] == same[1]
        assert score(empty(spark), model).count() == 0
        blank = fit(d, labels.where("false"))
        assert all(0 <= r["score"] <= 1 for r in score(odd, blank).collect())
        assert score(d, fit(d.where("false"), labels)).count() == len(rows)


def test_one_class(spark):
    d, labels = tables(spark, corpus(60))
    ones = labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)})
    assert all(r["predicted"] == 1 for r in Q.score_quality(d, Q.fit_quality(d, ones)).collect())
    assert all(r["predicted"] == 0 for r in X.score_toxicity(d, X.fit_toxicity(d, ones)).collect())


def test_sample_bound_and_repeats(spark):
    d, labels = tables(spark, corpus(80))
    sample = labelled_sample(d.unionByName(d), labels.unionByName(labels), "quality", limit=10).collect()
    assert 0 < len(sample) <= 10 and len({r["text"] for r in sample}) == len(sample)


def sparse(x):
    row, column = np.nonzero(x)
    return X.Sparse(np.searchsorted(row, np.arange(len(x) + 1)), column, x[row, column].astype(np.float32))


def test_block_max_search_is_exact():
    draw = np.random.default_rng(2)
    # A few columns in most entries, many in few; repeated entries.
    x = np.maximum(draw.standard_normal((300, 212)), 0) * (draw.random((300, 212)) < np.where(np.arange(212) < 12, 0.7, 0.02))
    x[250:] = x[:50]
    full = np.concatenate((x, np.full((300, 1), 0.8)), 1)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    index = X.BlockMaxIndex(sparse(full[:, :-1]), full[:, -1].astype(np.float32), 212, block=16)
    for k in (1, 20, 299):
        got, bound = index.cosines(sparse(full[:40, :-1]), full[:40, -1].astype(np.float32), k)
        exact = full[:40] @ full[index.order].T
        kth = np.sort(exact, 1)[:, -k]
        assert (bound <= kth + 1e-5).all()
        near = exact >= kth[:, None] - 1e-6
        assert np.allclose(got[:, :300][near], exact[near], atol=1e-5) and (got[:, 300:] == -1).all()
        other = got[:, :300][~near]
        assert (np.isclose(other, exact[~near], atol=1e-5) | (other == -1)).all()


def test_toxicity_votes_against_brute_force(spark):
    rows = corpus(150)
    d, labels = tables(spark, rows)
    model = X.fit_toxicity(d, labels, neighbours=7)
    vocabulary = {h: j for j, h in enumerate(model.vocabulary.hashes.tolist())}

    def vector(text):
        out = np.zeros(len(vocabulary) + 1)
        for h in scanned(text).hashes.tolist():
            if h in vocabulary:
                out[vocabulary[h]] += model.weight[vocabulary[h]]
        out[-1] = model.constant
        return out / np.linalg.norm(out)

    sample = labelled_sample(d, labels, "toxic").collect()
    words = {w for r in sample for w in scanned(r["text"]).hashes.tolist()}
    assert set(vocabulary) == words  # all words of the sample, none dropped
    each = {h: sum(h in set(scanned(t).hashes.tolist()) for _, t, _, _ in rows) for h in list(vocabulary)[:20]}
    assert all(model.df[vocabulary[h]] == n for h, n in each.items()) and model.documents == len(rows)
    examples, y = np.array([vector(r["text"]) for r in sample]), np.array([r["label"] for r in sample])
    scored = X.score_toxicity(d, model).collect()
    for r in scored[::7]:
        cos = np.minimum(examples @ vector(r["text"]), 1)
        last = np.sort(cos)[-7]
        above, tied = cos > last + 1e-6, np.abs(cos - last) <= 1e-6
        weight = np.exp((cos - 1) / model.width) * (above + tied * (7 - above.sum()) / tied.sum())
        assert abs(model.calibrate(np.array([weight @ y / weight.sum()]))[0] - r["score"]) < 0.02
        assert abs(r["neighbours"][0]["cosine"] - cos.max()) < 1e-5


def test_latent_votes_are_exact():
    draw = np.random.default_rng(4)
    counts = draw.integers(0, 5, (60, Q.TERMS)).astype(np.float32) * (draw.random((60, Q.TERMS)) < 0.01)
    labels = (draw.random(60) < 0.5).astype(float)
    model = Q.LatentVotes([(np.flatnonzero(r), r[r > 0]) for r in counts], labels, (counts > 0).sum(0), 60, rank=8, neighbours=5)
    v = model.vectors
    for q in range(10):
        cos = v @ v[q]
        near = np.argsort(-cos)[:5]
        want = (cos[near] ** model.sharpness @ labels[near]) / (cos[near] ** model.sharpness).sum()
        assert abs(model._votes(v[q : q + 1])[0] - want) < 1e-3


def test_calibration_is_monotone():
    draw = np.random.default_rng(1)
    votes = draw.random(500)
    fitted = Calibration(votes, (draw.random(500) < votes).astype(float))
    grid = fitted(np.linspace(0, 1, 50))
    assert (np.diff(grid) >= 0).all() and grid[0] < 0.2 and grid[-1] > 0.8


def test_toxicity_counts_above_255_keep_their_cosine():
    h = np.sort(scanned("bad worse").hashes)
    counts, labels = [np.array(x, np.float32) for x in ((600, 300), (300, 600), (1, 1))], np.array([1.0, 0.0, 0.0])
    model = X.ToxicityModel([h] * 3, counts, labels, lambda v: (np.array([3.0, 3.0]), 9), background=1.0)
    query = X.Sparse(np.array([0, 2]), np.array([0, 1]), np.array([900, 300], np.float32))
    _, near = model.score(query)
    own, other = (np.append(np.array(x) * model.weight, X.CONSTANT) for x in ((900, 300), (600, 300)))
    assert abs(near[0][0]["cosine"] - own @ other / np.linalg.norm(own) / np.linalg.norm(other)) < 1e-5
