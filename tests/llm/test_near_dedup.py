import itertools
import random

import numpy as np
import pyarrow as pa

from tripquarry.llm import near_dedup as N
from tripquarry.llm import wordscan
from tripquarry.llm.components import connected_components

from .helpers import ODD, docs, empty, words


def family(draw, size, edits, tag):
    base = [f"{tag}{draw.randint(0, 10**6)}" for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        w = base[:]
        for _ in range(edits):
            w[draw.randrange(len(w))] = f"{tag}e{draw.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_against_all_pairs(spark):
    draw = random.Random(8)
    texts = [t for f in range(25) for t in family(draw, 4, f % 4, f"f{f}x")] + family(draw, 60, 1, "big") + ["short one", "Short, one!", "a b c d e f"]
    weigher = N.Weigher(*sketch(texts))
    sets = features(weigher, texts)
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if weigher.similarity(*sets[a], *sets[b]) >= 0.8]
    want = components(len(texts), links)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.near_classes(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = N.drop_near_copies(frame)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == frame.columns


def features(weigher, texts):
    out = []
    for _, _, w in wordscan.scan(pa.array(texts), 1):
        h, _, level = weigher.weighted(w)
        out.append((h, level))
    return out


def sketch(texts):
    total = np.zeros((N.SKETCH_ROWS, 1 << N.SKETCH_BITS), np.int64)
    for _, _, w in wordscan.scan(pa.array(texts), 1):
        h, _, _ = N.counted(*N.shingles(w))
        for r in range(N.SKETCH_ROWS):
            np.add.at(total[r], np.unique(N._slots(h, r), return_index=True)[0], 1)
    return total, len(texts)


def test_sketch_counts_documents(spark):
    texts = ["a b c d e f", "a b c d e", "x"]
    got, n = N.frequency_sketch(docs(spark, texts), "text")
    assert n == 3 and (got >= 0).all() and got.sum(1).tolist() == [4, 4]
    h = wordscan.Words(*wordscan.text_buffers(pa.array(["a b c d e"]))).grams(5)[0]
    assert [int(got[r, N._slots(h, r)[0]]) for r in range(2)] == [2, 2]


def test_samples_estimate_weighted_similarity():
    draw = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    w = base[:]
    for _ in range(12):
        w[draw.randrange(400)] = "edit"
    weigher = N.Weigher(np.ones((2, 1 << N.SKETCH_BITS), np.int64), 1000)
    a, b = features(weigher, [" ".join(base), " ".join(w)])
    exact = weigher.similarity(*a, *b)
    # Bands agree with probability similarity ** rows.
    agree, trials = 0, 0
    for shift in range(30):
        salt = np.uint64(draw.getrandbits(63) | 1)
        rows = [weigher.bands(wordscan.mixed(h * salt), np.zeros(len(h), np.int64), level, 1)[0] for h, level in (a, b)]
        agree += int((rows[0] == rows[1]).sum())
        trials += N.BANDS
    assert abs(agree / trials - exact**N.ROWS) < 0.08


def test_odd_rows(spark):
    rows = N.near_classes(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[9]["class_id"] == by[10]["class_id"] == 9 and by[0]["class_id"] == 0 and by[1]["class_id"] == 1
    kept = N.drop_near_copies(docs(spark, ODD, extra=["class_id", "_key"]))
    assert kept.count() == len(ODD) - 1 and kept.columns[-2:] == ["class_id", "_key"]
    assert N.near_classes(empty(spark)).count() == 0 and N.drop_near_copies(empty(spark)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    frame = spark.createDataFrame([(1, a), (1, b), (2, b), (3, b + " c"), (1, a)], "doc_id long, text string")
    rows = N.near_classes(frame).collect()
    assert {(r["doc_id"], bytes(r["_key"])) for r in rows if r["representative"]} and all(r["class_id"] == 1 for r in rows)
    assert sorted(r["text"] for r in N.drop_near_copies(frame).collect()) == [a, b]


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 1), (7, 7)]
    want = components(600, [(a, b) for a, b in links if a is not None and b is not None])
    for limit in (0, 10**6):  # distributed rounds, and one task
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), one_task=limit).collect()}
        assert all(want[k] == v for k, v in got.items())
        assert {k for k, v in enumerate(want) if v != k} <= set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_at_every_switch(spark):
    draw = random.Random(12)
    # Shuffled paths with chords: more links than nodes at first, as many as nodes later.
    links = []
    for c in range(3):
        nodes = draw.sample(range(c * 100, c * 100 + 100), 100)
        links += [(nodes[i], nodes[j]) for i in range(100) for j in range(i + 1, min(100, i + 4))]
    want = components(300, links)
    frame = spark.createDataFrame(links, "a long, b long")
    for limit in (0, 297, 400, len(links) - 1):
        rows = connected_components(frame, one_task=limit).collect()
        assert len(rows) == 300 and all(want[r["node"]] == r["root"] for r in rows), limit


def test_classes_whatever_the_switch_and_the_partitions(spark, monkeypatch):
    from tripquarry.llm import components as C

    draw = random.Random(4)
    texts = []
    for f in range(4):  # chains: each text is an edit of the one before it
        w = [f"c{f}x{i}" for i in range(150)]
        for step in range(12):
            w = w[:]
            w[(step * 11) % 150] = f"e{f}x{step}"
            texts.append(" ".join(w))
    draw.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    answers = []
    for limit, parts in ((10**6, 1), (20, 7)):
        monkeypatch.setattr(N, "connected_components", lambda e, limit=limit: C.connected_components(e, one_task=limit))
        rows = N.near_classes(frame.repartition(parts)).collect()
        assert len(rows) == len(texts)
        answers.append({r["doc_id"]: r["class_id"] for r in rows})
    assert answers[0] == answers[1] and len(set(answers[0].values())) == 4


def test_rows_without_words_stay_even_with_one_id(spark):
    frame = spark.createDataFrame([(1, ""), (1, ""), (1, None), (None, "..."), (2, "a b"), (2, "a b"), (3, "A, b")], "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in N.drop_near_copies(frame).collect())
    assert kept == [(0, "..."), (1, ""), (1, ""), (1, ""), (2, "a b")]


def test_one_original_links_copies_that_do_not_link_each_other(spark):
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 10**9)}" for _ in range(200)]
    texts = [" ".join(base)]
    for c in range(1000):
        w = base[:]
        for i in draw.sample(range(0, 200, 10), 4):
            w[i] = f"e{c}x{i}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["class_id"] for r in N.near_classes(frame).collect()}
    assert got == {0}


def test_blocks_compare_every_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 7)
    draw = random.Random(6)
    texts = []
    for f in range(3):
        base = [f"b{f}x{draw.randint(0, 10**9)}" for _ in range(200)]
        for c in range(60):
            w = base[:]
            for i in draw.sample(range(0, 200, 10), 3 + f):
                w[i] = f"e{f}x{c}x{i}"
            texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketch, n = N.frequency_sketch(frame, "text")
    weigher = N.Weigher(sketch, n)
    w = wordscan.Words(*wordscan.text_buffers(pa.array(texts)))
    h, t, level = weigher.weighted(w)
    bands = weigher.bands(h, t, level, len(texts))
    sets = [(h[t == i], level[t == i]) for i in range(len(texts))]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (bands[i] == bands[j]).any() and weigher.similarity(*sets[i], *sets[j]) >= N.SIMILARITY - 1e-12]
    assert {r["doc_id"]: r["class_id"] for r in N.near_classes(frame).collect()} == dict(enumerate(components(len(texts), links)))
