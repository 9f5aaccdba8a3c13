import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tripquarry.llm import quality_rules as Q

from .helpers import ODD, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen, repeated, covered, lines = collections.Counter(zip(w, w[1:], w[2:])), 0, set(), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(re.findall("[A-Z]", text or "")), repeated, len(covered))


def test_statistics_against_brute_force(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice(["a", "b", "É", "#", "|", "x.y"]) + draw.choice([" ", "  ", "\n", "\t", "\x0b", " ", "\x1c "]) for _ in range(draw.randint(0, 120))) for _ in range(60)]
    rows = Q.with_statistics(docs(spark, texts + ODD)).collect()
    assert [tuple(r[c] for c in Q.STATS) for r in rows] == [brute(t) for t in texts + ODD]


def test_wide_texts_sort_structs(spark, monkeypatch):
    monkeypatch.setattr(Q, "_INDEX_BITS", 3)  # more windows than the packed form holds
    texts = ["a b c a b c d a b c", "a b c d e f g h i j k l a b c", "x y", "a a a a a a a a a a"]
    assert [r["n_repeat_words"] for r in Q.with_statistics(docs(spark, texts)).collect()] == [brute(t)[-1] for t in texts]


def test_windows_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(Q, "_INDEX_BITS", 60)  # four bits of hash: different windows meet often
    draw = random.Random(7)
    texts = [" ".join(draw.choice("abcde") for _ in range(draw.randint(3, 80))) for _ in range(40)]
    assert [r["n_repeat_words"] for r in Q.with_statistics(docs(spark, texts)).collect()] == [brute(t)[-1] for t in texts]


def plain_judgement(texts):
    """(posterior, failed by the base rules, kept) of each text, by plain loops over rows."""

    def votes(t):
        n, chars, symbols, upper, lines, repeats = brute(t)
        ratio = lambda a, b: a / b if b else None
        over = lambda x, limit: -1 if x is not None and x > limit else 0
        size, marks, again, caps = ratio(chars, n), ratio(symbols, n), ratio(repeats, n), ratio(upper, chars)
        prose = 0 if size is None else -1 if marks > 0.2 or caps > 0.3 or again > 0.35 else 1 if marks < 0.05 and caps < 0.15 and again < 0.25 and 3 <= size <= 9 else 0
        return [
            -1 if n < 50 else 1 if n >= 100 else 0,
            0 if size is None or 2 <= size <= 12 else -1,
            over(marks, 0.3), over(again, 0.35), over(ratio(lines, n), 0.02), over(caps, 0.3), prose,
        ]

    v = np.array([votes(t) for t in texts]) + 1
    prior = np.array([[0.02, 0.28, 0.70], [0.50, 0.45, 0.05]])
    share, p = 0.85, np.repeat(prior[:, None], v.shape[1], 1)

    def posterior():
        like = np.array([np.prod([p[c, m, v[:, m]] for m in range(v.shape[1])], 0) for c in (0, 1)])
        return share * like[0] / (share * like[0] + (1 - share) * like[1])

    for _ in range(100):
        post = posterior()
        share = (post.sum() + 20 * 0.85) / (len(v) + 20)
        for c, mass in ((0, post), (1, 1 - post)):
            for m in range(v.shape[1]):
                row = np.array([mass[v[:, m] == x].sum() for x in range(3)]) + 20 * prior[c]
                p[c, m] = row / row.sum()
    out = []
    for x, t in zip(posterior(), texts):
        n, repeats = brute(t)[0], brute(t)[-1]
        failed = n < 50 or 100 * repeats > 50 * n
        out.append((x, failed, not failed and x >= 0.5))
    return out


def test_whole_operator_against_plain_em(spark):
    good, bad = corpus()
    texts = good + bad + ODD
    for r, (x, failed, kept) in zip(Q.quality_rules(docs(spark, texts)).collect(), plain_judgement(texts)):
        assert abs(r["p_good"] - x) < 1e-6 and r["base_failed"] == failed and (r["kept"] == kept or abs(x - 0.5) < 1e-6)


def test_filters_on_statistics(spark):
    assert Q.with_statistics(docs(spark, ODD)).where("n_repeat_words > 0 and n_words > 3").count() == sum(brute(t)[-1] > 0 for t in ODD)


def corpus():
    draw = random.Random(4)
    prose = lambda: " ".join(draw.choice("lorem ipsum dolor amet elit sed magna".split()) + str(draw.randint(0, 10**6)) for _ in range(150)).lower()
    good = [prose() for _ in range(80)]
    bad = ["% | ".join(prose().split()) for _ in range(8)] + [prose().upper() + "!!" for _ in range(8)] + ["in. " * 60 + prose() for _ in range(4)]
    return good, bad


def test_label_model_finds_junk(spark):
    good, bad = corpus()
    rows = Q.quality_rules(docs(spark, good + bad)).collect()
    kept = {r["text"] for r in rows if r["kept"]}
    assert set(good) <= kept and not kept & set(bad[:16])
    assert all(0 <= r["p_good"] <= 1 for r in rows)


def test_em_recovers_accuracies():
    draw, patterns = random.Random(0), collections.Counter()
    for _ in range(20000):
        y = draw.random() < 0.8
        patterns[tuple((-1 if draw.random() < (0.02 if y else 0.7) else 0) for _ in range(4))] += 1
    model = Q.fit_label_model(sorted(patterns.items()), 4)
    assert abs(model.share - 0.8) < 0.03 and all(abs(b[0] - 0.7) < 0.05 and abs(g[0] - 0.02) < 0.02 for g, b in zip(model.good, model.bad))


def test_edges(spark):
    rows = Q.quality_rules(docs(spark, ODD, extra=["kept", "N_words"])).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows if r["n_words"] < 50) and "kept_in" in rows[0].__fields__
    assert Q.quality_rules(docs(spark, ODD), keep=["doc_id"]).count() == len(ODD)
    assert Q.quality_rules(empty(spark)).count() == 0
    assert Q.filter_quality(docs(spark, ODD, extra=["n_words"])).columns == ["doc_id", "text", "lang", "source", "n_words"]
    judged = Q.quality_rules(docs(spark, ODD))
    assert judged.where(F.col("base_failed") != ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.quality_rules(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
