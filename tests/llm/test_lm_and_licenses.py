import math
import random

import numpy as np
import pyarrow as pa

from tripquarry.llm import license_scan as S
from tripquarry.llm import license_texts as X
from tripquarry.llm import lm_scoring as L
from tripquarry.llm import wordscan

from .helpers import ODD, docs, empty, words


def test_word_counts(spark):
    texts = ["a b a", "B cat", None, "", "Hat"]
    h = wordscan.Words(*wordscan.text_buffers(pa.array(["a b cat hat"]))).hashes.view(np.int64).tolist()
    got = {r["hash"]: (r["ending"], r["n"]) for r in L.word_counts(docs(spark, texts)).collect()}
    code = lambda s: ord(s[-1]) << 8 | (ord(s[-2]) if len(s) > 1 else 0)
    assert got == dict(zip(h, [(code("a"), 2), (code("b"), 2), (code("cat"), 1), (code("hat"), 1)]))


def babble(draw, n):
    """Texts in two languages that share no word and no ending."""
    speech = [[f"w{i}{a}{b}" for i in range(150) for a, b in (e, e[::-1])] for e in ("or", "un")]
    return [" ".join(draw.choice(["the", "of"]) if draw.random() < 0.2 else draw.choice(own) for _ in range(draw.randint(5, 80))) for own in (draw.choice(speech) for _ in range(n))]


def scanned(text):
    return wordscan.Words(*wordscan.text_buffers(pa.array([text or ""])))


def test_scores_against_a_plain_walk(spark):
    texts = babble(random.Random(2), 60) + ODD
    frame = docs(spark, texts, extra=["log_prob"])
    lexicon = L.gather_lexicon(frame)
    network = L.train_network(frame, lexicon)
    rows = L.score_lm(frame, lexicon, network).collect()
    for r in rows:
        classes, within = lexicon.classes(scanned(r["text"]))
        assert r["n_words"] == len(words(r["text"])) == len(classes)
        if len(classes) > 2000:
            continue
        total = 0.0
        for i, c in enumerate(classes):
            left, right = (classes[j] if 0 <= j < len(classes) else lexicon.size for j in (i - 1, i + 1))
            z = np.tanh(network.left[left].astype(float) + network.right[right] + network.hidden) @ network.out + network.bias
            total += z[c] - math.log(np.exp(z - z.max()).sum()) - z.max() + within[i]
        assert abs(total - r["log_prob"]) < 1e-3 * max(1, abs(total))
        if len(classes):
            assert abs(r["score"] * len(classes) - r["log_prob"]) < 1e-6 and abs(r["perplexity"] / math.exp(-r["score"]) - 1) < 1e-9
        else:
            assert r["score"] is None and r["perplexity"] is None and r["log_prob"] == 0
    assert "log_prob_in" in rows[0].__fields__
    assert L.lm_scores(empty(spark)).count() == 0


def test_every_window_is_counted_whatever_the_partitions(spark):
    texts = babble(random.Random(3), 200) + [None, "", "one"]
    frame = docs(spark, texts)
    lexicon = L.gather_lexicon(frame)
    want = np.zeros(((lexicon.size + 1) ** 2, lexicon.size), int)
    for text in texts:
        x = [lexicon.size, *lexicon.classes(scanned(text))[0].tolist(), lexicon.size]
        for left, here, right in zip(x, x[1:], x[2:]):
            want[left * (lexicon.size + 1) + right, here] += 1
    shared = spark.sparkContext.broadcast(lexicon)
    assert (L.window_counts(frame, shared, lexicon.size) == want).all()
    answers = [sorted((r["doc_id"] or -1, r["score"] or 0, r["log_prob"]) for r in L.lm_scores(frame.repartition(n)).collect()) for n in (1, 4, 16)]
    assert answers[0] == answers[1] == answers[2]


def test_words_of_a_class_share_its_probability(spark):
    frame = docs(spark, babble(random.Random(4), 200))
    counts = {r["hash"]: r["n"] for r in L.word_counts(frame).collect()}
    vocabulary = scanned(" ".join(sorted({w for r in frame.collect() for w in words(r["text"])})))
    for bound in (1 << 20, 200, 20):
        lexicon = L.gather_lexicon(frame, own_words=bound)
        assert len(lexicon.hashes) <= bound
        classes, within = lexicon.classes(vocabulary)
        mass = np.bincount(classes, np.exp(within.astype(float)), lexicon.size)
        assert np.allclose(mass[np.unique(classes)], 1, atol=1e-4)
        own = np.isin(vocabulary.hashes, lexicon.hashes)
        n = np.array([counts[h] for h in vocabulary.hashes.view(np.int64).tolist()])
        assert np.allclose(np.exp(within[own]), (n / lexicon.totals[classes])[own], rtol=1e-4)
        assert not own.any() or own.all() or n[own].min() > n[~own].max()


def test_held_out_texts_are_likelier_than_by_frequency_alone(spark):
    texts = babble(random.Random(5), 600)
    seen, held = docs(spark, texts[:400]), docs(spark, texts[400:])
    lexicon = L.gather_lexicon(seen)
    network = L.train_network(seen, lexicon)
    rows = L.score_lm(held, lexicon, network).collect()
    n = sum(r["n_words"] for r in rows)
    alone = 0.0
    for text in texts[400:]:
        x, within = lexicon.classes(scanned(text))
        alone += float((np.log(np.maximum(lexicon.totals, 0.5) / lexicon.totals.sum())[x] + within).sum())
    assert sum(r["log_prob"] for r in rows) / n > alone / n + 0.4  # of ln 2 at most, for four words in five


def matches(texts, templates=None):
    index, out = S.TemplateIndex(X.default_templates() if templates is None else templates), []
    for lo, hi, w in wordscan.scan(pa.array(texts, pa.string())):
        out += S._matches(index, w, hi - lo)
    return out


def test_licenses_whole_edited_and_absent():
    mit = X.OPENINGS["MIT"]
    cut = mit.split()
    edited = " ".join(w for i, w in enumerate(cut) if i not in (10, 30)) + " thanks"
    texts = [f"Intro é.\n{mit}\nEnd", edited, "plain words only here", " ".join(cut[:20]), "", None, f"{mit} {mit}"]
    got = matches(texts, {"mit": mit})
    assert [(m["license"], m["coverage"]) for m in got[0]] == [("mit", 1.0)] and texts[0][got[0][0]["start"] : got[0][0]["end"]] == mit
    assert 0.9 < got[1][0]["coverage"] < 1 and got[2] == got[3] == got[4] == got[5] == []
    assert len(got[6]) == 2 and all(m["coverage"] == 1 for m in got[6])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


CONFUSABLE = [
    ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("GNU General Public License, version 2", "GPL-2.0"),
    ("GNU General Public License, version 3", "GPL-3.0"),
    ("GNU General Public License, version 3.0", "GPL-3.0"),
    ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("GNU Library General Public License, version 3", None),
    ("GNU General Public License, version 7", None),
    ("Mozilla Public License, version 2.0", "MPL-2.0"),
    ("Mozilla Public License, version 1.1", "MPL-1.1"),
    ("Apache License, Version 2.0", "Apache-2.0"),
    ("Apache License, Version 1.1", None),
    ("Public License, Version 2.0", None),
    ("MIT License", "MIT"),
    ("ISC License", "ISC"),
    ("BSD 2-Clause License", "BSD-2-Clause"),
    ("BSD 3-Clause License", "BSD-3-Clause"),
    *((f"CC {kind} {version}", f"CC-{kind}-{version}") for kind in X.CREATIVE_KINDS for version in X.CREATIVE_VERSIONS),
    ("CC BY 4.1", None),
    ("Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 3.0", "CC-BY-NC-ND-3.0"),
]


def test_each_license_is_named_right_or_not_at_all():
    cases = [(f"{lead} {name}.", want) for lead in ("Licensed under the", "Released under the terms of the", "This work is licensed under a") for name, want in CONFUSABLE]
    ids = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1", "CC-BY-NC-SA-4.0", "BSD-3-Clause", "MPL-2.0"]
    cases += [(f"// SPDX-License-Identifier: {x}", x.removesuffix("-only").removesuffix("-or-later")) for x in ids]
    cases += [("SPDX-License-Identifier: MIT-0", None), ("SPDX-License-Identifier: Apache-1.1", None), ("the licensed version 2 of it under MIT", None), ("Released under MIT License", "MIT"), ("Released under an MIT License", "MIT"), ("Released under the usual MIT License", "MIT")]
    cases += [(text, name) for name, text in [*X.NOTICES.items(), *X.BODIES.items()]]
    # GPL and LGPL notices differ by one word, BSD licenses by one clause, ISC and 0BSD by one.
    for (text, want), found in zip(cases, matches([f"words before. {t}\nand words after" for t, _ in cases])):
        assert [m["license"] for m in found] == ([want] if want else []), (text, found)


def test_one_word_edits_of_strict_templates():
    telling = S._TELLING | {b"%d" % i for i in range(10)}
    cases = []
    for t in X.default_templates():
        w = words(t.text)
        if t.strict and 5 <= len(w) <= S.SHORT:
            for i in range(len(w)):
                if w[i].encode() not in telling and not w[i][-1].isdigit():
                    cases += [(" ".join(x), t.license) for x in (w[:i] + w[i + 1 :], w[:i] + ["zzz"] + w[i + 1 :], w[:i] + ["zzz"] + w[i:]) if len(w) >= 5]
                else:
                    cases.append((" ".join(w[:i] + ["zzz"] + w[i + 1 :]), None))
    cases = cases[::17]
    for (c, name), found in zip(cases, matches([f"some words before it. {c} and some words after it" for c, _ in cases])):
        if name:
            assert name in {m["license"] for m in found}, (c, name, found)


def test_whole_operator_against_every_place_and_template():
    """Every strict statement that an exhaustive alignment at every place finds is found."""
    templates = [t for t in X.default_templates() if t.strict and len(words(t.text)) <= 9][::5]
    draw, index = random.Random(9), S.TemplateIndex(templates)
    pool = sorted({w for t in templates for w in words(t.text)})
    texts = []
    for _ in range(150):
        w = words(draw.choice(templates).text)
        for _ in range(draw.randint(0, 2)):
            i = draw.randrange(len(w))
            w[i : i + draw.randint(0, 1)] = [draw.choice(pool)] if draw.random() < 0.6 else []
        texts.append(" ".join(["x"] * draw.randint(0, 5) + w + ["y"] * draw.randint(0, 5)))
    for text, found in zip(texts, matches(texts, templates)):
        w, best = scanned(text), 0.0
        for i, t in enumerate(templates):
            m, first, end = S.align(index.words[i], w.hashes, 0, band=40)
            cover = m / max(len(index.words[i]), end - first)
            if m and cover >= 0.8 and S.telling(w, first, end) == index.telling[i]:
                best = max(best, m * cover)
        assert abs(max((m["matched"] * m["coverage"] for m in found), default=0) - best) < 1e-9, (text, found, best)


def test_alignment_equals_the_longest_common_subsequence():
    draw = np.random.default_rng(0)
    for _ in range(200):
        a, b = draw.integers(0, 4, draw.integers(1, 10)), draw.integers(0, 4, draw.integers(1, 10))
        got, first, end = S.align(a, b, 0, band=12)  # a band that holds every diagonal
        assert got == lcs(a.tolist(), b.tolist())
        if got:
            assert 0 <= first < end <= len(b) and lcs(a.tolist(), b[first:end].tolist()) == got


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    kept = set(S.winnowed(h, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(197))


def test_license_frames(spark):
    rows = S.scan_licenses(docs(spark, [*ODD, "Released under the MIT License."], extra=["matches"])).collect()
    assert [m["license"] for m in rows[-1]["matches"]] == ["MIT"] and all(r["matches"] == [] for r in rows[:-1])
    assert S.scan_licenses(empty(spark)).count() == 0 and S.scan_licenses(docs(spark, ODD), {}).where("size(matches) > 0").count() == 0
