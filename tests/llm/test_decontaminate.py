import hashlib
import random

from pyspark.sql import functions as F

from tripquarry.llm import decontaminate as D

from .helpers import ODD, docs, empty, words


def brute(texts, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - min(n, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + min(n, len(w))]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (who := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= who
        out.append((len(w), len(hit), sorted({str(x) for x in found if x is not None})))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check(spark, texts, items, **options):
    rows = D.mark_contamination(docs(spark, texts).withColumn("at", F.monotonically_increasing_id()).coalesce(1), bench(spark, items), **options).orderBy("at").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows] == brute(texts, items)
    return rows


def test_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Über", "42"]
    make = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, make(draw.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(40)] + [(7, "w1 w2 w3"), (None, "w3 w4"), (90, None), (91, "--")]
    texts = [make(draw.randint(0, 200)) for _ in range(40)] + [a[1] for a in items[:10]] + ODD
    check(spark, texts, items)
    # Blocks of one item each give the same.
    check(spark, texts[:30], items[:6], block_bytes=1)


def test_empty_tables_and_clashes(spark):
    assert D.mark_contamination(empty(spark), bench(spark, [(1, "a b")])).count() == 0
    rows = D.mark_contamination(docs(spark, ODD, extra=["N_Hit", "items", "_words"]), bench(spark, [])).collect()
    assert not any(r["contaminated"] for r in rows) and "items_in" in rows[0].__fields__ and "N_Hit_in" in rows[0].__fields__


def test_removal(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    texts = ["clean text here", f"Before, {passage}! After é.", passage]
    kept = D.decontaminate(docs(spark, texts), bench(spark, [(1, passage)]))
    assert [r["text"] for r in kept.collect()] == ["clean text here"] and kept.columns == ["doc_id", "text", "lang", "source"]
    cut = D.decontaminate(docs(spark, texts), bench(spark, [(1, passage)]), remove="spans").orderBy("doc_id").collect()
    assert [r["text"] for r in cut] == ["clean text here", "Before, ! After é.", ""]


def test_query_digest(spark, tmp_path):
    from tripquarry.llm import queries

    docs(spark, ["a b", "c"]).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark, [(10, "a b"), (9, "a")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    assert got[0]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and got[0]["n_items"] == 2
    assert got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not got[1]["contaminated"]
