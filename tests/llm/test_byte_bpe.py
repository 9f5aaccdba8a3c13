import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tripquarry.llm import byte_bpe as B
from tripquarry.llm import queries, token_counts, wordscan

from .helpers import ODD, docs, empty


@pytest.fixture(scope="module")
def tok():
    return queries.tokenizer()


@pytest.fixture(scope="module")
def library(tok):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})


def odd_texts(n=4000, seed=0):
    draw = random.Random(seed)
    alphabet = " '  \n\t 　\u0085abcsltremvdLÉ1٣²½,.!?é漢😀\r\x1c​́"
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(n)] + ["a" * 3000, "  " * 900, "abab" * 400, "x's's 'll've", "\n\n x", "ab" * 50, *[t or "" for t in ODD]]


def encoded(tok, texts, **options):
    enc = B.Encoder(tok, **options)
    data, offsets = wordscan.text_buffers(pa.array(texts, pa.string()))
    out = []
    for lo, hi in wordscan.slices(offsets, 5000):
        ids, counts = enc.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out += np.split(ids, np.cumsum(counts)[:-1])
    return [x.tolist() for x in out]


def test_same_ids_as_the_library(tok, library):
    texts = odd_texts()
    got = encoded(tok, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert encoded(tok, texts[:300], cache=5) == got[:300]


def test_scan_equals_a_plain_walk():
    scan, draw = B._scan_tables(), np.random.default_rng(0)
    for n in (1, 255, 256, 257, 3000):
        symbols = draw.integers(0, 8, n).astype(np.uint8)
        symbols[0] += B.FRESH
        state, want = B.COMPLETE, []
        for s in symbols.tolist():
            state, begins = B._step(state, s)
            want.append(begins)
        assert scan.boundaries(symbols).tolist() == want


def test_frames(spark, tok, library):
    frame = docs(spark, ODD, extra=["ids", "N_tokens"])
    rows = B.encode(frame, tok, outputs=tuple(B.OUTPUTS)).collect()
    for r in rows:
        want = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        raw = (r["text"] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["token_starts"] == np.concatenate(([0], np.cumsum([len(library.decode_single_token_bytes(i)) for i in want])))[: len(want)].astype(int).tolist()
    assert "ids_in" in rows[0].__fields__ and "N_tokens_in" in rows[0].__fields__
    back = B.decode(B.encode(docs(spark, ODD), tok), tok).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert B.encode(empty(spark), tok).count() == 0


def spans(library, text):
    """Character spans of tokens, by decoding prefixes."""
    out, raw, at = [], text.encode(), 0
    number = np.cumsum([(b & 0xC0) != 0x80 for b in raw]) - 1
    for i in library.encode_ordinary(text):
        n = len(library.decode_single_token_bytes(i))
        out.append((int(number[at]), int(number[at + n - 1]) + 1))
        at += n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_line_attribution(spark, tok, library, rule):
    texts = ["a b\nc d\n\n\ne", "one\n", "\n\n  \n x", "漢字\n漢", "no break", "", None, "a\r\n\r\nb 'll\n"]
    got = token_counts.count_section_tokens(docs(spark, texts, extra=["n_crossing"]), tok, rule=rule).collect()
    for r in got:
        text = r["text"] or ""
        ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
        ends += [len(text)] if not text.endswith("\n") else []
        starts = [0, *ends[:-1]]
        want, cross = [0.0] * len(ends), 0
        for a, b in spans(library, text):
            held = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
            inside = [i for i, h in enumerate(held) if h]
            cross += len(inside) > 1
            if rule == "split":
                for i in inside:
                    want[i] += held[i] / (b - a)
            else:
                want[{"first": inside[0], "last": inside[-1], "most": max(inside, key=lambda i: (held[i], -i))}[rule]] += 1
        assert r["section_ends"] == ends and np.allclose(r["section_tokens"], want) and r["n_crossing"] == cross
        assert abs(sum(r["section_tokens"]) - r["n_tokens"]) < 1e-9


def test_field_attribution(spark, tok, library):
    rows = token_counts.count_field_tokens(docs(spark, ODD), tok, ["lang", "source", "text"], rule="first").collect()
    for r in rows:
        whole = "\n".join([r["lang"] or "", r["source"] or "", r["text"] or ""])
        assert r["n_tokens"] == len(library.encode_ordinary(whole)) == sum(r["field_tokens"].asDict().values())
    assert token_counts.count_field_tokens(empty(spark), tok, ["text"]).count() == 0
