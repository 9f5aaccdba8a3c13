"""Operator 9: license scans.

Templates are word sequences: identifiers, statements, notices and whole licenses.  Candidates are
(template, diagonal) pairs, found in three ways that one index holds:

* a *strict* template (an identifier, statement or notice) by one of its telling words, such as
  the license's name, all of which a match must have;
* another template of up to ``SHORT`` words by single words: if ``need`` of its m words must match, any
  m - need + 1 of its places hold a match, so those (of the longest words) are indexed;
* longer templates by winnowed fingerprints (of each window of consecutive k-word hashes the least
  is kept).

A candidate whose words, as a bag, can't reach the coverage is dropped; a banded alignment of the
words of each other one reports how many template words are matched and where.  Coverage is
matched words / the larger of the template's words and the words between the first and last
match, so that words left out and words put in both count against it.  A strict template's match
must have, between its ends, exactly the template's telling words (names, kinds such as "lesser"
or "nc", versions), and an identifier or version must end where the template's does.  Of
overlapping matches that with the most matched words times coverage stays.

Defined results: null and empty texts have no matches; templates of fewer than k words are one
fingerprint of all their words; ties go to the earlier match, then the lesser license; an empty
template list finds nothing; repeated rows are scanned alike.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import wordscan
from .frames import aside, map_batches
from .license_texts import ANCHORS, TELLING, Template, default_templates

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 6, 0.8
SHORT = 16  # words of templates that are looked for by single words

_ANCHORS = {w.encode() for w in ANCHORS}
_TELLING = _ANCHORS | {w.encode() for w in TELLING}
_NUMBER = re.compile(rb"v?[0-9]+")


def telling(words: wordscan.Words, a: int, b: int) -> Counter:
    """The words from a to b that tell licenses apart."""
    found = (words.word(i) for i in range(a, b))
    return Counter(w for w in found if w in _TELLING or _NUMBER.fullmatch(w))


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every window, the rightmost on ties."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


class TemplateIndex:
    def __init__(self, templates: dict[str, str] | list[Template], k: int = GRAM, window: int = WINDOW, least: float = COVERAGE):
        if isinstance(templates, dict):
            templates = [Template(name, "text", text, False) for name, text in sorted(templates.items())]
        self.k, self.least, self.templates = k, least, templates
        self.words, self.bags, self.need, self.telling, self.band = [], [], [], [], []
        prints, single = [], []
        for i, template in enumerate(templates):
            words = wordscan.Words(*wordscan.text_buffers(pa.array([template.text], pa.string())))
            h, m = words.hashes, len(words.starts)
            self.words.append(h)
            self.bags.append(Counter(h.tolist()))
            self.need.append(max(1, int(np.ceil(least * m - 1e-9))))
            self.telling.append(telling(words, 0, m) if template.strict else None)
            self.band.append(max(BAND, m // 16))
            anchors = [p for p in range(m) if words.word(p) in _ANCHORS] if template.strict else []
            if anchors:
                p = max(anchors, key=lambda p: (words.word(p) == b"spdx", words.ends[p] - words.starts[p]))
                single.append((int(h[p]), i, p))
            elif m <= SHORT:
                places = np.argsort(words.starts - words.ends, kind="stable")[: m - self.need[i] + 1]
                single += [(int(h[p]), i, int(p)) for p in places]
            else:
                grams, at = words.grams(min(k, m))
                prints += [(int(grams[p]), i, int(at[p])) for p in winnowed(grams, window)]
        self.single, self.prints = self._sorted(single), self._sorted(prints)

    @staticmethod
    def _sorted(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
        """(sorted hashes, the (template, place) of each, a bit table of their high bits)."""
        rows = sorted(rows)
        hashes = np.array([r[0] for r in rows], np.uint64)
        bits = np.zeros(1 << 16, bool)
        bits[(hashes >> np.uint64(48)).astype(np.int64)] = True
        return hashes, [r[1:] for r in rows], bits

    def candidates(self, words: wordscan.Words):
        """Distinct (text, template, first word that the template's start would be at, rounded to
        half the band)."""
        found, texts = set(), words.texts
        grams, at = words.grams(self.k)
        for (hashes, where, bits), h, places in ((self.single, words.hashes, np.arange(len(words.starts))), (self.prints, grams, at)):
            maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
            left, right = np.searchsorted(hashes, h[maybe]), np.searchsorted(hashes, h[maybe], "right")
            hit = right > left
            for p, lo, hi in zip(places[maybe[hit]].tolist(), left[hit].tolist(), right[hit].tolist()):
                for template, place in where[lo:hi]:
                    start = p - place
                    found.add((int(texts[p]), template, start - start % (self.band[template] // 2)))
        return sorted(found)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end in the text) of the best alignment whose diagonal stays within
    ``band`` of ``shift``.

    The longest common subsequence inside the band; of equal ones, that with the shortest reach
    in the text.
    """
    n, width = len(text), 2 * band + 1
    # best[j]: (matched, -first) on diagonal shift - band + j after the template words so far.
    matched, first = np.zeros(width + 2, np.int64), np.full(width + 2, -1, np.int64)
    end = np.full(width + 2, -1, np.int64)
    for i, word in enumerate(template):
        new_m, new_f, new_e = matched.copy(), first.copy(), end.copy()
        # Skipping a template word moves one diagonal down: from j + 1 to j.
        for j in range(width):
            if (matched[j + 1], first[j + 1]) > (new_m[j], new_f[j]):
                new_m[j], new_f[j], new_e[j] = matched[j + 1], first[j + 1], end[j + 1]
            p = i + shift - band + j
            if 0 <= p < n and text[p] == word:
                m, f = matched[j] + 1, first[j] if matched[j] else p
                if (m, f) > (new_m[j], new_f[j]):
                    new_m[j], new_f[j], new_e[j] = m, f, p + 1
            # Skipping a text word moves one diagonal up: from j - 1 to j.
            if j and (new_m[j - 1], new_f[j - 1]) > (new_m[j], new_f[j]):
                new_m[j], new_f[j], new_e[j] = new_m[j - 1], new_f[j - 1], new_e[j - 1]
        matched, first, end = new_m, new_f, new_e
    best = max(range(width), key=lambda j: (matched[j], first[j], -end[j]))
    return int(matched[best]), int(first[best]), int(end[best])


_FIELDS = [("license", pa.string()), ("kind", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
_ARROW = pa.list_(pa.struct(_FIELDS))
_MATCH = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if t == pa.string() else T.DoubleType() if t == pa.float64() else T.LongType()) for n, t in _FIELDS]))


def _goes_on(words: wordscan.Words, i: int, end: int) -> bool:
    """An identifier or version ends with word i, but is continued by the next word."""
    if i + 1 >= end or words.starts[i + 1] != words.ends[i] + 1:
        return False
    joint, word = words.data[words.ends[i]], words.word(i + 1)
    return joint in b".-" and not (joint == 46 and word == b"0") and (word in _TELLING or _NUMBER.fullmatch(word) is not None)


def _matches(index: TemplateIndex, words: wordscan.Words, n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    found: dict[int, set] = {}
    for text, i, start in index.candidates(words):
        lo, hi = int(words.of_text[text]), int(words.of_text[text + 1])
        pattern, band = index.words[i], index.band[i]
        a, b = max(lo, start - band), min(hi, start + len(pattern) + 2 * band)
        here = words.hashes[a:b]
        if (index.bags[i] & Counter(here.tolist())).total() < index.need[i]:
            continue
        matched, first, end = align(pattern, here, start - a + band // 4, band)
        coverage = matched / max(len(pattern), end - first)
        if not matched or coverage < index.least - 1e-9:
            continue
        first, end = a + first, a + end
        if index.telling[i] is not None and (telling(words, first, end) != index.telling[i] or _goes_on(words, end - 1, hi)):
            continue
        template = index.templates[i]
        found.setdefault(text, set()).add((-matched * coverage, first, template.license, template.kind, end, matched, coverage))
    for text, each in found.items():
        kept: list[tuple] = []
        for m in sorted(each):
            if all(m[4] <= k[1] or m[1] >= k[4] for k in kept):
                kept.append(m)
        data = words.data[words.offsets[text] : words.offsets[text + 1]]
        spans = wordscan.char_offsets(data, np.array([[words.starts[m[1]], words.ends[m[4] - 1]] for m in kept]) - words.offsets[text])
        out[text] = [{"license": m[2], "kind": m[3], "coverage": m[6], "matched": m[5], "start": int(s), "end": int(e)} for m, (s, e) in zip(kept, spans)]
        out[text].sort(key=lambda r: (r["start"], r["end"], r["license"]))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | list[Template] | None = None, *, coverage: float = COVERAGE, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``matches``: (license, kind of template, coverage, matched words, start, end in code
    points), in order of place.  ``templates`` may be texts by license, or ``Template`` rows."""
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(default_templates() if templates is None else templates, least=coverage))
    docs, keep = aside(docs, [c for c in ["matches"] if c != text_col], keep)

    def make():
        index: TemplateIndex = shared.value

        def work(batch: pa.RecordBatch):
            for lo, hi, words in wordscan.scan(batch.column(text_col)):
                yield lo, hi, {"matches": pa.array(_matches(index, words, hi - lo), _ARROW)}

        return work

    return map_batches(docs, [("matches", _MATCH)], make, keep)
