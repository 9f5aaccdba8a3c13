"""Operator 5: byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised and uses no regular expression.  Code points become classes
(letter, number, space, other), classes and one or two characters of lookahead become symbols,
and a symbol is a function from automaton state to automaton state.  The functions that occur
form a small monoid whose composition is associative, so a text is cut into blocks, each block's
composed function is found for all blocks at once, block entry states follow, and a second sweep
marks the boundaries.  The automaton is the leftmost-first reading of the alternatives
contraction, ` ?letters`, ` ?numbers`, ` ?others`, spaces not before a non-space, spaces.

Distinct slices are merged pair by pair, lowest rank first and leftmost on ties, all slices at
once; results are cached in the worker (bounded).  Token byte offsets are kept.

Defined results: null text is empty; empty text has no tokens; repeated rows are encoded alike.
Memory per worker: the tables, the cache bound, and a few dozen bytes for each byte of a slice of
texts (2 MB, or one longer text).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import wordscan
from .frames import aside, map_batches, set_aside

# The contractions that the public pattern lists.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
#: Symbols: letter, number, other, apostrophe before a one- or two-letter ending, white space
#: before white space or the end, other white space before a non-space, a blank before one.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_SPACE, S_BLANK = range(8)
#: States: in letters, numbers, others, white space; after a blank that the next token takes in;
#: one or two characters of a contraction left; token complete.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_BLANK, ONE_LEFT, TWO_LEFT, COMPLETE = range(8)
FRESH = 8  # added to the symbol of a text's first character
CACHE_SLICES, CACHE_BYTES = 300_000, 32 << 20
VECTOR_BYTES = 192  # longer slices are merged one by one with a heap


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a token begin here) for one character."""
    if symbol >= FRESH:
        state, symbol = COMPLETE, symbol - FRESH
    if state in (ONE_LEFT, TWO_LEFT):
        return (COMPLETE if state == ONE_LEFT else ONE_LEFT), False
    if symbol == S_LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return {S_OTHER: IN_OTHERS, S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}[symbol], True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_BLANK if symbol == S_BLANK else COMPLETE), True


class _Scan:
    """Transition tables: by state, and by element of the monoid of state functions."""

    def __init__(self):
        steps = [[_step(q, s) for s in range(16)] for q in range(8)]
        self.next = np.array([[x[0] for x in row] for row in steps], np.uint8).ravel()
        self.begins = np.array([[x[1] for x in row] for row in steps], bool).ravel()
        symbol = [tuple(steps[q][s][0] for q in range(8)) for s in range(16)]
        elements = {tuple(range(8)): 0}
        todo = [tuple(range(8))]
        table: list[list[int]] = []
        while todo:
            f = todo.pop(0)
            row = []
            for g in symbol:
                h = tuple(g[f[q]] for q in range(8))
                if h not in elements:
                    elements[h] = len(elements)
                    todo.append(h)
                row.append(elements[h])
            table.append(row)
        self.functions = list(elements)
        self.compose = np.array(table, np.uint16).ravel()

    def boundaries(self, symbols: np.ndarray, block: int = 256) -> np.ndarray:
        """Where tokens begin.  ``symbols``: whole texts, first characters marked as fresh."""
        n = len(symbols)
        if not n:
            return np.zeros(0, bool)
        blocks = -(-n // block)
        if blocks * block > n:
            symbols = np.concatenate((symbols, np.full(blocks * block - n, FRESH + S_SPACE, np.uint8)))
        across = np.ascontiguousarray(symbols.reshape(blocks, block).T)
        whole = np.zeros(blocks, np.uint16)
        for row in across:
            whole = self.compose[(whole << 4) | row]
        entry, state = np.empty(blocks, np.uint8), COMPLETE
        for b, f in enumerate(whole.tolist()):
            entry[b] = state
            state = self.functions[f][state]
        marks = np.empty(across.shape, bool)
        for i, row in enumerate(across):
            at = (entry << 4) | row
            marks[i] = self.begins[at]
            entry = self.next[at]
        return marks.T.reshape(-1)[:n]


@functools.cache
def _scan_tables() -> _Scan:
    return _Scan()


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or 0x323B0 <= c < 0xE0000 or c >= 0xF0000:
            continue  # surrogates, unassigned planes, private use: none is a letter or number
        kinds[c] = first.get(unicodedata.category(chr(c))[0], OTHER)
    kinds[WHITE_SPACE] = SPACE
    kinds[0x20] = BLANK
    return kinds


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the slices of the given texts begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    ascii_only = not (data & 0x80).any()
    if ascii_only:
        points, lead = data, None
        ends = offsets[1:]
        starts = offsets[:-1]
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(lead, offsets)
        starts, ends = at[:-1], at[1:]
    full = ends > starts
    starts, ends = starts[full], ends[full]
    kinds = _classes()[points]
    n = len(points)
    white = kinds >= SPACE
    before_white = np.empty(n, bool)
    before_white[:-1] = white[1:]
    before_white[ends - 1] = True
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_BLANK], np.uint8)[kinds]
    symbols[white & before_white] = S_WHITE
    marks = np.flatnonzero(points == 39)
    if len(marks):
        end = ends[np.searchsorted(ends, marks, "right")]
        follow = [np.where(marks + k < end, points[np.minimum(marks + k, n - 1)], 0) for k in (1, 2)]
        for ending in CONTRACTIONS:
            same = np.logical_and.reduce([follow[k] == ord(c) for k, c in enumerate(ending)])
            symbols[marks[same]] = S_SHORT if len(ending) == 1 else S_LONG
    symbols[starts] += FRESH
    begin = np.flatnonzero(_scan_tables().boundaries(symbols))
    return begin if lead is None else lead[begin]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + count), one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class Tokenizer:
    """Ranks and their derived tables; picklable, and so broadcast (its size is the rank file's)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 1
        by_id = [b""] * self.n
        for token, i in ranks.items():
            by_id[i] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs = np.array(keys, np.int64)[order]
        self.merged = np.array(values, np.int64)[order]
        self.none = np.int64(1) << 40
        width = len(str(self.n)) + 1
        self.decimal = np.zeros((self.n, width), np.uint8)
        for i in range(self.n):
            text = f"{i},".encode()
            self.decimal[i, : len(text)] = np.frombuffer(text, np.uint8)
        self.digits = (self.decimal != 0).sum(1)

    @classmethod
    def from_tiktoken(cls, path: str) -> Tokenizer:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.merged[at], self.none)

    def merge(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each slice."""
        out: list = [None] * len(texts)
        todo = []
        for i, text in enumerate(texts):
            known = self.ranks.get(text)
            if known is not None:
                out[i] = np.array([known], np.int32)
            elif len(text) > VECTOR_BYTES:
                out[i] = self._merge_long(text)
            else:
                todo.append(i)
        if todo:
            self._merge_many(texts, todo, out)
        return out

    def _merge_many(self, texts: list[bytes], todo: list[int], out: list) -> None:
        ids = self.byte[np.frombuffer(b"".join([texts[i] for i in todo]), np.uint8)]
        owner = np.asarray(todo)
        counts = np.array([len(texts[i]) for i in todo])
        ends = np.cumsum(counts)
        rank = np.empty(len(ids), np.int64)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[ends - 1] = self.none
        while True:
            first = ends - counts
            least = np.minimum.reduceat(rank, first)
            done = least == self.none
            if done.any():
                for o, a, b in zip(owner[done].tolist(), first[done].tolist(), ends[done].tolist()):
                    out[o] = ids[a:b].astype(np.int32)
                if done.all():
                    return
                live = np.repeat(~done, counts)
                ids, rank = ids[live], rank[live]
                owner, counts, least = owner[~done], counts[~done], least[~done]
                ends = np.cumsum(counts)
                first = ends - counts
            hits = np.flatnonzero(rank == np.repeat(least, counts))
            group = np.searchsorted(ends, hits, "right")
            at = hits[np.concatenate(([True], np.diff(group) > 0))]  # leftmost of each slice
            ids[at] = least
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            # What stands right of the merged pair, if it is in the same slice.
            more = at + 2 < ends
            rank[at] = self.none
            rank[at[more]] = self._rank(ids[at[more]], ids[at[more] + 2])
            back = at > first
            rank[at[back] - 1] = self._rank(ids[at[back] - 1], ids[at[back]])
            ids, rank = ids[stay], rank[stay]
            counts = counts - 1
            ends = np.cumsum(counts)

    def _merge_long(self, text: bytes) -> np.ndarray:
        """One long slice: a heap of pairs over a linked list."""
        ids = [int(x) for x in self.byte[np.frombuffer(text, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = dict(zip(self.pairs.tolist(), self.merged.tolist())) if not hasattr(self, "_pair") else self._pair
        self._pair = pair
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pair.get(r << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := pair.get(ids[before[i]] << 32 | r)) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        return self.flat[_ragged(self.begin[ids], self.lengths[ids])]

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """The ids as decimal text, a comma after each."""
        rows = self.decimal[ids]
        return rows[rows != 0]


class Encoder:
    """A tokenizer with a worker's cache of merged slices, bounded by their number and by their
    bytes and ids; it is emptied before a slice of texts if it is over either bound."""

    def __init__(self, tokenizer: Tokenizer, cache: int = CACHE_SLICES, cache_bytes: int = CACHE_BYTES):
        self.tokenizer, self.limit, self.limit_bytes = tokenizer, cache, cache_bytes
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.used = self.filled = self.bytes = 0
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.store = np.zeros(4096, np.int32)

    def _learn(self, texts: list[bytes]) -> None:
        for text, ids in zip(texts, self.tokenizer.merge(texts)):
            if self.used == len(self.begin):
                self.begin, self.count = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.begin, self.count))
            while self.filled + len(ids) > len(self.store):
                self.store = np.concatenate((self.store, np.zeros(len(self.store), np.int32)))
            self.begin[self.used], self.count[self.used] = self.filled, len(ids)
            self.store[self.filled : self.filled + len(ids)] = ids
            self.known[text] = self.used
            self.bytes += len(text) + 4 * len(ids)
            self.used, self.filled = self.used + 1, self.filled + len(ids)

    def _distinct(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(code of each slice, the distinct slices); exact."""
        hashes = _piece_hashes(data, begin, lengths)
        codes, unique = pd.factorize(hashes)
        first = np.empty(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = data.tobytes()
        if (lengths == lengths[first][codes]).all() and (data == data[np.arange(len(data)) - np.repeat(begin - begin[first][codes], lengths)]).all():
            return codes, [raw[a : a + n] for a, n in zip(begin[first].tolist(), lengths[first].tolist())]
        seen: dict[bytes, int] = {}  # two slices share a hash
        codes = np.array([seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(begin.tolist(), lengths.tolist())])
        return codes, list(seen)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        begin = pieces(data, offsets)
        lengths = np.diff(np.append(begin, len(data)))
        codes, distinct = self._distinct(data, begin, lengths)
        if self.used > self.limit or self.bytes > self.limit_bytes:
            self._reset()
        new = [t for t in distinct if t not in self.known]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[codes]
        counts = self.count[slots]
        ids = self.store[_ragged(self.begin[slots], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(total[np.searchsorted(begin, offsets)])


def _piece_hashes(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of slices by their exact bytes (the lengths are mixed in)."""
    out, lo = np.empty(len(begin), np.uint64), 0
    ends = begin + lengths
    while lo < len(begin):
        base = int(begin[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + wordscan.PIECE, "right")))
        part = data[base : ends[hi - 1]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_EXACT[part] * wordscan._power(wordscan._BASE, len(part)), out=sums[1:])
        s, e = begin[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * wordscan._power(wordscan._INVERSE, len(part))[s] + (e - s).astype(np.uint64)
        lo = hi
    return wordscan.mixed(out)


_EXACT = np.random.default_rng(5381).integers(1, 1 << 63, 256, dtype=np.uint64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


#: What ``encode`` can add.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "token_starts": T.ArrayType(T.IntegerType(), False),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, tokenizer: Tokenizer, *, text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "token_starts"), keep: list[str] | None = None) -> DataFrame:
    """Add the wanted of ``OUTPUTS`` for every text.

    ``ids`` are the token ids, ``token_starts`` the byte offset of each token in the UTF-8 text;
    ``ids_sha256`` digests the decimal ids joined by commas and ``decoded_sha256`` the bytes that
    decoding those ids gives back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    docs, keep = aside(docs, [o for o in outputs if o != text_col], keep)

    def make():
        encoder = Encoder(shared.value)
        tok = encoder.tokenizer

        def work(batch: pa.RecordBatch):
            data, offsets = wordscan.text_buffers(batch.column(text_col))
            for lo, hi in wordscan.slices(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids, counts = encoder.encode(part, own)
                new: dict[str, pa.Array] = {"n_tokens": pa.array(counts, pa.int64())}
                if "ids" in outputs:
                    new["ids"] = _lists(ids, counts, pa.int32())
                ends = np.concatenate(([0], np.cumsum(counts)))
                if "token_starts" in outputs:
                    lengths = tok.lengths[ids]
                    starts = np.cumsum(lengths) - lengths - np.repeat(own[:-1], counts)
                    new["token_starts"] = _lists(starts.astype(np.int32), counts, pa.int32())
                if "ids_sha256" in outputs:
                    text = memoryview(tok.decimals(ids))
                    to = np.concatenate(([0], np.cumsum(tok.digits[ids])))[ends].tolist()
                    new["ids_sha256"] = pa.array([hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(to, to[1:])])
                if "decoded_sha256" in outputs:
                    back = memoryview(tok.decode(ids))
                    to = np.concatenate(([0], np.cumsum(tok.lengths[ids])))[ends].tolist()
                    new["decoded_sha256"] = pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(to, to[1:])])
                yield lo, hi, new

        return work

    return map_batches(docs, [(o, OUTPUTS[o]) for o in outputs], make, keep)


def decode(frame: DataFrame, tokenizer: Tokenizer, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes of each row's ids; null ids give empty bytes, an id out of range an error."""
    shared = frame.sparkSession.sparkContext.broadcast(tokenizer)
    frame = set_aside(frame, [bytes_col])

    def make():
        tok: Tokenizer = shared.value

        def work(batch: pa.RecordBatch):
            rows = [b"" if x is None else tok.decode(np.asarray(x, np.int64)).tobytes() for x in batch.column(ids_col).to_pylist()]
            yield 0, batch.num_rows, {bytes_col: pa.array(rows, pa.binary())}

        return work

    return map_batches(frame, [(bytes_col, T.BinaryType())], make)
