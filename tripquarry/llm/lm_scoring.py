"""Operator 10: LM scoring by masked pseudo-likelihood.

Every word is predicted from the words on both of its sides by a window network that is trained
here, in numpy: an embedding of the class on either side, one tanh layer, and a softmax over
classes.  The ``TOP_WORDS`` most frequent words are classes of their own; other words are classed
by their last two bytes, which tell language and word form, ``ENDINGS`` frequent endings apart.
Within a class a word's probability is its share of the class's occurrences:

    log P(word | both sides) = log P(class | both sides) + log P(word | class)

A document's ``log_prob`` is the sum over its words, its ``score`` that sum for each word.

Training uses every window of every document.  A window is three classes, so the windows of the
corpus are gathered as counts (integers, each task adds up its own, then the sums are merged), and
the network is trained on the counted windows, with any number of passes.  The result is the same
for any partitions and order of the rows, and the counts have a fixed bound whatever the corpus.

Word counts are gathered from all documents by a shuffle that is combined in the workers and
map-side first.  A word's own count is kept for the most frequent words, as many whole steps of
frequency as fit ``OWN_WORDS`` words, which is the bound of the broadcast; rarer words of a class
share what is left of its occurrences evenly.

Defined results: null and empty texts have no words, log probability 0 and neither score nor
perplexity; the place beyond an end of a text is a class of its own; repeated rows score alike; a
word that the corpus doesn't hold counts as one of its class's rare words; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parts, wordscan
from .frames import aside, bound_batches, checkpointed, map_batches, released

TOP_WORDS, ENDINGS = 128, 64
OWN_WORDS = 1 << 21  # 13 bytes each
WIDTH, EPOCHS, RATE = 32, 30, 0.02
MINIBATCH = 4096  # contexts
FREQUENCY_STEPS = 8  # to a factor of two
_PENDING = 400_000
_U = np.uint64


def endings(words: wordscan.Words) -> np.ndarray:
    """The last two bytes of each word, lower-cased, as one number."""
    last = wordscan.LOWER_BYTES[words.data[words.ends - 1]].astype(np.int64)
    before = words.data[np.maximum(words.ends - 2, 0)]
    return last << 8 | np.where(words.ends - words.starts > 1, wordscan.LOWER_BYTES[before], 0)


def _summed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, e, c = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(h)
    h, e, c = h[order], e[order], c[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], e[at], np.add.reduceat(c, at) if len(at) else c


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, ending, n) of every word of all documents."""
    bound_batches(docs.sparkSession)

    def run(batches):
        found, pending = [], 0

        def out():
            h, e, c = _summed(found)
            for lo in range(0, len(h), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(e[part].astype(np.int32)), pa.array(c[part])], names=["hash", "ending", "n"])

        for batch in batches:
            for _, _, words in wordscan.scan(batch.column(0)):
                found.append(_summed([(words.hashes, endings(words), np.ones(len(words.starts), np.int64))]))
                pending += len(found[-1][0])
                if pending > _PENDING:
                    found = [_summed(found)]
                    pending = len(found[0][0])
                    if pending > _PENDING // 2:
                        yield from out()
                        found, pending = [], 0
        if found:
            yield from out()

    return docs.select(text_col).mapInArrow(run, "hash long, ending int, n long").groupBy("hash").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


class Lexicon:
    """The class of a word, and its log probability within the class."""

    def __init__(self, own: tuple[np.ndarray, np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray, np.ndarray], top_words: int = TOP_WORDS, n_endings: int = ENDINGS):
        """``own``: hashes, endings and counts of words by themselves; ``rest``: endings,
        occurrences and words of the others."""
        h, ending, n = own
        order = np.lexsort((h, -n))
        top, tail = order[:top_words], order[top_words:]
        mass = np.bincount(ending[tail], n[tail], 1 << 16) + np.bincount(rest[0], rest[1], 1 << 16)
        # The last class is of all other endings.
        frequent = np.argsort(-mass, kind="stable")[: n_endings - 1]
        frequent = frequent[mass[frequent] > 0]
        self.size = len(top) + len(frequent) + 1
        self.by_ending = np.full(1 << 16, self.size - 1, np.int16)
        self.by_ending[frequent] = len(top) + np.arange(len(frequent))
        classes = self.by_ending[ending]
        classes[top] = np.arange(len(top))
        in_rest = self.by_ending[rest[0]]
        left, words = np.bincount(in_rest, rest[1], self.size), np.bincount(in_rest, rest[2], self.size)
        self.totals = np.bincount(classes, n, self.size) + left
        total = np.maximum(self.totals, 1.0)
        # A class without rare words: an unseen one counts as half a word.
        self.rare = np.log(np.where(words > 0, left / np.maximum(words, 1), 0.5) / total).astype(np.float32)
        by_hash = np.argsort(h)
        self.hashes, self.classes_of = h[by_hash], classes[by_hash]
        self.within = np.log(n / total[classes]).astype(np.float32)[by_hash]

    def classes(self, words: wordscan.Words) -> tuple[np.ndarray, np.ndarray]:
        """(class, log P(word | class)) of each word."""
        h, back = np.unique(words.hashes, return_inverse=True)
        ending = np.zeros(len(h), np.int64)
        ending[back] = endings(words)
        out = self.by_ending[ending]
        log_p = self.rare[out]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            out[known], log_p[known] = self.classes_of[at[known]], self.within[at[known]]
        return out[back], log_p[back]


def _step(n: Column) -> Column:
    """The step of frequency of a count."""
    return F.floor(F.log2(n.cast("double")) * FREQUENCY_STEPS).cast("int")


def gather_lexicon(docs: DataFrame, text_col: str = "text", own_words: int = OWN_WORDS) -> Lexicon:
    counts = checkpointed(word_counts(docs, text_col))
    steps = {r["step"]: r["words"] for r in counts.groupBy(_step(F.col("n")).alias("step")).agg(F.count("*").alias("words")).collect()}  # 63 * FREQUENCY_STEPS rows at most
    least, kept = max(steps, default=0) + 1, 0
    for step in sorted(steps, reverse=True):
        if (kept := kept + steps[step]) > own_words:
            break
        least = step

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy().tobytes()], pa.binary()) for i in range(3)], names=["h", "e", "n"])

    kinds = (np.uint64, np.int32, np.int64)
    own: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for r in counts.where(_step(F.col("n")) >= least).select("hash", "ending", "n").mapInArrow(packed, "h binary, e binary, n binary").toLocalIterator():
        for column, raw, kind in zip(own, r, kinds):
            column.append(np.frombuffer(bytes(raw), kind))
    rest = counts.where(_step(F.col("n")) < least).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).orderBy("ending").collect()  # 2 ** 16 rows at most
    return Lexicon(tuple(np.concatenate(x) for x in own), tuple(np.array([r[i] for r in rest], np.int64) for i in range(3)))


def _contexts(words: wordscan.Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, context, log P(word | class)) of each word; the context is left * (classes + 1) +
    right, and beyond the ends of a text stands one more class."""
    classes, log_p = lexicon.classes(words)
    k, x = lexicon.size, classes.astype(np.int64)
    left, right = np.full(len(x), k), np.full(len(x), k)
    if len(x):
        same = words.texts[1:] == words.texts[:-1]
        left[1:][same], right[:-1][same] = x[:-1][same], x[1:][same]
    return x, left * (k + 1) + right, log_p


def window_counts(docs: DataFrame, lexicon, size: int, text_col: str = "text") -> np.ndarray:
    """(contexts, classes): how often each class stands in each context, over all windows of all
    documents.  ``lexicon`` is broadcast."""
    bound_batches(docs.sparkSession)
    length = (size + 1) ** 2 * size

    def run(batches):
        own: Lexicon = lexicon.value
        table, held = np.zeros(parts.padded(length), np.int32), 0
        for batch in batches:
            for _, _, words in wordscan.scan(batch.column(0)):
                x, context, _ = _contexts(words, own)
                np.add.at(table, context * size + x, 1)
                held += len(x)
                if held > 1 << 30:  # before a counter can overflow
                    yield from parts.emitted(table)
                    table[:], held = 0, 0
        yield from parts.emitted(table)

    return parts.merged(docs.select(text_col).mapInArrow(run, parts.SCHEMA), length).reshape(-1, size)


class WindowNetwork:
    """An embedding of the class on each side, one hidden layer, softmax over classes."""

    def __init__(self, classes: int, width: int = WIDTH):
        draw = np.random.default_rng(11)
        random = lambda *shape: (draw.standard_normal(shape) * 0.2).astype(np.float32)
        self.left, self.right, self.hidden = random(classes + 1, width), random(classes + 1, width), np.zeros(width, np.float32)
        self.out, self.bias = random(width, classes), np.zeros(classes, np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.left, self.right, self.hidden, self.out, self.bias]

    def _forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, log probabilities of the classes) in each context."""
        x = np.tanh(self.left[left] + self.right[right] + self.hidden)
        z = x @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return x, z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, counts: np.ndarray, epochs: int = EPOCHS) -> WindowNetwork:
        """Adam on the cross-entropy of counted windows, in minibatches of contexts; the bias
        starts at the classes' own frequencies."""
        total = counts.sum(1)
        used = np.flatnonzero(total)
        if not len(used):
            return self
        share = np.maximum(counts.sum(0), 0.5)
        self.bias[:] = np.log(share / share.sum())
        side = len(self.left)
        means, squares = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        draw, done = np.random.default_rng(5), 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for at in np.array_split(draw.permutation(used), -(-len(used) // MINIBATCH)):
                left, right, n = at // side, at % side, total[at].astype(np.float32)
                x, log_p = self._forward(left, right)
                z = (np.exp(log_p) * n[:, None] - counts[at]) / n.sum()
                z = z.astype(np.float32)
                back = (z @ self.out.T) * (1 - x * x)
                grads = [np.zeros_like(self.left), np.zeros_like(self.right), back.sum(0), x.T @ z, z.sum(0)]
                np.add.at(grads[0], left, back)
                np.add.at(grads[1], right, back)
                done += 1
                for w, g, m, s in zip(self.weights, grads, means, squares):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= rate * (m / (1 - 0.9**done)) / (np.sqrt(s / (1 - 0.99**done)) + 1e-8)
        return self

    def table(self) -> np.ndarray:
        """log P(class | context) of every context: (classes + 1) ** 2 rows.

        A worker keeps the table of the network it used last.
        """
        key = hashlib.blake2b(b"".join(w.tobytes() for w in self.weights)).digest()
        if key not in _tables:
            _tables.clear()
            side = len(self.left)
            out = np.empty((side * side, side - 1), np.float32)
            for lo in range(0, len(out), MINIBATCH):
                at = np.arange(lo, min(len(out), lo + MINIBATCH))
                out[at] = self._forward(at // side, at % side)[1]
            _tables[key] = out
        return _tables[key]


_tables: dict[bytes, np.ndarray] = {}


def train_network(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", epochs: int = EPOCHS) -> WindowNetwork:
    """Train on every window of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    counts = window_counts(docs, shared, lexicon.size, text_col)
    released(shared)
    return WindowNetwork(lexicon.size).train(counts, epochs)


def score_lm(docs: DataFrame, lexicon: Lexicon, network: WindowNetwork, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (mean log probability of a word, given both sides), ``log_prob`` (the sum),
    ``n_words`` and ``perplexity``."""
    spark = docs.sparkSession
    docs, keep = aside(docs, [c for c in ("score", "log_prob", "n_words", "perplexity") if c != text_col], keep)
    lex, net = spark.sparkContext.broadcast(lexicon), spark.sparkContext.broadcast(network)

    def make():
        lexicon, table = lex.value, net.value.table()

        def work(batch: pa.RecordBatch):
            for lo, hi, words in wordscan.scan(batch.column(text_col)):
                x, context, log_p = _contexts(words, lexicon)
                sums = np.concatenate(([0.0], np.cumsum(table[context, x].astype(np.float64) + log_p)))[words.of_text]
                total, n = np.diff(sums), words.counts.astype(np.int64)
                mean = total / np.maximum(n, 1)
                yield lo, hi, {"score": pa.array(mean, mask=n == 0), "log_prob": pa.array(total), "n_words": pa.array(n)}

        return work

    out = map_batches(docs, [("score", T.DoubleType()), ("log_prob", T.DoubleType()), ("n_words", T.LongType())], make, keep)
    return out.withColumn("perplexity", F.exp(-F.col("score")))


def lm_scores(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Gather, train and score on the same documents."""
    lexicon = gather_lexicon(docs, text_col)
    return score_lm(docs, lexicon, train_network(docs, lexicon, text_col), text_col=text_col, keep=keep)
