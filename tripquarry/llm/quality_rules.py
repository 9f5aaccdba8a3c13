"""Operator 8: quality rules by weak supervision, in DataFrame functions only.

Every rule reads a few per-document statistics and votes good (1), bad (-1) or abstains (0).
The votes of all documents are counted by pattern (3 ** rules patterns at most, so the table that
reaches the driver has a fixed bound), expectation-maximisation over those counts estimates each
rule's accuracy and the share of good documents, and the posterior probability that a document is
good is a closed column expression of its votes.

Repeated three-word windows are found inside the row: window hashes, with the window's number in
the low bits, are sorted as plain longs, equal neighbours are verified word for word, and the
covered words counted from the sorted starts.  A text in which two different windows share a hash,
or with more windows than the low bits number, has its windows sorted by their words instead.  No
explode and no shuffle.

Defined results: null and empty texts have no words, fail the base rules and get posterior from
the prior and the votes like any other; repeated rows are judged alike; with no documents the
prior parameters stand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed, set_aside

# Fixed values of the contract: the white space between words, and the symbols.
BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_repeat_words"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INDEX_BITS = 22  # of the packed sort, for the window's number; the others hold its hash


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars`` (code points in words), ``n_symbols, n_upper`` (A to Z),
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words`` (words in three-word windows
    that occur twice or more in the text), all long."""
    docs = set_aside(docs, [c for c in [*STATS, "_words", "_lines", "_keys", "_wide", "_starts", "_mixed"] if c != text_col])
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = (1 << _INDEX_BITS) - 1
    step1 = docs.select(
        *names,
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_lines"),
    )
    w = F.col("_words")
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    numbers = F.sequence(F.lit(0), F.size(w) - 3)
    fits = F.size(w) <= mask
    step2 = step1.select(
        *names,
        "_words",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when((F.size(w) >= 3) & fits, F.sort_array(F.transform(numbers, lambda i: F.shiftleft(F.shiftright(window(i), _INDEX_BITS), _INDEX_BITS).bitwiseOR(i.cast("long"))))).alias("_keys"),
    )
    k, wide = F.col("_keys"), F.col("_wide")
    high = lambda x: F.shiftright(x, _INDEX_BITS)
    low = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

    def equal(i: Column, j: Column) -> Column:
        """Windows i and j hold the same words."""
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def near(x: Column, y: Column) -> Column:
        return F.coalesce((high(x) == high(y)) & equal(low(x), low(y)), F.lit(False))

    def near_wide(x: Column, y: Column) -> Column:
        return F.coalesce(x["s"] == y["s"], F.lit(False))

    # Different windows of one hash: those between two equal ones would part them.
    mixed = F.size(F.filter(k, lambda x, j: F.coalesce((high(x) == high(F.get(k, j + 1))) & ~equal(low(x), low(F.get(k, j + 1))), F.lit(False)))) > 0
    step2 = step2.select(*names, "_words", *STATS[:5], "_keys", (F.col("_keys").isNull() | mixed).alias("_mixed"))
    spelled = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    step2 = step2.select(*names, "_words", *STATS[:5], "_keys", F.when((F.size(w) >= 3) & F.col("_mixed"), F.sort_array(F.transform(numbers, lambda i: F.struct(spelled(i).alias("s"), i.alias("i"))))).alias("_wide"))

    before = lambda j: F.when(j > 0, j - 1).otherwise(F.lit(-1))
    step3 = step2.select(
        *names,
        *STATS[:5],
        F.sort_array(
            F.when(wide.isNotNull(), F.transform(F.filter(wide, lambda x, j: near_wide(x, F.get(wide, before(j))) | near_wide(x, F.get(wide, j + 1))), lambda x: x["i"])).otherwise(
                F.transform(F.filter(k, lambda x, j: near(x, F.get(k, before(j))) | near(x, F.get(k, j + 1))), low)
            )
        ).alias("_starts"),
    )
    s = F.col("_starts")
    covered = F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    # Never true, and not deterministic: a filter on the statistics must not be pushed below the
    # projections, where every use of the word array would split the text again.
    barrier = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    return step3.select(*names, *STATS[:5], (F.coalesce(covered, F.lit(0)) + barrier).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """The contract's base rule."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes bad if ``bad`` holds, else good if ``good`` does, else abstains (nulls count as not
    holding)."""

    name: str
    bad: Column
    good: Column | None = None

    def vote(self) -> Column:
        vote = F.when(self.bad, -1)
        return (vote if self.good is None else vote.when(self.good, 1)).otherwise(0)


def default_rules() -> list[Rule]:
    """One rule for each kind of junk: most only accuse, since a text that isn't of one kind of
    junk isn't good for that; length and prose shape also vouch.  "prose" reads the same ratios as
    three others, so the posterior is surer than independent rules would make it; without it a
    single accusation couldn't outweigh the prior.  Ratios of a text without words are null, and
    abstain."""
    n, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    symbols, repeats, upper = F.col("n_symbols") / n, F.col("n_repeat_words") / n, F.col("n_upper") / chars
    size = F.col("word_chars") / n
    return [
        Rule("length", F.col("n_words") < 50, F.col("n_words") >= 100),
        Rule("word_length", (size < 2.0) | (size > 12.0)),
        Rule("symbols", symbols > 0.3),
        Rule("repeats", repeats > 0.35),
        Rule("lines", F.col("n_dup_lines") / n > 0.02),
        Rule("capitals", upper > 0.3),
        Rule("prose", (symbols > 0.2) | (upper > 0.3) | (repeats > 0.35), (symbols < 0.05) & (upper < 0.15) & (repeats < 0.25) & size.between(3.0, 9.0)),
    ]


@dataclass
class LabelModel:
    """Class share and, for each rule, P(vote | good) and P(vote | bad) over -1, 0, 1."""

    share: float
    good: list[list[float]]
    bad: list[list[float]]
    steps: int = 0
    rules: list[Rule] = field(default_factory=list)

    def posterior(self, votes: Column) -> Column:
        """P(good | votes) as a column expression of an array of votes."""
        total = F.lit(math.log(self.share) - math.log(1 - self.share))
        for m, (g, b) in enumerate(zip(self.good, self.bad)):
            vote = F.get(votes, F.lit(m))
            total = total + F.when(vote == -1, math.log(g[0] / b[0])).when(vote == 1, math.log(g[2] / b[2])).otherwise(math.log(g[1] / b[1]))
        return 1 / (1 + F.exp(-total))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, *, steps: int = 100, pseudo: float = 20.0, prior_share: float = 0.85) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    ``pseudo`` documents' worth of prior (a good document is seldom accused, a bad one by half
    the rules) keeps the labelling's direction and stands alone where there are no documents.
    """
    good0, bad0 = [0.02, 0.28, 0.70], [0.50, 0.45, 0.05]
    share, good, bad = prior_share, [good0[:] for _ in range(n_rules)], [bad0[:] for _ in range(n_rules)]
    total = sum(c for _, c in patterns)
    done = 0
    for done in range(1, steps + 1):
        g_sum, mass = 0.0, [[[pseudo * p for p in good0] for _ in range(n_rules)], [[pseudo * p for p in bad0] for _ in range(n_rules)]]
        for votes, count in patterns:
            x = math.log(share) - math.log(1 - share) + sum(math.log(good[m][v + 1] / bad[m][v + 1]) for m, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))
            g_sum += p * count
            for m, v in enumerate(votes):
                mass[0][m][v + 1] += p * count
                mass[1][m][v + 1] += (1 - p) * count
        new = min(1 - 1e-6, max(1e-6, (g_sum + pseudo * prior_share) / (total + pseudo)))
        good = [[x / sum(row) for x in row] for row in mass[0]]
        bad = [[x / sum(row) for x in row] for row in mass[1]]
        moved, share = abs(new - share), new
        if moved < 1e-9:
            break
    return LabelModel(share, good, bad, done)


def fit(stats: DataFrame, rules: list[Rule] | None = None, **options) -> LabelModel:
    """Count the vote patterns of all rows and fit the label model."""
    rules = rules or default_rules()
    counted = stats.select(F.array(*[r.vote() for r in rules]).alias("votes")).groupBy("votes").count().collect()  # 3 ** rules rows at most
    model = fit_label_model(sorted((tuple(r["votes"]), r["count"]) for r in counted), len(rules), **options)
    model.rules = rules
    return model


def judge(stats: DataFrame, model: LabelModel, *, threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed, votes, p_good, kept`` to rows with statistics."""
    names = stats.columns
    voted = stats.select(*names, base_failed().alias("base_failed"), F.array(*[r.vote() for r in model.rules]).alias("votes"))
    return voted.select(*names, "base_failed", "votes", model.posterior(F.col("votes")).alias("p_good")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality_rules(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior and verdict of every document, beside the columns of ``keep``.

    Without the text among them, the few numbers of each row are checkpointed, and texts read
    once; with it, texts are read twice: to count the votes, and to judge.
    """
    keep = [c for c in docs.columns if keep is None or c in keep]
    own = [c for c in [*STATS, "base_failed", "votes", "p_good", "kept"] if c != text_col]
    docs = set_aside(docs.select(*dict.fromkeys([*keep, text_col])), own)
    if text_col in keep:
        model = fit(with_statistics(docs.select(text_col), text_col), rules)
        return judge(with_statistics(docs, text_col), model, threshold=threshold)
    stats = checkpointed(with_statistics(docs, text_col).drop(text_col))
    return judge(stats, fit(stats, rules), threshold=threshold)


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    names = docs.columns
    judged = quality_rules(docs, **options)
    return judged.where("kept").select(*judged.columns[: len(names)]).toDF(*names)
