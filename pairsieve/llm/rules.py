"""Quality rules as weak supervision: rules vote or abstain, and how far to trust each is estimated from the votes alone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.session import discard, materialise

from .rows import keyed_text

BLANKS = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Letters and at most one mark of ordinary punctuation; lines that end like a sentence.
WORD_LIKE = r"^\p{L}+[.,;:?]?$"
LINE_END = r"[.!?:;…\"')»”][\x20\x09-\x0D]*$"


@dataclass(frozen=True)
class Rule:
    """Votes for (``good``) or against (``bad``) a text; SQL conditions over the counts of ``features``. Neither: abstains."""

    name: str
    good: str
    bad: str


#: Shares of words, letters or lines; written without division, so that a text without any abstains.
RULES = (
    Rule("symbols", "50 * n_symbols < n_words", "10 * n_symbols > n_words"),
    Rule("marks", "20 * n_marks < n_words", "5 * n_marks > n_words"),
    Rule("capitals", "10 * n_upper < n_letters", "10 * n_upper > 3 * n_letters"),
    Rule("repetition", "10 * n_repeat_words < n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("word_length", "word_chars > 3 * n_words and word_chars < 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("word_like", "10 * n_word_like > 8 * n_words", "10 * n_word_like < 6 * n_words"),
    Rule("equal_lines", "n_lines > 1 and 10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("line_ends", "2 * n_ended_lines > n_lines", "n_lines > 3 and 10 * n_ended_lines < n_lines"),
)


def features(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts over every whole text, in one scan of DataFrame functions. NULL text has no words, every count is 0.

    ``n_words`` (runs of anything but space and the control characters 9 to 13), ``word_chars`` (code points in words),
    ``n_symbols`` (any of ``#*$%&|<>``), ``n_lines`` (with a word), ``n_dup_lines`` (equal to an earlier one),
    ``n_repeat_words`` (inside 3-word windows found twice or more), ``n_word_like``, ``n_ended_lines`` (ending in
    punctuation), ``n_marks`` (``!`` and ``?``), ``n_letters``, ``n_upper``.
    """
    plain = F.col("text")
    counts = keyed_text(df, key, text).select(
        "doc_id",
        F.array_remove(F.split(plain, BLANKS), "").alias("words"),
        F.filter(F.split(plain, "\n"), lambda line: line.rlike(A_WORD)).alias("lines"),
        _count_of(plain, r"\x20\x09-\x0D", inverse=True).alias("word_chars"),
        _count_of(plain, SYMBOLS).alias("n_symbols"),
        _count_of(plain, "!?").alias("n_marks"),
        _count_of(plain, r"\p{L}").alias("n_letters"),
        _count_of(plain, r"\p{Lu}").alias("n_upper"),
    )
    # 3-word windows by hash, with their places: sorted, equal windows become neighbours.
    windows = F.transform(
        "words", lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("hash"), i.alias("place"))
    )
    windows = F.when(F.size("words") > 2, F.sort_array(F.slice(windows, 1, F.size("words") - 2)))
    counts = counts.withColumn("windows", windows)
    hash_at = lambda i: F.get("windows", i)["hash"]
    repeated = F.filter(
        "windows", lambda w, i: hash_at(i + 1).eqNullSafe(w["hash"]) | ((i > 0) & hash_at(F.greatest(i - 1, F.lit(0))).eqNullSafe(w["hash"]))
    )
    # In order of place each repeated window covers three words, less those that the one before it covers too.
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda w: w["place"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda held, at: F.struct(at.alias("last"), (held["n"] + F.least(F.lit(3), at - held["last"])).alias("n")),
        lambda held: held["n"],
    )
    size = lambda array: F.size(array).cast("long")
    return counts.select(
        "doc_id",
        size("words").alias("n_words"),
        "word_chars",
        "n_symbols",
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        size("lines").alias("n_lines"),
        size(F.filter("words", lambda w: w.rlike(WORD_LIKE))).alias("n_word_like"),
        size(F.filter("lines", lambda line: line.rlike(LINE_END))).alias("n_ended_lines"),
        "n_marks",
        "n_letters",
        "n_upper",
    )


def _count_of(text: Column, members: str, inverse: bool = False) -> Column:
    """How many characters are (``inverse``: are not) members of a class of a regular expression."""
    others = f"[{members}]+" if inverse else f"[^{members}]+"
    return F.length(F.regexp_replace(text, others, "")).cast("long")


# --- Which votes to trust ----------------------------------------------------------------------------------------------

#: Believed before any vote is seen, each with the weight of TIMES texts: how many texts are good, how often a vote on a good
#: text is right, and on a bad one (which few rules notice, as texts are bad in different ways).
GOOD, ON_GOOD, ON_BAD, TIMES = 0.8, 0.95, 0.3, 20.0


@dataclass
class VoteModel:
    """How often texts are good, and by rule how often a vote on a good (bad) text is right."""

    good: float
    on_good: list[float]
    on_bad: list[float]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        """Logarithm of the odds that a text with these votes (1, -1, or 0 for none) is good."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for vote, a, b in zip(votes, self.on_good, self.on_bad):
            weight = F.when(vote == 1, math.log(a / (1 - b))).when(vote == -1, math.log((1 - a) / b)).otherwise(0.0)
            total = total + weight
        return total

    def probability(self, votes: Sequence[Column]) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds(votes)))


#: Texts vote in at most three to this power different ways.
MOST_RULES = 9


def fit_votes(votes: DataFrame, names: Sequence[str], rounds: int) -> VoteModel:
    """Expectation-maximisation over ``votes``: a column per rule, and ``n``, the number of texts that have these votes.

    The different votes (at most 3^9 rows) are one array, over which one expression runs all rounds: the probability of each
    by the last model, and from it the expected share of right votes of each rule. The driver gets two numbers per rule.
    Rounds start from the beliefs above, which stay in the counts as votes seen before; so no rule can turn into its opposite on few votes.
    """
    if len(names) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules are supported")
    rules = range(len(names))
    rows = votes.agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), F.array(*names).alias("v"))).alias("rows"))

    def total(weighted, weight, wanted):
        return F.aggregate(weighted, F.lit(0.0), lambda held, x: held + F.when(wanted(x), weight(x)).otherwise(0.0))

    def share(weighted, weight, i, right, belief):
        hits = total(weighted, weight, lambda x: x["v"][i] == right) + belief * TIMES
        return hits / (total(weighted, weight, lambda x: x["v"][i] != 0) + TIMES)

    def expected(model):
        def odds(x):
            terms = [F.when(x["v"][i] == 1, F.log(_at(model, "on_good", i) / (1 - _at(model, "on_bad", i))))
                     .when(x["v"][i] == -1, F.log((1 - _at(model, "on_good", i)) / _at(model, "on_bad", i)))
                     .otherwise(0.0) for i in rules]
            return sum(terms, F.log(model["good"] / (1 - model["good"])))

        return F.transform(
            "rows", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (x["n"] / (1 + F.exp(-odds(x)))).alias("p"))
        )

    def improved(weighted):
        good, bad = (lambda x: x["p"]), (lambda x: x["n"] - x["p"])
        n = total(weighted, lambda x: x["n"], lambda x: F.lit(True))
        return F.struct(
            ((total(weighted, good, lambda x: F.lit(True)) + GOOD * TIMES) / (n + TIMES)).alias("good"),
            F.array(*[share(weighted, good, i, 1, ON_GOOD) for i in rules]).alias("on_good"),
            F.array(*[share(weighted, bad, i, -1, ON_BAD) for i in rules]).alias("on_bad"),
        )

    start = F.struct(
        F.lit(GOOD).alias("good"),
        F.array(*[F.lit(ON_GOOD) for _ in rules]).alias("on_good"),
        F.array(*[F.lit(ON_BAD) for _ in rules]).alias("on_bad"),
    )
    # An array of one, so that the expected counts are made once a round and looked at many times.
    step = lambda model, _: F.transform(F.array(expected(model)), improved)[0]
    found = rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).first()["m"]
    return VoteModel(found["good"], list(found["on_good"]), list(found["on_bad"]))


def _at(model: Column, name: str, i: int) -> Column:
    return model[name][i]


def judge(
    df: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = 50,
    max_repeated: int = 50,
    rounds: int = 20,
    least: float = 0.5,
) -> DataFrame:
    """One row per row of ``df``: the counts of ``features``, ``base_failed``, ``quality`` and ``kept``.

    Weak supervision, in DataFrame functions only. Every rule votes for a text, against it, or abstains. Texts with equal
    votes are counted together (at most three to the power of the number of rules rows, whatever the data), and
    expectation-maximisation finds from these counts alone, without labels, how often each rule is right. ``quality`` is the
    probability that the text is good given its votes; a text is kept from ``least`` on, so one odd vote does not drop it
    where the others that are known to be right speak for it. Texts under ``min_words`` words, or with more than
    ``max_repeated`` percent of their words in repeated 3-word windows, fail whatever the votes (``base_failed``).

    Texts are read once: the counts go to a table in the shared folder. NULL text counts as empty: it has no words, every
    rule abstains, and it fails. Ties (a probability of exactly ``least``) are kept. Repeated rows and NULL keys are judged
    one by one, an empty table gives an empty result, other columns are not read.
    """
    counts = materialise(features(df, key=key, text=text), "features")
    names = [f"vote_{i}" for i in range(len(rules))]
    voted = counts.withColumns(
        {n: F.when(F.expr(r.good), 1).when(F.expr(r.bad), -1).otherwise(0) for n, r in zip(names, rules)}
    )
    patterns = materialise(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "votes")
    model = fit_votes(patterns, names, rounds)
    discard(patterns)
    quality = model.probability([F.col(n) for n in names])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    judged = voted.withColumns({"quality": quality, "base_failed": failed})
    return judged.select(*counts.columns, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"))

