"""Quality by weak supervision: rules vote or abstain, and EM tells how far to believe each.

Rules look at word and line statistics of a text. Most vote bad on one kind of junk and abstain
otherwise; one votes good on prose. Expectation-maximisation over the vote patterns estimates,
without labels, how often each rule votes good, bad or not at all on good and on bad documents, and
the share of good documents. A document is kept if the posterior probability of being good is at
least ``KEEP``. A rule that abstains on clean text leaves one clear sign of junk its weight, where
seven rules that vote good on everything else would drown it.

All documents count: they are grouped by vote pattern (at most 3 to the number of rules rows), and
each iteration is one aggregate over that table. Everything is Spark expressions.

Defined results: a null text has no words, fails the base test and is not kept; repeated rows
count each; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.rows import hold
from paperloom.llm.native import SPACE, run_hashes, word_hashes, word_list
from paperloom.llm.tables import stored

SYMBOLS = "#*$%&|<>"
KEEP = 0.5
ROUNDS = 25
# Where the estimates start: (good, bad) vote rates on good and on bad documents for a rule that looks
# for junk and for the one that looks for prose, the share of good documents, and the number of pseudo
# documents that stand for them in each step.
JUNK_START = ((0.001, 0.02), (0.001, 0.3))
PROSE_START = ((0.9, 0.001), (0.3, 0.001))
GOOD_SHARE, PSEUDO = 0.8, 5.0


def _share(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


def _bad(condition: Column) -> Column:
    return F.when(condition, False)


RULES = {
    "symbols": lambda: _bad(_share("n_symbols", "n_words") > 0.15),
    "repeats": lambda: _bad(_share("n_repeat_words", "n_words") > 0.3),
    "lines": lambda: _bad((F.col("n_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.3)),
    "word_length": lambda: _bad(~_share("word_chars", "n_words").between(2.5, 12)),
    "vocabulary": lambda: _bad((F.col("n_words") >= 20) & (_share("n_distinct", "n_words") < 0.1)),
    "stops": lambda: _bad(_share("n_stops", "n_words") > 0.5),
    "line_words": lambda: _bad(_share("n_words", "n_lines") < 1.5),
    "prose": lambda: F.when(
        (F.col("n_words") >= 50)
        & (_share("n_stops", "n_words") < 0.4)
        & (_share("n_symbols", "n_words") < 0.1)
        & (_share("n_repeat_words", "n_words") < 0.3),
        True,
    ),
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the counts the rules and the base test need, of every whole text."""
    text = F.coalesce("text", F.lit(""))
    base = hold(docs.select("doc_id", text.alias("text")), words=word_list("text"), lines=F.split("text", "\n"))
    lines = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = hold(
        base,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.regexp_replace("text", SPACE, "")).cast("long"),
        n_symbols=(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        n_stops=(F.length("text") - F.length(F.translate("text", ".!?", ""))).cast("long"),
        full=lines,
        h=word_hashes("words"),
    ).drop("text", "words", "lines")
    runs = hold(
        counted,
        n_lines=F.size("full").cast("long"),
        n_dup_lines=(F.size("full") - F.size(F.array_distinct("full"))).cast("long"),
        n_distinct=F.size(F.array_distinct("h")).cast("long"),
        runs=run_hashes(3),
    ).drop("full", "h")
    # equal runs are neighbours once sorted by (hash, place)
    pairs = F.when(
        F.size(F.array_distinct("runs")) < F.size("runs"),
        F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    ordered = hold(runs, pairs=pairs).drop("runs")
    twice = F.transform(
        "pairs",
        lambda x, k: F.when(
            (k > 0) & F.coalesce(F.get("pairs", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("pairs", k + 1)["h"] == x["h"], F.lit(False)),
            x["i"],
        ),
    )
    starts = hold(ordered, starts=F.sort_array(F.array_compact(twice))).drop("pairs")
    new = F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3))))
    return starts.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)).drop("starts")


def votes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("votes", F.array(*[rule() for rule in RULES.values()]))


class Rates(NamedTuple):
    """Share of good documents, and for either kind the (good, bad) vote rates of each rule."""

    share: float
    good: list[tuple[float, float]]
    bad: list[tuple[float, float]]


_STARTS = [PROSE_START if name == "prose" else JUNK_START for name in RULES]
START = Rates(GOOD_SHARE, [good for good, _ in _STARTS], [bad for _, bad in _STARTS])


def _posterior(rates: Rates) -> Column:
    odds = F.lit(math.log(rates.share / (1 - rates.share)))
    for j, ((gg, gb), (bg, bb)) in enumerate(zip(rates.good, rates.bad)):
        vote = F.get("votes", F.lit(j))
        silent = math.log((1 - gg - gb) / (1 - bg - bb))
        odds = odds + F.when(vote, math.log(gg / bg)).when(~vote, math.log(gb / bb)).otherwise(silent)
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame) -> Rates:
    """The rates by expectation-maximisation over all documents' vote patterns."""
    patterns = stored(voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")), "patterns")
    n = len(RULES)
    rates = START
    for _ in range(ROUNDS):
        p = _posterior(rates)
        weighed = patterns.select("votes", (F.col("n") * p).alias("g"), (F.col("n") * (1 - p)).alias("b"))
        sums = [F.sum("g"), F.sum("b")]
        for kind in "gb":
            for j in range(n):
                vote = F.get("votes", F.lit(j))
                sums += [F.sum(F.when(vote, F.col(kind))), F.sum(F.when(~vote, F.col(kind)))]
        g, b, *votes = (float(x or 0) for x in weighed.agg(*sums).first())

        def rate(counts: list[float], total: float, start: list[tuple[float, float]]) -> list[tuple[float, float]]:
            pairs = zip(counts[::2], counts[1::2], start)
            return [tuple((x + PSEUDO * s) / (total + PSEUDO) for x, s in zip(pair, begin)) for *pair, begin in pairs]

        share = (g + PSEUDO * GOOD_SHARE) / (g + b + PSEUDO)
        rates = Rates(share, rate(votes[: 2 * n], g, START.good), rate(votes[2 * n :], b, START.bad))
    return rates


def judged(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, base_failed, kept and posterior."""
    voted = stored(votes(statistics(docs)), "votes")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.select("*", failed.alias("base_failed"), _posterior(fit(voted)).alias("posterior"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= KEEP)).alias("kept"), "posterior",
    )
