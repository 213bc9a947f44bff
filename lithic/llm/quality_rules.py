"""Operator 9: quality rules as weak supervision.

Each rule votes good or bad on a document or abstains; every fault has two rules or more. Documents share few vote patterns (three
outcomes a rule, so at most 3^rules of them), which are counted over all documents; expectation-maximisation on those counts estimates the
share of good documents and each rule's accuracy among good and among bad ones, without labels and without bounds: a Beta prior of ten
votes is all that is given, and the first guess is the share of good votes in the pattern, which also fixes which class is which. A
document is kept where its posterior probability of being good reaches the threshold. No rule alone drops a document, and none has to
pass. Only the base test, which the contract fixes, drops by itself.

Cases: a null or empty text has no word and fails the base test; repeated rows get the same verdict each; a posterior equal to the
threshold keeps; an empty table gives no row; other columns pass through `judge`, those with the name of a result as `<name>_input`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, cut
from .text_stats import counts

THRESHOLD = 0.5
ROUNDS, CLOSE = 500, 1e-9
#: Votes that are added to a rule's, right and wrong: its accuracy is held to be 0.8 before any vote is seen.
PRIOR = (8.0, 2.0)
MADE = ("_counts", "_votes", "posterior", "base_failed", "kept")


def rules(s: Column) -> dict[str, tuple[Column, Column]]:
    """(says good, says bad) by rule, over the struct of counts; neither: it abstains."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    letters = F.greatest(s["n_upper"] + s["n_lower"], F.lit(1)).cast("double")
    lines = F.greatest(s["n_lines"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    enough, several = s["n_words"] >= 20, s["n_lines"] >= 3

    def ratio(value: Column, good: float, bad: float, when: Column = F.lit(True)) -> tuple[Column, Column]:
        return when & (value < good), when & (value > bad)

    mean, distinct, stops, ended = chars / words, s["n_distinct_words"] / words, s["n_stops"] / words, s["n_ended_lines"] / lines
    return {
        # Marks instead of prose.
        "symbols": ratio(s["n_symbols"] / words, 0.02, 0.10),
        "marks": ratio(s["n_marks"] / chars, 0.08, 0.10, enough),
        "bars": ratio(s["n_bars"] / words, 0.01, 0.08),
        # Shouting.
        "capitals": ratio(s["n_upper"] / letters, 0.10, 0.50, enough),
        "exclaims": ratio(s["n_exclaims"] / words, 0.05, 0.25, enough),
        # Repetition.
        "repeats": ratio(s["n_repeat_words"] / words, 0.05, 0.28, enough),
        "vocabulary": (enough & (distinct > 0.45), enough & (distinct < 0.25)),
        "same_lines": (several & (s["n_dup_lines"] / lines < 0.10), (s["n_dup_lines"] >= 2) & (s["n_dup_lines"] / lines > 0.30)),
        # Not sentences.
        "word_length": (enough & (mean >= 4.2) & (mean <= 6.0), enough & ((mean < 3.6) | (mean > 6.8))),
        "line_ends": (several & (ended > 0.60), several & (ended < 0.10)),
        "stops": (enough & (stops > 0.03) & (stops < 0.25), enough & (stops < 0.005)),
    }


def pattern(s: Column) -> Column:
    """The votes as one text: + good, - bad, 0 abstains."""
    return F.concat(*[F.when(bad, "-").when(good, "+").otherwise("0") for good, bad in rules(s).values()])


def posteriors(patterns: dict[str, int], rounds: int = ROUNDS, prior: tuple[float, float] = PRIOR) -> dict[str, float]:
    """Probability of good for each vote pattern, by expectation-maximisation over all documents' patterns.

    The model: a document is good with some chance, and a rule that votes is right with a chance of its own among good documents and
    another among bad ones; whether it abstains says nothing."""
    if not patterns:
        return {}
    n_rules, total, (right, wrong) = len(next(iter(patterns))), sum(patterns.values()), prior
    good = {v: (v.count("+") + 1) / (v.count("+") + v.count("-") + 2) for v in patterns}
    for _ in range(rounds):
        share = (sum(n * good[v] for v, n in patterns.items()) + 1) / (total + 2)
        logs = []
        for r in range(n_rules):
            seen = {(c, k): 0.0 for c in "+-0" for k in (0, 1)}  # votes by kind, among good (0) and bad (1) documents
            for v, n in patterns.items():
                seen[v[r], 0] += n * good[v]
                seen[v[r], 1] += n * (1 - good[v])
            among_good = (seen["+", 0] + right) / (seen["+", 0] + seen["-", 0] + right + wrong)
            among_bad = (seen["-", 1] + right) / (seen["+", 1] + seen["-", 1] + right + wrong)
            logs.append({"0": 0.0, "+": math.log(among_good / (1 - among_bad)), "-": math.log((1 - among_good) / among_bad)})
        odds = math.log(share / (1 - share))
        before, good = good, {v: logistic(odds + sum(logs[r][c] for r, c in enumerate(v))) for v in patterns}
        if max(abs(good[v] - before[v]) for v in patterns) < CLOSE:
            break
    return good


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with `_counts`, `_votes`, `posterior`, `base_failed` and `kept`. Reads docs once."""
    counted = cut(aside(docs, MADE).withColumn("_counts", counts(F.col("text"))).drop("text").withColumn("_votes", pattern(F.col("_counts"))), "votes")
    # At most 3^rules rows; each is one document's pattern at least.
    found = posteriors({r["_votes"]: r["count"] for r in counted.groupBy("_votes").count().collect()})
    table = docs.sparkSession.createDataFrame(sorted(found.items()), "_votes string, posterior double")
    s = F.col("_counts")
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    judged = counted.join(F.broadcast(table), "_votes").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
