"""Operator 10: a sparse rule ensemble for quality, compiled into Spark column expressions.

Small trees are grown on statistics of labelled texts; each path from a root to any node is a rule, a conjunction of comparisons.
A lasso-penalised logistic regression weighs the rules and most weights end at nought; what is left is a sum of `when`
expressions over the statistics, so scoring is one projection that Catalyst compiles, without Python beyond the statistics.

Fitting uses at most SAMPLE labelled rows, the first in the order of a hash of doc_id (documented bound; a fit needs no more). A histogram
of the labelled rows' hashes says how far the sample reaches, so only its texts are read for the fit and only its rows come to the driver.
Scoring covers every row and reads it once. Only rows whose crc32(doc_id as text) mod 4 is not 2 are learnt from, and labels, lang, source and
doc_id are never inputs.

Cases: a null or empty text has all statistics 0 and is scored by them; without labels of both kinds the score is the share of
label 1 in the sample (0.5 without any); several labels of one document all count; repeated rows get the same score; an empty
table gives no row; a null doc_id is never learnt from and its held_out is false; other columns pass through `score`, those with the name
of a result as `<name>_input`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, own_columns
from .text_stats import COUNTS, counts

SAMPLE = 20_000
TREES, DEPTH, LEAF, CUTS = 30, 3, 20, 24
PENALTY = 2e-3
THRESHOLD = 0.7
#: Bits of the hash by which the sample is found.
STEPS = 12
MADE = ("held_out", "score", "predicted")
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT


def features(s: Column) -> dict[str, Column]:
    """Statistics by name, doubles, each a formula over the struct of counts."""
    at_least_one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    words, chars, lines = at_least_one(s["n_words"]), at_least_one(s["word_chars"]), at_least_one(s["n_lines"])
    letters = at_least_one(s["n_upper"] + s["n_lower"])
    return {
        "words": s["n_words"].cast("double"),
        "mean_word": s["word_chars"] / words,
        "max_word": s["max_word"].cast("double"),
        "symbols": s["n_symbols"] / words,
        "same_lines": s["n_dup_lines"] / lines,
        "repeats": s["n_repeat_words"] / words,
        "line_words": s["n_words"] / lines,
        "ended_lines": s["n_ended_lines"] / lines,
        "distinct": s["n_distinct_words"] / words,
        "capitals": s["n_upper"] / letters,
        "digits": s["n_digits"] / chars,
        "stops": s["n_stops"] / words,
        "exclaims": s["n_exclaims"] / words,
        "bars": s["n_bars"] / words,
        "marks": s["n_marks"] / chars,
        "wide": s["n_wide"] / chars,
    }


class Grower:
    """Trees on binned statistics; yields each node's path as (feature, is_above, threshold) conditions."""

    def __init__(self, x, y, seed: int = 7):
        import numpy as np

        self.np, self.x, self.y, self.random = np, x, y, np.random.default_rng(seed)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, CUTS))) for j in range(x.shape[1])]

    def split(self, rows, residual, columns):
        np, best = self.np, (1e-9, None, None)
        total, n = residual[rows].sum(), len(rows)
        for j in columns:
            place = np.searchsorted(self.cuts[j], self.x[rows, j], side="left")  # x <= cut k exactly when place <= k
            k = len(self.cuts[j])
            below_n = np.cumsum(np.bincount(place, minlength=k + 1))[:k]
            below = np.cumsum(np.bincount(place, weights=residual[rows], minlength=k + 1))[:k]
            ok = (below_n >= LEAF) & (n - below_n >= LEAF)
            if not ok.any():
                continue
            gain = np.where(ok, below**2 / np.maximum(below_n, 1) + (total - below) ** 2 / np.maximum(n - below_n, 1) - total**2 / n, 0)
            if gain.max() > best[0]:
                best = (gain.max(), j, float(self.cuts[j][gain.argmax()]))
        return best[1:]

    def paths(self):
        """Paths of boosted trees, each on a random half of rows and columns."""
        np, n, m = self.np, *self.x.shape
        margin, found = np.zeros(n), {}
        for _ in range(TREES):
            residual = self.y - 1 / (1 + np.exp(-margin))
            columns = self.random.permutation(m)[: max(2, (2 * m) // 3)]
            waiting = [((), self.random.permutation(n)[: max(2 * LEAF, n // 2)])]
            leaves = []
            while waiting:
                path, rows = waiting.pop()
                j, at = (None, None) if len(path) == DEPTH or len(rows) < 2 * LEAF else self.split(rows, residual, columns)
                if j is None:
                    leaves.append((path, residual[rows].mean() if len(rows) else 0.0))
                    continue
                above = self.x[rows, j] > at
                for side, part in ((True, rows[above]), (False, rows[~above])):
                    deeper = (*path, (j, side, at))
                    found.setdefault(deeper, None)
                    waiting.append((deeper, part))
            for path, value in leaves:
                margin += 0.6 * value / 0.25 * self.matches(path)
        return list(found)

    def matches(self, path):
        out = self.np.ones(len(self.x), bool)
        for j, side, at in path:
            out &= (self.x[:, j] > at) == side
        return out


def lasso(a, y, penalty: float = PENALTY, rounds: int = 400):
    """Intercept and weights of an l1-penalised logistic regression, by accelerated proximal gradient."""
    import numpy as np

    n, m = a.shape
    step = 4.0 / max(1e-9, np.linalg.norm(np.hstack([a, np.ones((n, 1))]), 2) ** 2 / n)
    w, b = np.zeros(m), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(a @ pw + pb))) - y
        nw = pw - step * (a.T @ error) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb, nt = pb - step * error.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        if np.abs(nw - w).max(initial=0) < 1e-7 and abs(nb - b) < 1e-7:
            break
        w, b, t = nw, nb, nt
    return float(nb), nw


def fit(x, y) -> dict:
    """{'intercept', 'rules': [(weight, path)]} with only the rules that weigh anything."""
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(y.mean())
        return {"intercept": math.log((share + 1e-3) / (1 - share + 1e-3)), "rules": []}
    grower = Grower(x, y)
    columns: dict[bytes, tuple] = {}
    for path in grower.paths():  # of rules that hold for the same rows, the shortest
        mark = grower.matches(path)
        key = np.packbits(mark).tobytes()
        if 0 < mark.sum() < len(y) and (key not in columns or len(path) < len(columns[key])):
            columns[key] = path
    paths = list(columns.values())
    a = np.column_stack([grower.matches(p) for p in paths]).astype(float) if paths else np.zeros((len(y), 0))
    intercept, weights = lasso(a, y)
    return {"intercept": intercept, "rules": [(float(w), p) for w, p in zip(weights, paths) if abs(w) > 1e-6]}


def compiled(model: dict, columns: list[Column]) -> Column:
    """The model as one column: the logistic of the weights of the rules that hold."""
    margin = F.lit(model["intercept"])
    for weight, path in model["rules"]:
        holds = reduce(lambda a, b: a & b, [columns[j] > at if side else columns[j] <= at for j, side, at in path])
        margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fits on at most `sample` labelled rows of the learning folds."""
    names = list(features(F.col("_counts")))
    place = F.shiftright(F.xxhash64("doc_id"), 64 - STEPS)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where("_quality in (0, 1)").distinct()
    known = known.where(~held_out(F.col("doc_id"))).withColumn("_place", place)
    # How many rows there are up to each of 2^STEPS places in the order of the hash.
    sizes = docs.select("doc_id").join(known, "doc_id").groupBy("_place").count().collect()
    reach, last = 0, None
    for row in sorted(sizes):
        if reach >= sample:
            break
        reach, last = reach + row["count"], row["_place"]
    chosen = known.where(F.col("_place") <= (last if last is not None else -(1 << STEPS))).drop("_place")
    # Both sides lose what the sample does not reach before they meet.
    learning = docs.select("doc_id", "text").where(place <= last) if last is not None else docs.select("doc_id", "text").limit(0)
    rows = (
        learning.join(chosen, "doc_id")
        .select("doc_id", "_quality", counts(F.col("text")).alias("_counts"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_quality")
        .limit(sample)
        .select(*[c.alias(k) for k, c in features(F.col("_counts")).items()], "_quality")
        .toPandas()
    )
    model = fit(rows[names].to_numpy(float), rows["_quality"].to_numpy(float))
    return model | {"features": names}


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one more column `_qc_out`: score, predicted and held_out."""
    model = learn(docs, labels)
    made = list(features(F.col("_qc_counts")).items())
    wide = aside(docs, ["_qc_counts", "_qc_score", "_qc_out", *[f"_qc_{k}" for k, _ in made]])
    own = own_columns(wide)
    wide = wide.withColumn("_qc_counts", counts(F.col("text"))).withColumns({f"_qc_{k}": c for k, c in made})
    wide = wide.withColumn("_qc_score", compiled(model, [F.col(f"_qc_{k}") for k, _ in made]))
    out = F.struct(F.col("_qc_score").alias("score"), (F.col("_qc_score") >= threshold).cast("int").alias("predicted"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return wide.select(*own, out.alias("_qc_out"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, without their texts, with `held_out`, `score` and `predicted`."""
    found = scored(aside(docs, MADE), labels, threshold).drop("text")
    return found.select("*", "_qc_out.held_out", "_qc_out.score", "_qc_out.predicted").drop("_qc_out")


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted to be good, with their own columns as they are."""
    found = scored(docs, labels, threshold).where("_qc_out.predicted = 1").drop("_qc_out")
    return found.toDF(*docs.columns)
