"""Metric prediction: ridge regression from one side's features to the other's metrics, rules, outlier scores."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import meet
from ..model import METRICS

# Features and targets in the order in which model files list them.
FEATURES = (*METRICS, "arity", "outputs_count", "constants", "types_used", "loc_log")
TARGETS = ("loc_code", "branches", "loops", "max_combined_nesting", "calls_unique", "calls_total", "cyclomatic", "cognitive", "halstead_volume", "halstead_difficulty", "early_returns")
RIDGE = 1e-6

# The rules a model starts with, as they stand in model files.
RULES = [
    {
        "name": "c_goto_to_rust_early_return",
        "description": "C 'goto cleanup' pattern typically becomes '?' in Rust, adding early returns and removing some branches.",
        "condition": {"GotoAtLeast": 1},
        "adjustments": [
            {"metric": "early_returns", "delta": 1.0, "factor": 1.0},
            {"metric": "branches", "delta": -1.0, "factor": 1.0},
            {"metric": "cyclomatic", "delta": -1.0, "factor": 1.0},
        ],
    },
    {
        "name": "c_switch_to_rust_match",
        "description": "Switch with many arms: Rust `match` typically drops a default or cyclomatic by 1.",
        "condition": {"SwitchCasesAtLeast": 5},
        "adjustments": [{"metric": "cyclomatic", "delta": -1.0, "factor": 1.0}],
    },
    {
        "name": "pointer_heavy_signature",
        "description": "Heavy pointer I/O in C typically becomes borrows/slices in Rust; expect fewer unsafe blocks but similar branches.",
        "condition": {"PointerInputsAtLeast": 3},
        "adjustments": [{"metric": "loc_code", "delta": 1.0, "factor": 1.0}],
    },
    {
        "name": "inline_asm_preserves",
        "description": "Inline asm blocks generally survive translation wrapped in unsafe{}; LOC stable.",
        "condition": "HasAsm",
        "adjustments": [],
    },
]


def features(functions: DataFrame) -> DataFrame:
    """Flat functions with the feature columns as f_*."""
    size = F.size("constants") if dict(functions.dtypes).get("constants", "").startswith("array") else F.col("constants")
    special = {"constants": size.cast("double"), "loc_log": F.ln(F.col("loc_code").cast("double") + 1.0)}
    return functions.withColumns({f"f_{f}": special.get(f, F.col(f).cast("double") if f in functions.columns else F.lit(0.0)) for f in FEATURES})


def train(examples: DataFrame, feature_names=FEATURES, targets=TARGETS, ridge: float = RIDGE) -> dict:
    """Model from rows with x_<feature> and y_<target>. One pass sums the products of all columns (partial sums on the executors, one row
    to the driver), one factorisation serves all targets, a second pass sums the residuals."""
    import numpy as np

    x = [F.lit(1.0), *[F.col(f"x_{f}").cast("double") for f in feature_names]]
    y = [F.col(f"y_{t}").cast("double") for t in targets]
    m = len(x)
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    sums = examples.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i] * x[j]) for i, j in upper], *[F.sum(a * b) for b in y for a in x]).first()
    n = sums[0]
    if not n:
        return {"features": list(feature_names), "targets": {}, "rules": RULES}
    gram = np.zeros((m, m))
    for (i, j), v in zip(upper, sums[1 : 1 + len(upper)]):
        gram[i, j] = gram[j, i] = v
    right = np.array(sums[1 + len(upper) :]).reshape(len(y), m).T
    beta = np.linalg.solve(gram + ridge * np.eye(m), right)
    fits = {t: {"intercept": float(beta[0, k]), "coefs": dict(zip(feature_names, map(float, beta[1:, k])))} for k, t in enumerate(targets)}
    rest = [F.col(f"y_{t}").cast("double") - linear(fits[t], lambda f: F.col(f"x_{f}").cast("double")) for t in targets]
    moments = examples.agg(*[F.avg(r * r) for r in rest], *[F.stddev_pop(r) for r in rest]).first()
    for k, t in enumerate(targets):
        fits[t] |= {"rmse": float(moments[k]) ** 0.5, "residual_std": max(1e-6, float(moments[len(targets) + k]))}
    return {"features": list(feature_names), "targets": fits, "rules": RULES}


def linear(fit: dict, column) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(column(f), F.lit(0.0)) for f, w in fit["coefs"].items()], F.lit(fit["intercept"]))


def condition(rule: dict) -> Column:
    kind, n = (rule["condition"], 0) if isinstance(rule["condition"], str) else next(iter(rule["condition"].items()))
    pointers = lambda: F.size(F.filter("input_types", lambda t: t.rlike("[*&]")))
    # How model files spell the conditions.
    return {
        "GotoAtLeast": lambda: F.col("goto_count") >= n,
        "SwitchCasesAtLeast": lambda: F.col("branches") >= n,
        "PointerInputsAtLeast": lambda: pointers() >= n,
        "HasAsm": lambda: F.col("loc_asm") > 0,
        "Always": lambda: F.lit(True),
    }[kind]()


def adjusted(predicted: dict[str, Column], rules: list[dict]) -> dict[str, Column]:
    """y * factor + delta for each rule that holds, one after the other."""
    out = dict(predicted)
    for rule in rules:
        for a in rule["adjustments"]:
            if a["metric"] in out:
                y = out[a["metric"]]
                out[a["metric"]] = F.when(condition(rule), y * a.get("factor", 1.0) + a["delta"]).otherwise(y)
    return out


def predict(functions: DataFrame, model: dict) -> DataFrame:
    """functions with p_<target> after the rules."""
    rows = features(functions)
    raw = {t: linear(fit, lambda f: F.col(f"f_{f}")) for t, fit in model["targets"].items()}
    return rows.withColumns({f"p_{t}": c for t, c in adjusted(raw, model["rules"]).items()}).drop(*[f"f_{f}" for f in FEATURES])


def outlier(actual: Column, predicted: Column, residual_std: float) -> Column:
    return (actual - predicted) / F.greatest(F.lit(residual_std), F.lit(1e-6))


def report(other: DataFrame, model: dict, pairs: DataFrame | None = None, left: DataFrame | None = None) -> DataFrame:
    """Predictions for a side's functions, with actual values and z-scores where the first pair of that name has them."""
    rows = predict(other, model)
    if pairs is None:
        return rows
    named = meet(pairs, other.select(F.col("idx").alias("right_idx"), F.col("name").alias("_name")), "right_idx")
    first = named.groupBy("_name").agg(F.min_by("left_idx", "pair_idx").alias("_left"))
    actual = left.select(F.col("idx").alias("_left"), F.col("name").alias("matched_name"), *[F.col(t).cast("double").alias(f"a_{t}") for t in model["targets"]])
    joined = meet(meet(rows, first, F.col("name") == F.col("_name"), "left"), actual, "_left", "left").drop("_left", "_name")
    return joined.withColumns({f"z_{t}": outlier(F.col(f"a_{t}"), F.col(f"p_{t}"), fit["residual_std"]) for t, fit in model["targets"].items()})


def examples(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Training rows of matched pairs: x_* of the right, y_* of the left."""
    x = features(right).select(F.col("idx").alias("right_idx"), *[F.col(f"f_{f}").alias(f"x_{f}") for f in FEATURES])
    y = left.select(F.col("idx").alias("left_idx"), *[F.col(t).cast("double").alias(f"y_{t}") for t in TARGETS])
    return meet(meet(pairs, x, "right_idx"), y, "left_idx")


def save(model: dict, path: str) -> None:
    with open(path, "w") as out:
        json.dump(model, out, indent=2)


def load(path: str) -> dict:
    with open(path) as file:
        return json.load(file)
