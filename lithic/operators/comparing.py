"""Analyses of matched pairs: deviation, missing, stubs, constants, structs, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import meet
from ..functions import scalar
from ..model import METRICS, STRUCT_METRICS
from .matching import paired

# Weights of the deviation; what is not listed weighs 1.
WEIGHTS = {
    "cyclomatic": 2.0, "cognitive": 2.0, "max_combined_nesting": 2.0, "calls_total": 1.0, "calls_unique": 1.0, "loc_code": 1.0, "branches": 1.5, "loops": 1.0,
    "halstead_volume": 1.0, "halstead_difficulty": 1.0, "inputs": 0.5, "outputs": 0.5, "goto_count": 1.0, "early_returns": 0.5,
}
STRUCT_WEIGHTS = {"other_count": 0.5}
CONSTANT_KINDS = ("int", "float", "string", "char", "bool")
CATEGORIES = ("int", "float", "bool", "char", "string", "pointer", "array", "collection", "other")
STUB_RATIO = 0.2
TOP = 20


def p95_scale(both: DataFrame, metrics=METRICS) -> DataFrame:
    """metric, scale: the nearest-rank 95th percentile, at least 1. Values are counted before they are ranked, so the ranking
    window holds distinct values only."""
    long = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    counted = long.groupBy("metric", "value").count()
    by = Window.partitionBy("metric")
    run = counted.withColumns({"_upto": F.sum("count").over(by.orderBy("value")), "_n": F.sum("count").over(by)})
    rank = F.round((F.col("_n") - 1) * F.lit(0.95)).cast("long") + 1
    return run.where(F.col("_upto") >= rank).groupBy("metric").agg(F.greatest(F.min("value"), F.lit(1.0)).alias("scale"))


def scale_row(both: DataFrame, metrics=METRICS) -> DataFrame:
    """One row with a column for each metric's scale."""
    return p95_scale(both, metrics).groupBy().pivot("metric", list(metrics)).agg(F.first("scale"))


def contributions(metrics, weights: dict[str, float]) -> Column:
    """Array of (metric, left, right, contribution), largest first, ties in the metrics' order. Over l_*, r_* and s_* columns."""
    parts = []
    for i, m in enumerate(metrics):
        a, b = F.col(f"l_{m}").cast("double"), F.col(f"r_{m}").cast("double")
        share = F.lit(float(weights.get(m, 1.0))) * (F.abs(a - b) / F.coalesce(F.col(f"s_{m}"), F.lit(1.0)))
        parts.append(F.struct((-share).alias("minus"), F.lit(i).alias("at"), F.lit(m).alias("metric"), a.alias("left"), b.alias("right"), share.alias("contribution")))
    return F.transform(F.array_sort(F.array(*parts)), lambda x: F.struct(x["metric"].alias("metric"), x["left"].alias("left"), x["right"].alias("right"), x["contribution"].alias("contribution")))


def total(metrics, weights: dict[str, float]) -> Column:
    return reduce(lambda x, y: x + y, [F.lit(float(weights.get(m, 1.0))) * (F.abs(F.col(f"l_{m}").cast("double") - F.col(f"r_{m}").cast("double")) / F.coalesce(F.col(f"s_{m}"), F.lit(1.0))) for m in metrics])


def deviation(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: dict[str, float] | None = None, metrics=METRICS) -> DataFrame:
    """pair_idx, left_idx, right_idx, strategy, left_name, right_name, total, per_metric. Order by total desc, pair_idx for the ranking."""
    weights = WEIGHTS if weights is None else weights
    keep = ["idx", "name", *metrics]
    scale = scale_row(left.select(*metrics).unionByName(right.select(*metrics)), metrics)
    scale = scale.select(*[F.col(m).alias(f"s_{m}") for m in metrics])  # one row
    wide = paired(pairs, left.select(*keep), right.select(*keep)).join(F.broadcast(scale))
    return wide.select("pair_idx", "left_idx", "right_idx", "strategy", F.col("l_name").alias("left_name"), F.col("r_name").alias("right_name"), total(metrics, weights).alias("total"), contributions(metrics, weights).alias("per_metric"))


def fallback_deviation(pairs: DataFrame, left: DataFrame, right: DataFrame, metrics=METRICS) -> DataFrame:
    """Deviation without scales and weights, for a pair that no scaled result holds."""
    keep = ["idx", *metrics]
    wide = paired(pairs, left.select(*keep), right.select(*keep)).withColumns({f"s_{m}": F.lit(1.0) for m in metrics})
    even = dict.fromkeys(metrics, 1.0)
    return wide.select("pair_idx", "left_idx", "right_idx", total(metrics, even).alias("total"), contributions(metrics, even).alias("per_metric"))


def ranked_by(rows: DataFrame, score: str, tie: str = "pair_idx", top: int | None = TOP) -> DataFrame:
    out = rows.orderBy(F.desc(score), F.asc(tie))
    return out.limit(top) if top else out


def struct_deviation(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return deviation(pairs, left, right, STRUCT_WEIGHTS, STRUCT_METRICS)


IDENTITY = ["name", "file", "line_start"]


def missing(side: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    """Rows of a side ("left" or "right") without a pair, by (name, file, line_start)."""
    matched = meet(side, pairs.select(F.col(f"{which}_idx").alias("idx")), "idx", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in IDENTITY])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY])
    return meet(side, matched, same, "left_anti")


def struct_missing(side: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    """By name alone: a matched name hides others of that name."""
    matched = meet(side, pairs.select(F.col(f"{which}_idx").alias("idx")), "idx", "left_semi").select("name").distinct()
    return meet(side, matched, "name", "left_anti")


def partial(pairs: DataFrame, left: DataFrame, right: DataFrame, ratio: float = STUB_RATIO) -> DataFrame:
    """Pairs whose left side is a stub of the right one, but for the exempt ones (constructors, thin main wrappers)."""
    keep = ["idx", "name", "file", "loc_code"]
    wide = paired(pairs, left.select(*keep), right.select(*keep))
    a, b = F.col("l_loc_code"), F.col("r_loc_code")
    share = F.greatest(a, F.lit(1)).cast("double") / F.greatest(b, F.lit(1)).cast("double")
    special = scalar.is_constructor(F.col("r_name")) | scalar.is_destructor(F.col("r_name"))
    thin = (F.col("l_name") == "main") & (F.col("r_name") == "main") & (a <= 5) & F.col("l_file").contains("src/bin/")
    exempt = (F.col("strategy") == "Mapping") & (((a <= 1) & special) | thin)
    reason = F.concat(F.lit("left LOC "), a.cast("long").cast("string"), F.lit(" is "), F.bround(100 * share, 0).cast("long").cast("string"), F.lit("% of right LOC "), b.cast("long").cast("string"))
    return wide.where(~F.coalesce(exempt, F.lit(False)) & (share < ratio)).select("pair_idx", F.col("l_name").alias("left_name"), F.col("r_name").alias("right_name"), reason.alias("reason"))


def constants_diff(constants: DataFrame) -> DataFrame:
    """Multiset difference of constants by pair. constants: pair_idx, side ("left"/"right"), kind, value (text), ord.

    Floats are compared after rounding to 12 places; `value` of equal constants is equal. Returns pair_idx, only_left,
    only_right, in_both (arrays of (kind, value), ordered) and score.
    """
    n = lambda side: F.count_if(F.col("side") == side)
    counted = constants.groupBy("pair_idx", "kind", "value").agg(n("left").alias("l"), n("right").alias("r"))
    times = lambda k: F.array_repeat(F.struct("kind", "value"), k.cast("int"))
    per_kind = counted.groupBy("pair_idx", "kind").agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("a"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("b"),
        F.flatten(F.collect_list(times(F.greatest(F.col("l") - F.col("r"), F.lit(0))))).alias("only_left"), F.flatten(F.collect_list(times(F.greatest(F.col("r") - F.col("l"), F.lit(0))))).alias("only_right"),
        F.flatten(F.collect_list(times(F.least("l", "r")))).alias("in_both"),
    )
    merged = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
    score = F.sum(F.col("a") + F.col("b")) + 0.5 * F.sum(F.abs(F.col("l") - F.col("r")))
    return per_kind.groupBy("pair_idx").agg(merged("only_left"), merged("only_right"), merged("in_both"), score.alias("score"))


def pair_constants(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The long form that constants_diff takes, from functions with `constants`."""
    def side(rows, which):
        c = F.col("c")
        value = F.when(c["kind"] == "float", F.round(c["float_value"], 12).cast("string")).otherwise(F.coalesce(c["int_value"].cast("string"), c["str_value"], c["bool_value"].cast("string")))
        each = rows.select(F.col("idx").alias(f"{which}_idx"), F.explode("constants").alias("c"))
        return meet(pairs, each, f"{which}_idx").select("pair_idx", F.lit(which).alias("side"), c["kind"].alias("kind"), value.alias("value"))

    return side(left, "left").unionAll(side(right, "right"))


def constants_histogram(constants: DataFrame, by: str = "idx") -> DataFrame:
    return constants.groupBy(by).pivot("kind", list(CONSTANT_KINDS)).count().na.fill(0)


def constants_by_kind(constants: DataFrame, by: str = "idx") -> DataFrame:
    """by, kind, members: the texts of a function's constants of each kind, ordered."""
    return constants.groupBy(by, "kind").agg(F.array_sort(F.collect_list("value")).alias("members"))


def multiplicity(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n: how often each key occurs."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def differing(diff: DataFrame) -> DataFrame:
    """Rows of constants_diff with a constant on one side only; tables show no others."""
    return diff.where((F.size("only_left") > 0) | (F.size("only_right") > 0))


def struct_metrics(fields: DataFrame, by=("idx",)) -> DataFrame:
    """Field counts by category. fields: the keys and `type`."""
    category = fields.withColumn("_category", scalar.classify_type(F.col("type")))
    counts = [F.count_if(F.col("_category") == c).alias(f"{c}_count") for c in CATEGORIES]
    return category.groupBy(*by).agg(F.count(F.lit(1)).alias("field_count"), *counts).select(*by, *STRUCT_METRICS)


SORT_METRICS = ("cognitive", "max_combined_nesting", "calls_total", "loc_code", "halstead_difficulty")
# The names of the sort keys.
SORT_KEYS = {
    "cognitive": "cognitive", "cyclomatic": "cyclomatic", "combined-nesting": "max_combined_nesting", "combined_nesting": "max_combined_nesting", "nesting": "max_combined_nesting",
    "loc": "loc_code", "halstead-difficulty": "halstead_difficulty", "halstead_difficulty": "halstead_difficulty", "halstead": "halstead_difficulty",
}


def sort_report(functions: DataFrame, key: str = "composite", top: int | None = TOP) -> DataFrame:
    """Functions by a key, largest first, ties by position. Composite is the sum of five z-scores with population deviations."""
    if key in ("combined-nesting-x-loc", "nesting-x-loc"):
        rows = functions.withColumn("score", F.col("max_combined_nesting").cast("double") * F.col("loc_code").cast("double"))
    elif key == "composite":
        stats = [f(F.col(m).cast("double")).alias(f"_{n}_{m}") for m in SORT_METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
        score = reduce(lambda a, b: a + b, [scalar.zscore(F.col(m).cast("double"), F.col(f"_mean_{m}"), F.col(f"_std_{m}")) for m in SORT_METRICS])
        rows = functions.join(F.broadcast(functions.agg(*stats))).withColumn("score", score).drop(*[f"_{n}_{m}" for m in SORT_METRICS for n in ("mean", "std")])
    else:
        rows = functions.withColumn("score", F.col(SORT_KEYS[key]).cast("double"))
    return ranked_by(rows, "score", "idx", top)
