"""The commands: compositions of operators over report files. Each returns DataFrames; the command line renders them."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..common import cut
from ..operators import callgraph, comparing, extraction, matching, prediction
from ..sources import files, tables

#: Looked for in the working directory when no mapping is named.
DEFAULT_MAPPING = "entity_mapping.toml"


def load_mapping(path: str | None) -> list[dict]:
    """Entries of a TOML or JSON mapping; left_* is the port's side. Without a path the default file, if there is one."""
    if path is None:
        if not os.path.exists(DEFAULT_MAPPING):
            return []
        path = DEFAULT_MAPPING
    with open(path, "rb") as file:
        if path.endswith(".toml"):
            import tomllib

            found = tomllib.load(file)
        else:
            found = json.load(file)
    # The keys that mapping files use for the two sides.
    sides = {"rust": "left", "other": "right", "left": "left", "right": "right"}
    rename = lambda k: "_".join([sides[k.split("_")[0]], *k.split("_")[1:]]) if k.split("_")[0] in sides else k
    return [{rename(k): v for k, v in entry.items()} for entry in found.get("entries", [])]


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """One strict JSON document."""
    raw = spark.read.schema(model.REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.withColumn("report_id", F.lit(path))


def load_functions(spark: SparkSession, path: str) -> DataFrame:
    return cut(model.flat(model.functions_of(load_report(spark, path))))


def load_structs(spark: SparkSession, path: str) -> DataFrame:
    rows = model.structs_of(load_report(spark, path))
    return cut(rows.select("idx", "name", F.col("location.file").alias("file"), *[F.col(f"metrics.{m}").alias(m) for m in model.STRUCT_METRICS]))


def pairs_of(left: DataFrame, right: DataFrame, mapping: str | None) -> DataFrame:
    return cut(matching.match(left, right, load_mapping(mapping)))


def analyze(spark: SparkSession, path: str, language: str | None = None, recurse: bool = False) -> DataFrame:
    """One JSON report of a file or a folder; a named file is read as the named language whatever its extension."""
    forced = bool(language) and not os.path.isdir(path)
    return extraction.report(cut(extraction.parse(files.scan(spark, path, language, recurse, forced))))


def compare(spark: SparkSession, left: str, right: str, mapping: str | None = None, top: int | None = None) -> DataFrame:
    a, b = load_functions(spark, left), load_functions(spark, right)
    return comparing.ranked_by(comparing.deviation(pairs_of(a, b, mapping), a, b), "total", "pair_idx", top)


def missing(spark: SparkSession, left: str, right: str, mapping: str | None = None, ratio: float = comparing.STUB_RATIO) -> dict[str, DataFrame]:
    a, b = load_functions(spark, left), load_functions(spark, right)
    pairs = pairs_of(a, b, mapping)
    return {"missing_in_left": comparing.missing(b, pairs, "right").orderBy("idx").select("name"), "extra_in_left": comparing.missing(a, pairs, "left").orderBy("idx").select("name"), "partial": comparing.partial(pairs, a, b, ratio).orderBy("pair_idx")}


def sort(spark: SparkSession, report: str, by: str = "composite", top: int | None = comparing.TOP) -> DataFrame:
    columns = ["name", "file", "line_start", "score", "cognitive", "max_combined_nesting", "loc_code"]
    return comparing.sort_report(load_functions(spark, report), by, top).select(*columns)


def constants_diff(spark: SparkSession, left: str, right: str, mapping: str | None = None, top: int | None = None) -> DataFrame:
    a, b = load_functions(spark, left), load_functions(spark, right)
    pairs = pairs_of(a, b, mapping)
    named = matching.paired(pairs, a.select("idx", "name"), b.select("idx", "name")).select("pair_idx", F.col("l_name").alias("left_name"), F.col("r_name").alias("right_name"))
    rows = named.join(comparing.constants_diff(comparing.pair_constants(pairs, a, b)), "pair_idx", "left").na.fill(0.0, ["score"])
    return comparing.ranked_by(rows, "score", "pair_idx", top)


def compare_structs(spark: SparkSession, left: str, right: str, mapping: str | None = None, top: int | None = None) -> DataFrame:
    a, b = load_structs(spark, left), load_structs(spark, right)
    return comparing.ranked_by(comparing.struct_deviation(cut(matching.match_structs(a, b, load_mapping(mapping))), a, b), "total", "pair_idx", top)


def missing_structs(spark: SparkSession, left: str, right: str, mapping: str | None = None) -> dict[str, DataFrame]:
    a, b = load_structs(spark, left), load_structs(spark, right)
    pairs = cut(matching.match_structs(a, b, load_mapping(mapping)))
    return {"missing_in_left": comparing.struct_missing(b, pairs, "right").orderBy("idx").select("name"), "extra_in_left": comparing.struct_missing(a, pairs, "left").orderBy("idx").select("name")}


def training_pairs(folder: str) -> list[tuple[str, str, str]]:
    """(base, left, right) of `<base>.rust.json` with `<base>.<other>.json`; of several others the last by name."""
    sides: dict[str, dict[str, str]] = {}
    for name in sorted(os.listdir(folder)):
        if m := re.fullmatch(r"(.+)\.([^.]+)\.json", name):
            sides.setdefault(m[1], {})["left" if m[2] == "rust" else "right"] = os.path.join(folder, name)
    return [(base, s["left"], s["right"]) for base, s in sides.items() if len(s) == 2]


def predict_train(spark: SparkSession, folder: str, out: str | None = None) -> dict:
    """A model from all matched pairs of all report pairs, without a mapping."""
    rows = None
    for _, left, right in training_pairs(folder):
        a, b = load_functions(spark, left), load_functions(spark, right)
        own = prediction.examples(cut(matching.match(a, b)), a, b)
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError(f"no pair of reports in {folder}")
    learnt = prediction.train(cut(rows))
    if out:
        prediction.save(learnt, out)
    return learnt


def predict_apply(spark: SparkSession, model_path: str, right: str, left: str | None = None, mapping: str | None = None) -> DataFrame:
    learnt, b = prediction.load(model_path), load_functions(spark, right)
    if left is None:
        return prediction.report(b, learnt)
    a = load_functions(spark, left)
    return prediction.report(b, learnt, pairs_of(a, b, mapping), a)


def graph(functions: DataFrame, strict: bool = False) -> DataFrame:
    return cut(callgraph.edges(callgraph.call_rows(functions), functions, strict))


def in_one_report(rows: DataFrame) -> DataFrame:
    return rows.withColumn("report_id", F.lit("report"))


def order(spark: SparkSession, report: str, strict: bool = False, progress: str | None = None) -> DataFrame:
    """The order file's rows, callees before callers; a previous order file gives the progress."""
    functions = load_functions(spark, report)
    ordered = callgraph.bottom_up(in_one_report(functions.select("idx", "name", "file", "line_start")), in_one_report(graph(functions, strict)))
    return tables.order_rows(ordered, in_one_report(functions), tables.read_csv(spark, progress) if progress else None)


def order_annotate(spark: SparkSession, order_csv: str, left: str, right: str, mapping: str | None = None) -> DataFrame:
    a, b = load_functions(spark, left), load_functions(spark, right)
    return tables.annotate(tables.read_csv(spark, order_csv), pairs_of(a, b, mapping), a, b)


def upstream(spark: SparkSession, left: str, right: str, mapping: str | None = None, strict: bool = False, left_seed: dict | None = None, right_seed: dict | None = None) -> dict[str, DataFrame]:
    """Callers of a seed on both sides; a side without a seed takes the counterpart of the other's."""
    a, b = load_functions(spark, left), load_functions(spark, right)
    pairs = pairs_of(a, b, mapping)
    seeds = {"left": callgraph.select_seed(a, "left", **left_seed).select("idx") if left_seed else None, "right": callgraph.select_seed(b, "right", **right_seed).select("idx") if right_seed else None}
    if not left_seed and not right_seed:
        raise ValueError("name a seed on one side at least")
    for side, other in (("left", "right"), ("right", "left")):
        if seeds[side] is None:
            seeds[side] = pairs.join(seeds[other].withColumnRenamed("idx", f"{other}_idx"), f"{other}_idx").select(F.col(f"{side}_idx").alias("idx"))
    up = {side: cut(callgraph.callers(graph(rows, strict), seeds[side], cut).select("idx").distinct()) for side, rows in (("left", a), ("right", b))}
    rows = cut(callgraph.upstream_pairs(pairs, comparing.deviation(pairs, a, b), up["left"], up["right"]))
    named = lambda ids, functions: ids.join(functions.select("idx", "name", "file", "line_start", "enclosing_type"), "idx").orderBy("file", "line_start", "name")
    where = b.select(F.col("idx").alias("right_idx"), "file", "line_start", "name")
    return {
        "left_upstream": named(up["left"], a), "right_upstream": named(up["right"], b), "warnings": callgraph.upstream_warnings(rows, pairs, up["left"], up["right"]),
        "pairs": rows.join(where, "right_idx").orderBy(F.asc("overlap"), F.desc("total"), "file", "line_start", "name"),
    }


def call_graph_diff(spark: SparkSession, left: str, right: str, mapping: str | None = None, strict: bool = False, top: int | None = 20) -> dict[str, DataFrame]:
    a, b = load_functions(spark, left), load_functions(spark, right)
    pairs = pairs_of(a, b, mapping)
    sides = {}
    for side, rows in (("left", a), ("right", b)):
        edges = graph(rows, strict)
        scc = cut(callgraph.recursion(in_one_report(rows.select("idx")), in_one_report(edges)))
        sides[side] = (cut(callgraph.translated(edges, pairs, side)), scc.select("idx", "scc_kind", "scc_size"), callgraph.resolution_counts(callgraph.call_rows(rows), rows).select(F.col("ambiguous").alias(f"{side}_ambiguous_call_sites"), F.col("unresolved").alias(f"{side}_unresolved_call_sites")))
    (le, ls, lc), (re_, rs, rc) = sides["left"], sides["right"]
    diff = cut(callgraph.graph_diff(pairs, le, re_, ls, rs))
    only_left, only_right = callgraph.edge_diff(le, re_)
    cut_to = lambda rows: rows.orderBy("src_pair", "dst_pair").limit(top) if top else rows
    summary = callgraph.diff_summary(diff, le, re_).join(F.broadcast(lc)).join(F.broadcast(rc))  # one row each
    return {"summary": summary, "edges_only_in_left": cut_to(only_left), "edges_only_in_right": cut_to(only_right), "pairs": callgraph.top_diff(diff, top)}
