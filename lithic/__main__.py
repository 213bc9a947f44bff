"""Command line: python -m lithic COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import commands
from .sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lithic")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *reports: str, mapping: bool = False, limit: bool = False):
        p = sub.add_parser(name)
        for r in reports:
            p.add_argument(r)
        if mapping:
            p.add_argument("--mapping")
        if limit:
            p.add_argument("--top", type=int, default=20)
        p.add_argument("--format", choices=("json", "table"), default="table")
        return p

    p = add("analyze", "path")
    p.add_argument("-l", "--language")
    p.add_argument("-r", "--recurse", action="store_true")
    add("compare", "left", "right", mapping=True, limit=True)
    add("missing", "left", "right", mapping=True).add_argument("--ratio", type=float, default=0.2)
    add("sort", "report", limit=True).add_argument("--by", default="composite")
    add("constants-diff", "left", "right", mapping=True, limit=True)
    add("compare-structs", "left", "right", mapping=True, limit=True)
    add("missing-structs", "left", "right", mapping=True)
    add("predict-train", "folder").add_argument("--out", required=True)
    add("predict-apply", "model_path", "right", mapping=True).add_argument("--left")
    p = add("order", "report")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--progress")
    add("order-annotate", "order_csv", "left", "right", mapping=True)
    for name in ("upstream", "call-graph-diff"):
        p = add(name, "left", "right", mapping=True, limit=name != "upstream")
        p.add_argument("--strict", action="store_true")
        if name == "upstream":
            p.add_argument("--left-seed", type=json.loads, help='{"name": ..., "path": ..., "line": ..., "cls": ...}')
            p.add_argument("--right-seed", type=json.loads)
    return top


def show(found, form: str) -> str:
    if isinstance(found, DataFrame):
        if found.columns == ["value"]:
            return json.dumps(json.loads(found.first()[0]), indent=2)
        if form == "json":
            return json.dumps([json.loads(r[0]) for r in tables.to_json(found).collect()], indent=2)
        if "per_metric" in found.columns:
            found = found.withColumn("top", tables.top_contributors(found["per_metric"])).drop("per_metric", "pair_idx", "left_idx", "right_idx")
        return tables.render(found, {c: 60 if c == "top" else 32 if "name" in c or c == "file" else 14 for c in found.columns}, None)
    if form == "json" and all(isinstance(x, DataFrame) for x in found.values()):
        return json.dumps({k: json.loads(show(v, form)) for k, v in found.items()}, indent=2)
    return "\n\n".join(f"{k}\n{show(v, form)}" if isinstance(v, DataFrame) else f"{k}: {json.dumps(v)}" for k, v in found.items())


def main(args: list[str] | None = None) -> int:
    given = vars(parser().parse_args(args))
    command, form = given.pop("command").replace("-", "_"), given.pop("format")
    spark = SparkSession.builder.getOrCreate()
    print(show(getattr(commands, command)(spark, **given), form))
    return 0


if __name__ == "__main__":
    sys.exit(main())
