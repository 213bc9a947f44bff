"""From files to functions, structs, tokens and errors: the parse step as a table function over Arrow batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import classify_type
from ..model import FUNCTION, LOCATION, SCHEMA_VERSION, STRUCT_METRICS
from ..sources.files import decode, fnv1a
from .comparing import CATEGORIES

RAW_STRUCT = f"name string, kind string, location {LOCATION}, fields array<struct<name:string,ty:struct<text:string>>>, attributes map<string,string>"
PARSED = "path string, language string, source_hash string, ok boolean, error string, payload_functions string, payload_structs string"


def parse(files: DataFrame) -> DataFrame:
    """A row a file (path, language, content -> PARSED). A file that cannot be read gives its error, never a failed job."""

    def run(batches):
        import pandas as pd

        from ..parse import analyse

        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                text = decode(bytes(content or b""))
                try:
                    functions, structs = analyse(text, language, path)
                    rows.append((path, language, fnv1a(text), True, None, json.dumps(functions), json.dumps(structs)))
                except (SyntaxError, ValueError, IndexError, KeyError, RecursionError) as bad:
                    rows.append((path, language, fnv1a(text), False, f"{type(bad).__name__}: {bad}", "[]", "[]"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])

    return files.select("path", "language", "content").mapInPandas(run, PARSED)


def numbered(rows: DataFrame, report_id: str) -> DataFrame:
    """One report: idx runs over files by path, then over positions in them."""
    per_file = rows.groupBy("path").agg(F.max("_at").alias("_n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = per_file.withColumn("_start", F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0))).drop("_n")
    return rows.join(starts, "path").select(F.lit(report_id).alias("report_id"), (F.col("_start") + F.col("_at")).cast("int").alias("idx"), "x.*")


def functions(parsed: DataFrame, report_id: str = "report") -> DataFrame:
    each = parsed.select("path", F.posexplode(F.from_json("payload_functions", f"array<struct<{as_struct(FUNCTION)}>>")).alias("_at", "x"))
    return numbered(each, report_id)


def structs(parsed: DataFrame, report_id: str = "report") -> DataFrame:
    """Structs with categorised fields and counts by category."""
    each = parsed.select("path", F.posexplode(F.from_json("payload_structs", f"array<struct<{as_struct(RAW_STRUCT)}>>")).alias("_at", "x"))
    rows = numbered(each, report_id)
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["ty"].alias("ty"), classify_type(F.coalesce(f["ty"]["text"], F.lit(""))).alias("category")))
    rows = rows.withColumn("fields", fields)
    of = lambda c: F.size(F.filter("fields", lambda f: f["category"] == c)).alias(f"{c}_count")
    counts = [F.size("fields").alias("field_count"), *map(of, CATEGORIES)]
    return rows.withColumn("metrics", F.struct(*counts)).withColumn("metrics", F.struct(*[F.col(f"metrics.{m}").alias(m) for m in STRUCT_METRICS]))


def as_struct(ddl: str) -> str:
    return ", ".join(x.replace(" ", ":", 1) for x in ddl.split(", "))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("not ok").select("path", "language", "error")


def report(parsed: DataFrame) -> DataFrame:
    """One JSON document for all files: the language of the first file by path, unknown without files."""
    fs, ss = functions(parsed), structs(parsed)
    strip = lambda rows: rows.drop("report_id")
    filled = lambda rows: rows.withColumn("attributes", F.when(F.size("attributes") > 0, F.col("attributes")))  # noqa: E731  # empty ones are left out
    language = parsed.agg(F.coalesce(F.min_by("language", "path"), F.lit("unknown")).alias("language"))
    collected = lambda rows, name: strip(rows).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*[c for c in rows.columns if c not in ("idx", "report_id")]).alias("x"))), lambda a, b: a["idx"] - b["idx"]), lambda y: y["x"]).alias(name))
    joined = language.join(F.broadcast(collected(filled(fs), "functions"))).join(F.broadcast(collected(filled(ss), "structs")))  # one row each
    return joined.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "language", F.lit("").alias("source_file"), F.lit("").alias("source_hash"), "functions", "structs")).alias("value"))


TOKENS = "path string, line int, col_start int, col_end int, text string, kind string"


def token_table(files: DataFrame) -> DataFrame:
    """Display tokens, multi-line ones split by line. kind: comment, string, number, keyword, function, identifier, operator."""

    def run(batches):
        import pandas as pd

        from ..parse.lexing import LANGUAGES, tokens

        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                text = decode(bytes(content or b""))
                spec = LANGUAGES.get(language, LANGUAGES["r"])
                starts, data = [0], text.encode("utf-8", "surrogatepass")
                for line in data.split(b"\n"):
                    starts.append(starts[-1] + len(line) + 1)
                found = tokens(text, spec.name)
                for k, t in enumerate(found):
                    kind = {"char": "string", "sign": "operator"}.get(t.kind, t.kind)
                    if t.kind == "word":
                        after = found[k + 1].text if k + 1 < len(found) else ""
                        kind = "keyword" if t.text in spec.keywords else "function" if after == "(" else "identifier"
                    for n, part in enumerate(t.text.split("\n")):
                        col = t.start - starts[t.row] if n == 0 else 0
                        if part:
                            rows.append((path, t.row + n + 1, col, col + len(part.encode("utf-8", "surrogatepass")), part, kind))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TOKENS.split(", ")])

    return files.select("path", "language", "content").mapInPandas(run, TOKENS)
