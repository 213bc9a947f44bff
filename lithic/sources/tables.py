"""CSV files of orders and progress, JSON documents, fixed-width tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import meet

ORDER_COLUMNS = ("name", "file", "line_start", "scc_id", "scc_kind", "translated")
ANNOTATIONS = ("left_name", "left_file", "left_line_start", "match_strategy")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quotes double inside quotes, fields may span lines."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows in their order, one header a file."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def order_rows(ordered: DataFrame, vertices: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """The order file: bottom-up positions with names, groups and progress."""
    keep = vertices.select("report_id", "idx", "name", "file", "line_start")
    rows = meet(ordered, keep, ["report_id", "idx"])
    rows = merge_progress(rows, progress) if progress is not None else rows.withColumn("translated", F.lit("FALSE"))
    kind = F.when(F.col("scc_kind") == "none", "").otherwise(F.col("scc_kind"))
    return rows.withColumn("scc_kind", kind).orderBy("pos").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ORDER_COLUMNS])


def merge_progress(rows: DataFrame, progress: DataFrame, on=("name", "file")) -> DataFrame:
    """`translated` of the last progress row with the same name and file, FALSE without one. `row_no` orders progress rows."""
    numbered = progress if "row_no" in progress.columns else progress.withColumn("row_no", F.monotonically_increasing_id())
    last = numbered.where("translated is not null").groupBy(*on).agg(F.max_by("translated", "row_no").alias("translated"))
    return meet(rows, last, list(on), "left").withColumn("translated", F.coalesce("translated", F.lit("FALSE")))


def annotate(order: DataFrame, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The order file with its left counterpart by (name, file, line_start); the last pair of a key wins, a bad line counts as 0."""
    a = left.select(F.col("idx").alias("left_idx"), F.col("name").alias("left_name"), F.col("file").alias("left_file"), F.col("line_start").cast("string").alias("left_line_start"))
    b = right.select(F.col("idx").alias("right_idx"), F.col("name").alias("_n"), F.col("file").alias("_f"), F.col("line_start").cast("int").alias("_l"))
    wide = meet(meet(pairs, a, "left_idx"), b, "right_idx").withColumn("match_strategy", F.col("strategy"))
    last = wide.groupBy("_n", "_f", "_l").agg(F.max_by(F.struct(*ANNOTATIONS), "pair_idx").alias("_a"))
    line = F.coalesce(F.col("line_start").try_cast("int"), F.lit(0))
    rows = order.drop(*ANNOTATIONS)
    joined = meet(rows, last, (rows["name"] == last["_n"]) & (rows["file"] == last["_f"]) & (line == last["_l"]), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_a.{c}"), F.lit("")).alias(c) for c in ANNOTATIONS])


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON document a row, without null fields."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def top_contributors(per_metric, n: int = 3):
    """Text of the first n contributions that are above nought."""
    first = F.filter(F.slice(per_metric, 1, n), lambda x: x["contribution"] > 0)
    return F.array_join(F.transform(first, lambda x: F.format_string("%s=%.2f", x["metric"], x["contribution"])), ", ")


def render(rows: DataFrame, columns: dict[str, int], top: int | None = 20) -> str:
    """A fixed-width table of the first rows; names longer than their column end in an ellipsis."""
    from ..functions.scalar import truncate

    shown = rows.limit(top) if top else rows
    cells = shown.select(*[truncate(F.coalesce(F.col(c).cast("string"), F.lit("")), w).alias(c) for c, w in columns.items()])
    lines = [" ".join(c.ljust(w) for c, w in columns.items())]
    lines += [" ".join(str(r[c]).ljust(w) for c, w in columns.items()) for r in cells.collect()]
    return "\n".join(x.rstrip() for x in lines)
