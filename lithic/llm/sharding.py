"""Operator 2: sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so that equal texts lie side by side. Seven splitters must part the order into
eight runs of nearly equal bytes. Each round counts, over all rows, the exact bytes and rows below 65,536 candidate boundaries
inside every interval that still holds a target, and narrows each interval to the candidate cell around its target, until a
boundary is within the tolerance. Boundaries between different hashes come first, which keeps equal texts in one shard; only where
a group of equal texts is itself larger than the tolerance allows does the search go on inside it, by doc_id. Then rows are
exchanged once, into key ranges that are sorted and written; a range holds some CELL_BYTES, and a group of equal texts is parted by doc_id.
A row's slot is its place in the order of its shard, so every shard is sorted.

The driver sees histograms of at most 65,536 cells a splitter and a count for each range, never rows.

Cases: null text has no bytes, so its size is 1, its crc that of no bytes; a null doc_id sorts first; rows alike in hash and
doc_id stay together; an empty table gives no row; other columns pass through, those with the name of a result as `<name>_input`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, text_or_empty

SHARDS = 8
#: Part of a shard's bytes by which a boundary may miss its target.
TOLERANCE = 0.005
#: Bytes that a sorted range should hold.
CELL_BYTES = 256 << 20
MADE = ("size", "law", "shard", "slot", "grown_shard")
KEYS = ("_hs_hash", "_hs_id", "_hs_size", "_hs_at", "_hs_range", "_hs_first")
BITS = 16


def order_key(docs: DataFrame) -> DataFrame:
    """docs with the order's two parts and the size."""
    text = text_or_empty()
    return docs.withColumns({"_hs_hash": F.xxhash64(text), "_hs_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_hs_size": F.octet_length(text).cast("long") + 1})


def at_or_above(splitter: tuple[int, int]) -> Column:
    high, low = splitter
    return (F.col("_hs_hash") > high) | ((F.col("_hs_hash") == high) & (F.col("_hs_id") >= low))


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """shards - 1 boundaries (hash, id); a row belongs above those that are not greater. rows: cut, read in each round."""
    total = rows.agg(F.sum("_hs_size")).first()[0]
    if not total:
        return []
    miss = tolerance * total / shards
    lowest = -(2**63)
    # A state a target: bytes below the interval, and the interval as (column, its prefix of fixed high bits).
    states = [{"target": total * k / shards, "below": 0, "fixed": [], "hash": None, "best": (0, (lowest, lowest))} for k in range(1, shards)]
    open_ = states
    for round_ in range(2 * 64 // BITS):
        in_hash = round_ < 64 // BITS
        column, shift = ("_hs_hash" if in_hash else "_hs_id"), 64 - BITS * (round_ % (64 // BITS) + 1)
        intervals = {(s["hash"], tuple(s["fixed"])) for s in open_}
        within = None
        for hashed, fixed in intervals:
            c = F.lit(True) if hashed is None else F.col("_hs_hash") == hashed
            if fixed:
                c = c & (F.shiftright(F.col(column), shift + BITS) == fixed[-1])
            within = c if within is None else within | c
        cells = (
            rows.where(within)
            .groupBy((F.col("_hs_hash") if not in_hash else F.lit(None).cast("long")).alias("h"), F.shiftright(F.col(column), shift).alias("cell"))
            .agg(F.sum("_hs_size").alias("bytes"))
            .collect()
        )
        found: dict = {}
        for r in cells:
            found.setdefault((r["h"], r["cell"] >> BITS if round_ % (64 // BITS) else None), []).append((r["cell"], r["bytes"]))
        for s in open_:
            below = s["below"]
            for cell, size in sorted(found[(s["hash"], s["fixed"][-1] if s["fixed"] else None)]):
                edge = (cell << shift, lowest) if in_hash else (s["hash"], cell << shift)
                if abs(below - s["target"]) < abs(s["best"][0] - s["target"]):
                    s["best"] = (below, edge)
                if below + size > s["target"]:
                    s["below"], s["fixed"] = below, [*s["fixed"], cell]
                    after = cell + 1 << shift
                    edge = (after, lowest) if in_hash else (s["hash"], after)
                    if abs(below + size - s["target"]) < abs(s["best"][0] - s["target"]) and after < 2**63:
                        s["best"] = (below + size, edge)
                    break
                below += size
        open_ = [s for s in open_ if abs(s["best"][0] - s["target"]) > miss]
        if not open_:
            break
        if round_ == 64 // BITS - 1:  # one group of equal texts holds the target: go on by doc_id inside it
            for s in open_:
                s["hash"], s["fixed"] = s["fixed"][-1], []
    return sorted(s["best"][1] for s in states)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents, exchanged once, with size, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    keyed = order_key(aside(docs, [*MADE, *KEYS]))
    rows = cut(keyed.select("_hs_hash", "_hs_id", "_hs_size"), "order")
    edges = splitters(rows, shards, tolerance)
    place = sum([at_or_above(e).cast("int") for e in edges], F.lit(0))
    total = rows.agg(F.sum("_hs_size")).first()[0] or 0
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // CELL_BYTES)
    order = ["_hs_hash", "_hs_id", "_hs_size"]
    # Written once, so that the ranges and the places in them are the same for all who read. A place is the range << 33 | a number in it.
    sorted_ = cut(keyed.withColumn("shard", place).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order).withColumn("_hs_at", F.monotonically_increasing_id()), "shards")
    by_range = sorted_.withColumn("_hs_range", F.shiftright("_hs_at", 33))
    # A row for each range, and one more for each boundary between shards.
    before, offsets = {}, []
    for r in sorted(by_range.groupBy("shard", "_hs_range").agg(F.min("_hs_at").alias("at"), F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["shard"], r["_hs_range"], r["at"] - before.get(r["shard"], 0)))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    starts = spark.createDataFrame(offsets, "shard int, _hs_range long, _hs_first long")
    placed = by_range.join(F.broadcast(starts), ["shard", "_hs_range"])
    made = {"size": F.col("_hs_size"), "law": F.lit("bytes"), "slot": F.col("_hs_at") - F.col("_hs_first"), "grown_shard": F.lit(None).cast("int")}
    return placed.withColumns(made).drop(*KEYS)
