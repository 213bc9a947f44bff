"""One-to-one matching of two reports in set form.

Taking, left by left in order, the first right row of the same key that is not yet used is the same as pairing the k-th left with
the k-th right row of a key. So a stage is an equi-join on (key, rank), and the cascade is a chain of such joins, each on
what the stages before left over. `left` and `right` have idx, name, file, line_start, enclosing_type and what a stage asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, meet
from ..functions import scalar

#: Order of the stages and their names in results.
STAGES = ("Mapping", "FfiAttribute", "ExactName", "Normalized", "Fingerprint")
#: Positions of a report that are ranked together; a key that all of them share is still ranked in parts of this size.
STRETCH = 1_000_000

PAIR = ["left_idx", "right_idx"]


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """`_rank` from 1 of each row within its key by idx: local ranks plus what the stretches of the report before hold."""
    parts = rows.withColumn("_part", F.floor(F.col("idx") / STRETCH).cast("long"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(key, "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy(key, "_part").orderBy("idx")
    return meet(parts.withColumn("_own", F.row_number().over(own)), counts, [key, "_part"]).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def zip_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Pairs (left_idx, right_idx): k-th with k-th row of each key; null keys pair with nothing."""
    side = lambda rows, key, name: ranked(rows.select("idx", key.alias("_key")).where("_key is not null"), "_key").select("_key", "_rank", F.col("idx").alias(name))
    return meet(side(left, left_key, "left_idx"), side(right, right_key, "right_idx"), ["_key", "_rank"]).select(*PAIR)


def match_ffi(left: DataFrame, right: DataFrame) -> DataFrame:
    return zip_join(left, right, F.col("original_name"), F.col("name"))


def match_normalized(left: DataFrame, right: DataFrame) -> DataFrame:
    key = scalar.normalize_name(F.col("name"))
    return zip_join(left, right, key, key)


def match_exact(left: DataFrame, right: DataFrame, all_right: DataFrame | None = None) -> DataFrame:
    """At most one pair a name: the first left row, and the last right row of all, if it is still free."""
    last = (right if all_right is None else all_right).groupBy("name").agg(F.max("idx").alias("right_idx"))
    free = right.select(F.col("idx").alias("right_idx"))
    first = left.groupBy("name").agg(F.min("idx").alias("left_idx"))
    return meet(meet(first, last, "name"), free, "right_idx", "left_semi").select(*PAIR)


def match_fingerprint(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same arity, outputs and size class, and a name token of four bytes or more in common; greedy inside a block of equal
    fingerprints, blocks in parallel. Rows that share no token with the other side are left out before."""
    shape = [F.col("arity").alias("_a"), F.col("outputs_count").alias("_o"), scalar.bucket_log(F.col("loc_code")).alias("_b")]
    side = lambda rows: rows.select(*shape, "idx", F.array_distinct(scalar.name_tokens(F.col("name"))).alias("tokens"))
    block = ["_a", "_o", "_b"]

    def greedy(a, b):
        import pandas as pd

        holders: dict[str, list[int]] = {}
        b = b.sort_values("idx")
        for idx, tokens in zip(b["idx"].tolist(), b["tokens"]):
            for t in tokens:
                if len(t.encode()) >= 4:
                    holders.setdefault(t, []).append(idx)
        used, at, out = set(), dict.fromkeys(holders, 0), []
        a = a.sort_values("idx")
        for idx, tokens in zip(a["idx"].tolist(), a["tokens"]):
            best = None
            for t in tokens:
                if t in holders:
                    own = holders[t]
                    while at[t] < len(own) and own[at[t]] in used:
                        at[t] += 1
                    if at[t] < len(own) and (best is None or own[at[t]] < best):
                        best = own[at[t]]
            if best is not None:
                used.add(best)
                out.append((idx, best))
        return pd.DataFrame(out, columns=PAIR).astype("int64")

    tokens = lambda rows: side(rows).select(*block, F.explode(F.filter("tokens", lambda t: F.octet_length(t) >= 4)).alias("t")).distinct()
    near = lambda rows, other: meet(side(rows), meet(side(rows).select(*block, "idx", F.explode("tokens").alias("t")), tokens(other), [*block, "t"], "left_semi").select("idx").distinct(), "idx", "left_semi")
    return near(left, right).groupBy(*block).cogroup(near(right, left).groupBy(*block)).applyInPandas(greedy, "left_idx long, right_idx long")


def mapping_frame(spark, entries: list[dict]) -> DataFrame:
    """The rule table in its order; a user's list, so small."""
    names = ["left", "right", "left_path", "right_path", "left_line", "right_line", "left_class", "right_class"]
    kinds = ["string"] * 4 + ["int"] * 2 + ["string"] * 2
    rows = [(i, *[e.get(n) for n in names]) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "entry_idx int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def match_mapping(left: DataFrame, right: DataFrame, entries: list[dict]) -> DataFrame:
    """For each entry in order the first free row of either side that fits it, used up only if both sides have one.

    Rows that fit an entry are found by a broadcast join with the rule table; only as many of them for an entry come to the driver as
    there are entries, since no more can be used before it.
    """
    spark = left.sparkSession
    if not entries:
        return spark.createDataFrame([], "entry_idx int, left_idx long, right_idx long")
    table = F.broadcast(mapping_frame(spark, entries))

    def fitting(rows: DataFrame, side: str) -> dict[int, list[int]]:
        fits = scalar.path_suffix_matches(F.col("file"), F.col(f"{side}_path")) & scalar.line_matches(F.col("line_start"), F.col(f"{side}_line")) & scalar.class_matches(F.col("enclosing_type"), F.col(f"{side}_class"))
        found = rows.join(table, F.col("name") == F.col(side)).where(fits).select("entry_idx", "idx")
        rank = F.row_number().over(Window.partitionBy("entry_idx").orderBy("idx"))
        out: dict[int, list[int]] = {}
        for r in found.withColumn("_r", rank).where(F.col("_r") <= len(entries)).orderBy("entry_idx", "idx").collect():
            out.setdefault(r["entry_idx"], []).append(r["idx"])
        return out

    lefts, rights = fitting(left, "left"), fitting(right, "right")
    used_left, used_right, pairs = set(), set(), []
    for i in range(len(entries)):
        a = next((x for x in lefts.get(i, ()) if x not in used_left), None)
        b = next((x for x in rights.get(i, ()) if x not in used_right), None)
        if a is not None and b is not None:
            used_left.add(a)
            used_right.add(b)
            pairs.append((i, a, b))
    return spark.createDataFrame(pairs, "entry_idx int, left_idx long, right_idx long")


def match(left: DataFrame, right: DataFrame, entries: list[dict] | None = None, stages=STAGES) -> DataFrame:
    """The cascade: pair_idx, left_idx, right_idx, strategy. A stage sees what the ones before it left; pairs are in stage order,
    then in that of the mapping's entries or the left rows."""
    done: list[DataFrame] = []

    def free(rows: DataFrame, side: str) -> DataFrame:
        used = [d.select(F.col(f"{side}_idx").alias("idx")) for d in done]
        return meet(rows, reduce(DataFrame.unionAll, used), "idx", "left_anti") if used else rows

    for k, stage in enumerate(STAGES):
        if stage not in stages:
            continue
        a, b = free(left, "left"), free(right, "right")
        if stage == "Mapping":
            if not entries:
                continue
            pairs = match_mapping(a, b, entries).withColumnRenamed("entry_idx", "_order")
        else:
            found = match_exact(a, b, right) if stage == "ExactName" else {"FfiAttribute": match_ffi, "Normalized": match_normalized, "Fingerprint": match_fingerprint}[stage](a, b)
            pairs = found.withColumn("_order", F.col("left_idx"))
        done.append(pairs.select(F.lit(k).alias("_stage"), F.col("_order").cast("long").alias("_order"), *[F.col(c).cast("long").alias(c) for c in PAIR], F.lit(stage).alias("strategy")))
        done[-1] = cut(done[-1])  # the next stages read what is used up rather than match anew
    if not done:
        return left.sparkSession.createDataFrame([], "pair_idx long, left_idx long, right_idx long, strategy string")
    return numbered(reduce(DataFrame.unionAll, done), ["_stage", "_order"], "pair_idx").select("pair_idx", *PAIR, "strategy")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Positions from 0 by `order`, whose last column is a number: ranks in stretches plus what comes before them."""
    first, last = order[:-1], order[-1]
    parts = rows.withColumn("_part", F.floor(F.col(last) / STRETCH).cast("long"))
    before = Window.orderBy(*first, "_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each million positions
    counts = parts.groupBy(*first, "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy(*first, "_part").orderBy(last)
    return parts.withColumn("_own", F.row_number().over(own)).join(F.broadcast(counts), [*first, "_part"]).withColumn(name, (F.col("_own") + F.col("_before") - 1).cast("long")).drop("_own", "_before", "_part")


def match_structs(left: DataFrame, right: DataFrame, entries: list[dict] | None = None) -> DataFrame:
    """Mapping by names alone, then ExactName, then Normalized."""
    blank = [F.lit(None).cast("string").alias(c) for c in ("file", "enclosing_type")] + [F.lit(None).cast("int").alias("line_start")]
    bare = [{"left": e["left"], "right": e["right"]} for e in entries or ()]
    return match(left.select("idx", "name", *blank), right.select("idx", "name", *blank), bare, ("Mapping", "ExactName", "Normalized"))


def paired(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with both sides' columns as l_* and r_*."""
    side = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    a, b = side(left, "l"), side(right, "r")
    return meet(meet(pairs, a, F.col("left_idx") == F.col("l_idx")), b, F.col("right_idx") == F.col("r_idx")).drop("l_idx", "r_idx")
