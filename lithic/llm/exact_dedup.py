"""Operator 6: exact dedup by deterministic block naming, in DataFrame functions only.

Texts are equal when they are after their blanks are deleted. A first pass over all rows counts (hash, length) of the normalised
texts; rows that share neither with any other row differ from all and need no name. The others are cut into fixed-size blocks;
the distinct blocks are sorted and numbered, and adjacent pairs of numbers are sorted and numbered again until each document has
one number. Two documents get the same number on the same level only if their texts are the same: no hash decides equality.
Numbers are written before they are used, so that a task run again cannot number anew.

Only distinct blocks and pairs are sorted, after partial aggregation; a block that a third of all documents share is one row
there, and its copies meet it in a plain equi-join, whose large partitions Spark splits. Large groups meet
their rows by a broadcast of bounded size (`common.met`), the others by a join. No group is collected, and no join whose sides grow with the
input is broadcast.

Cases: null text counts as empty, and all empty texts are one group; ties in length go to the smallest doc_id (null first), rows
alike in every respect keep one of them; an empty table gives no row; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, met, text_or_empty

#: Code points in a block.
BLOCK = 2048
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without `[\\x20\\x09-\\x0D]`."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, text)


def named(values: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct rows of `values`, sorted and numbered; written at once. A hash comes first in their order, so that what is sampled to part
    the range is numbers, not blocks."""
    order = [F.xxhash64(*columns), *columns]
    ordered = values.select(*columns).distinct().repartitionByRange(order[0]).sortWithinPartitions(*order)
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()), "names")


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """`_xd_row`, `_xd_level`, `_xd_name`: equal for two rows exactly if their `_xd_text` is. texts: `_xd_row`, `_xd_text`."""
    blocks = F.regexp_extract_all("_xd_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    whole = F.when(F.col("_xd_text") == "", F.array(F.lit(""))).otherwise(blocks)
    parts = texts.select("_xd_row", F.posexplode(whole).alias("_xd_at", "_xd_block"), F.size(whole).alias("_xd_n"))
    names = named(parts, ["_xd_block"], "_xd_name")
    level = cut(parts.join(names.hint("merge"), "_xd_block").select("_xd_row", "_xd_at", "_xd_n", "_xd_name"), "level")
    longest = level.agg(F.max("_xd_n")).first()[0] or 0
    done, depth = [level.where("_xd_n = 1").select("_xd_row", F.lit(0).alias("_xd_level"), "_xd_name")], 0
    while longest > 1:
        depth += 1
        pairs = (
            level.where("_xd_n > 1")
            .groupBy("_xd_row", F.expr("_xd_at div 2").cast("int").alias("_xd_at"), F.expr("(_xd_n + 1) div 2").cast("int").alias("_xd_n"))
            .agg(F.max(F.when(F.col("_xd_at") % 2 == 0, F.col("_xd_name"))).alias("_xd_left"), F.max(F.when(F.col("_xd_at") % 2 == 1, F.col("_xd_name"))).alias("_xd_right"))
            .fillna(-1, ["_xd_right"])
        )
        names = named(pairs, ["_xd_left", "_xd_right"], "_xd_name")
        level = cut(pairs.join(names.hint("merge"), ["_xd_left", "_xd_right"]).select("_xd_row", "_xd_at", "_xd_n", "_xd_name"), "level")
        done.append(level.where("_xd_n = 1").select("_xd_row", F.lit(depth).alias("_xd_level"), "_xd_name"))
        longest = (longest + 1) // 2
    return reduce(DataFrame.unionAll, done)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_xd_text` (normalised), its digest and size, and a row key that is the same in every reading."""
    text = text_or_empty()
    wide = docs.withColumn("_xd_text", normalised(text)).withColumns({"_xd_sha": F.sha2("_xd_text", 256), "_xd_chars": F.length(text), "_xd_hash": F.xxhash64("_xd_text"), "_xd_size": F.octet_length("_xd_text")})
    return wide.withColumn("_xd_row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_xd_chars", "_xd_sha"))


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256 and `_xd_row`."""
    rows = keyed(docs.select("doc_id", "text"))
    base = cut(rows.drop("text", "_xd_text").withColumn("_xd_n", F.monotonically_increasing_id()), "exact-base")
    shared = cut(base.groupBy("_xd_hash", "_xd_size").count().where("count > 1").select("_xd_hash", "_xd_size"), "exact-shared")
    # Copies of one row need a name once; the texts are read again for rows that share hash and size alone.
    alike = rows.select("_xd_row", "_xd_text", "_xd_hash", "_xd_size").join(shared.hint("merge"), ["_xd_hash", "_xd_size"], "left_semi").select("_xd_row", "_xd_text")
    found = identities(cut(alike, "exact-alike"), block).dropDuplicates(["_xd_row"])
    known = cut(base.join(found.hint("merge"), "_xd_row", "left"), "exact-known")
    first = F.min(F.struct((-F.col("_xd_chars")).alias("chars"), F.col("doc_id").alias("doc_id"), F.col("_xd_n").alias("n")))
    name = ["_xd_level", "_xd_name"]
    kept = cut(known.where("_xd_name is not null").groupBy(*name).agg(F.count(F.lit(1)).alias("_xd_group"), first.alias("_xd_first")), "exact-groups")
    digest = [F.col("_xd_sha").alias("text_sha256"), "_xd_row"]
    # Rows without a name are alone and need no join; as null keys they would all meet in one task.
    alone = known.where("_xd_name is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *digest)
    named_ = known.where("_xd_name is not null")
    grouped = met(named_, kept, name, "_xd_group", known.count())
    return alone.unionAll(grouped.select("doc_id", F.col("_xd_first.doc_id").alias("keep_id"), F.col("_xd_group").alias("group_size"), (F.col("_xd_first.n") == F.col("_xd_n")).alias("kept"), *digest))


def dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents with one row of each group of equal texts."""
    kept = groups(docs, block).where("kept").select("_xd_row")
    made = ["_xd_text", "_xd_sha", "_xd_chars", "_xd_hash", "_xd_size", "_xd_row"]
    found = keyed(aside(docs, made)).join(kept.hint("merge"), "_xd_row", "left_semi").dropDuplicates(["_xd_row"]).drop(*made)
    return found.toDF(*docs.columns)
