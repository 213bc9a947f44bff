"""Call graphs: edges, recursion groups, bottom-up order, callers, differences.

`calls` is a row a function and distinct callee (idx, callee); vertices have idx, name, file, line_start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import meet
from .comparing import ranked_by

#: Functions of one name that meet its calls in one piece; more of them are dealt to several pieces.
NAMESAKES = 1_000

def call_rows(functions: DataFrame) -> DataFrame:
    return functions.select("idx", F.explode("calls.callee").alias("callee")).distinct()


def resolved(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls with n_candidates: how many functions have the callee's name."""
    names = functions.groupBy("name").agg(F.count(F.lit(1)).alias("n_candidates"))
    return meet(calls, names, F.col("callee") == F.col("name"), "left").select("idx", "callee", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def edges(calls: DataFrame, functions: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct (src, dst). A callee with several candidates gives an edge to each, or none if strict.

    There are as many edges as calls times namesakes, so they are not exchanged to be made distinct: a function has one name, so calls
    and functions without repeats give edges without repeats. Functions of a common name are dealt to blocks that each meet all of
    its calls, so one name is no one task's work, and what moves grows with calls and functions.
    """
    calls = calls.select("idx", "callee").where("callee is not null").distinct()
    named = functions.select("name", "idx").where("name is not null").distinct()
    counted = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("dst"))
    if strict:
        return meet(calls, counted.where("n = 1").select(F.col("name").alias("callee"), "dst"), "callee").select(F.col("idx").alias("src"), "dst")
    common = counted.where(F.col("n") > NAMESAKES).select("name", F.ceil(F.col("n") / NAMESAKES).cast("int").alias("_blocks"))  # so few that they are broadcast
    common, one = F.broadcast(common), F.coalesce("_blocks", F.lit(1))
    targets = named.join(common, "name", "left").select(F.col("name").alias("callee"), F.pmod(F.xxhash64("idx"), one).cast("int").alias("_block"), F.col("idx").alias("dst"))
    wanted = calls.join(common, F.col("callee") == F.col("name"), "left").select(F.col("idx").alias("src"), "callee", F.explode(F.sequence(F.lit(0), one - 1)).alias("_block"))
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is kept: by its small input Spark would make few tasks of this join
    dealt = lambda rows: rows.repartition(n, "callee", "_block")
    blocks = dealt(targets).groupBy("callee", "_block").agg(F.collect_list("dst").alias("_dst"))
    return meet(dealt(wanted), blocks, ["callee", "_block"]).select("src", F.explode("_dst").alias("dst"))


def resolution_counts(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Call sites by (function, distinct callee): resolved to one, ambiguous, unresolved."""
    n = F.col("n_candidates")
    return resolved(calls, functions).agg(F.count_if(n == 1).alias("resolved"), F.count_if(n > 1).alias("ambiguous"), F.count_if(n == 0).alias("unresolved"))


def self_recursive(graph: DataFrame) -> DataFrame:
    return graph.where("src = dst").select(F.col("src").alias("idx")).distinct()


def completed(n: int, start, near):
    """Tarjan's components of vertices 0 to n - 1, whose neighbours stand in near[start[v]:start[v + 1]]: for each vertex how many complete
    in components before its own (callees come before callers), and the size of its component. Numbers of four bytes, no recursion."""
    from array import array

    zeros = lambda: array("i", bytes(4 * n))
    number, low, first, size, at = zeros(), zeros(), zeros(), zeros(), array("q", start)
    closed, stack, path, count, done = bytearray(n), array("i"), array("i"), 0, 0
    for root in range(n):
        if number[root]:
            continue
        v, opened = root, True
        while True:
            if opened:
                count += 1
                number[v] = low[v] = count
                stack.append(v)
                opened = False
            if at[v] < start[v + 1]:
                w = near[at[v]]
                at[v] += 1
                if not number[w]:
                    path.append(v)
                    v, opened = w, True
                elif not closed[w] and number[w] < low[v]:
                    low[v] = number[w]
                continue
            if low[v] == number[v]:
                k = len(stack) - 1
                while stack[k] != v:
                    k -= 1
                group = stack[k:]
                del stack[k:]
                for w in group:
                    closed[w], first[w], size[w] = 1, done, len(group)
                done += len(group)
            if not path:
                break
            u = path.pop()
            low[u] = min(low[u], low[v])
            v = u
    return first, size


RECURSION = "report_id string, idx long, first long, scc_id long, scc_size long"


def recursion(vertices: DataFrame, graph: DataFrame) -> DataFrame:
    """report_id, idx, first (how many vertices complete in groups before), scc_id (dense over recursive groups, else null), scc_size,
    scc_kind (none, self, mutual).

    The order in which a depth-first search completes has no parallel form, so one report's graph is a task's work; reports run side by
    side. The task gets numbers only and holds some 100 bytes a vertex or edge. For a graph beyond one task use scc_distributed.
    """

    def run(key, v, e):
        import numpy as np
        import pyarrow as pa

        report, names = v.column("report_id").slice(0, 1).to_pylist(), [c.split()[0] for c in RECURSION.split(", ")]
        ids = np.unique(v.column("idx").to_numpy())
        del v
        n = len(ids)
        src, dst = (e.column(c).to_numpy() for c in ("src", "dst"))
        del e
        if not n:
            return pa.table({c: pa.array([], pa.string() if c == "report_id" else pa.int64()) for c in names})

        def place(x):
            at = np.minimum(np.searchsorted(ids, x), n - 1).astype("i4")
            return at, ids[at] == x

        (src, a), (dst, b) = place(src), place(dst)
        src, dst = src[a & b], dst[a & b]
        by = np.lexsort((dst, src))
        src, dst = src[by], dst[by]
        del a, b, by
        start = np.searchsorted(src, np.arange(n + 1, dtype="i4"))
        first, size = (np.frombuffer(x, "i4") for x in completed(n, memoryview(start.astype("i8")), memoryview(np.ascontiguousarray(dst))))
        again = size > 1
        again[src[src == dst]] = True
        own = np.searchsorted(np.unique(first[again]), first) + 1
        made = [pa.array(report).take(pa.array(np.zeros(n, "i4"))), pa.array(ids), pa.array(first, pa.int64()), pa.array(own, pa.int64(), mask=~again), pa.array(size, pa.int64())]
        return pa.Table.from_batches(pa.table(made, names).to_batches(1 << 17))

    numbers = vertices.select("report_id", F.col("idx").cast("long").alias("idx")), graph.select("report_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    found = numbers[0].groupBy("report_id").cogroup(numbers[1].groupBy("report_id")).applyInArrow(run, RECURSION)
    return found.withColumn("scc_kind", F.when(F.col("scc_id").isNull(), "none").when(F.col("scc_size") > 1, "mutual").otherwise("self"))


def bottom_up(vertices: DataFrame, graph: DataFrame) -> DataFrame:
    """pos, scc_id (dense over recursive groups, else null), scc_kind (none, self, mutual), scc_size for each vertex of each report.

    vertices: report_id, idx, name, file, line_start; graph: report_id, src, dst. Members of a group stand by file, line, name and number.
    """
    rows = meet(recursion(vertices, graph), vertices.select("report_id", "idx", "file", "line_start", "name"), ["report_id", "idx"])
    blank = [F.coalesce("file", F.lit("")), F.coalesce("line_start", F.lit(0)), F.coalesce("name", F.lit(""))]
    own = F.row_number().over(Window.partitionBy("report_id", "first").orderBy(*blank, "idx"))
    return rows.select("report_id", "idx", (F.col("first") + own - 1).cast("long").alias("pos"), "scc_id", "scc_kind", "scc_size")


#: A front of so many pairs at most is broadcast (a few MB); a larger one is shuffled.
FRONT = 200_000
#: Written rounds that a closure reads one by one before they are written as one.
ROUNDS = 8


def reachable(graph: DataFrame, seeds: DataFrame, cut) -> DataFrame:
    """Pairs (seed, idx): everything that edges lead to from each seed, the seed itself only if it lies on a cycle.

    Semi-naive: each round joins the newest pairs to the edges and drops known ones, until none is new. `cut` writes a frame to the
    shared folder and reads it back, so lineage stays short and no round depends on one executor's disk.
    """
    near = graph.select("src", "dst")

    def step(front: DataFrame, n: int) -> DataFrame:
        rows = near.join(F.broadcast(front), F.col("src") == F.col("idx")) if n <= FRONT else meet(near, front, F.col("src") == F.col("idx"))
        return rows.select("seed", F.col("dst").alias("idx")).distinct()

    first = seeds.select(F.col("idx").alias("seed"), "idx")
    parts = [front := cut(step(first, first.count()))]
    while n := front.count():
        if len(parts) > ROUNDS:
            parts = [cut(reduce(DataFrame.unionAll, parts))]
        parts.append(front := cut(meet(step(front, n), reduce(DataFrame.unionAll, parts), ["seed", "idx"], "left_anti")))
    return reduce(DataFrame.unionAll, parts)


def callers(graph: DataFrame, seeds: DataFrame, cut) -> DataFrame:
    """Transitive callers of each seed."""
    return reachable(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, cut)


def trimmed(live: DataFrame, open_: DataFrame, cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges whose ends have both callers and callees, until none goes; the vertices that are left out, each a component of its
    own (idx, colour), and those that stay."""
    n = live.count()
    while n:
        ends = meet(live.select(F.col("src").alias("idx")).distinct(), live.select(F.col("dst").alias("idx")), "idx", "left_semi")
        live = cut(between(live, ends))
        n, before = live.count(), n
        if n == before:
            break
    stay = live.select(F.col("src").alias("idx")).distinct()
    return live, cut(meet(open_, stay, "idx", "left_anti").select("idx", F.col("idx").alias("colour"))), cut(meet(open_, stay, "idx", "left_semi"))


def between(live: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges with both ends among kept (idx)."""
    end = lambda name: kept.select(F.col("idx").alias(name))
    return meet(meet(live, end("src"), "src", "left_semi"), end("dst"), "dst", "left_semi").select("src", "dst")


def scc_distributed(vertices: DataFrame, graph: DataFrame, cut) -> DataFrame:
    """idx, scc (smallest member) by mutual reachability with forward and backward labels; any number of vertices, no grouped task.

    Each round every vertex still open takes the largest vertex that reaches it as its colour; within a colour, what reaches the
    colour's root is the root's component and is closed. Vertices that lie on no cycle go before, by what calls or is called by nothing.
    """
    open_ = cut(vertices.select("idx"))
    live = cut(graph.where("src <> dst").distinct())
    closed = []
    while True:
        live, alone, open_ = trimmed(live, open_, cut)
        closed.append(alone)
        if not open_.head(1):
            break
        colour = cut(open_.select("idx", F.col("idx").alias("colour")))
        while True:
            pushed = meet(live, colour, F.col("src") == F.col("idx")).groupBy("dst").agg(F.max("colour").alias("_c"))
            new = cut(meet(colour, pushed, F.col("idx") == F.col("dst"), "left").select("idx", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") > F.col("colour")).alias("_new")))
            colour = new.select("idx", "colour")
            if not new.where("_new").head(1):
                break
        inside = meet(meet(live, colour, F.col("src") == F.col("idx")).select("src", "dst", "colour"), colour.select(F.col("idx").alias("dst"), "colour"), ["dst", "colour"])
        back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "colour"))
        front = group = cut(colour.where("idx = colour"))
        parts = [group]
        while front.head(1):
            known = reduce(DataFrame.unionAll, parts)
            called = meet(front, back.select(F.col("src").alias("idx"), "dst", "colour"), ["idx", "colour"]).select(F.col("dst").alias("idx"), "colour").distinct()
            front = cut(meet(called, known, ["idx", "colour"], "left_anti"))
            parts.append(front)
        done = cut(reduce(DataFrame.unionAll, parts))
        closed.append(done)
        open_ = cut(meet(open_, done, "idx", "left_anti"))
        live = cut(between(live, open_))
    members = reduce(DataFrame.unionAll, closed)
    return members.withColumn("scc", F.min("idx").over(Window.partitionBy("colour"))).select("idx", "scc")


def levels(graph: DataFrame, vertices: DataFrame, cut) -> DataFrame:
    """idx, level: longest path to a leaf in a graph without cycles, itself a valid bottom-up order."""
    found = level = cut(vertices.select("idx", F.lit(0).alias("level")))
    while True:
        raised = cut(meet(graph, level, F.col("dst") == F.col("idx")).groupBy("src").agg((F.max("level") + 1).alias("level")))
        if not raised.head(1):
            return found.groupBy("idx").agg(F.max("level").alias("level"))
        level = raised.select(F.col("src").alias("idx"), "level")
        found = cut(found.unionAll(level).groupBy("idx").agg(F.max("level").alias("level")))


def translated(graph: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Edges between pairs: both ends matched."""
    end = lambda name: pairs.select(F.col(f"{side}_idx").alias(name), F.col("pair_idx").alias(f"{name}_pair"))
    return meet(meet(graph, end("src"), "src"), end("dst"), "dst").select("src_pair", "dst_pair").distinct()


def edge_diff(left_edges: DataFrame, right_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    on = ["src_pair", "dst_pair"]
    return meet(left_edges, right_edges, on, "left_anti"), meet(right_edges, left_edges, on, "left_anti")


def graph_diff(pairs: DataFrame, left_edges: DataFrame, right_edges: DataFrame, left_scc: DataFrame, right_scc: DataFrame) -> DataFrame:
    """A row a pair: neighbours on either side as pairs, those on one side only, recursion kinds and sizes, total.

    *_edges: src_pair, dst_pair; *_scc: idx, scc_kind, scc_size.
    """

    def near(frame, name):
        by = lambda end, other, what: frame.groupBy(F.col(end).alias("pair_idx")).agg(F.array_sort(F.collect_set(other)).alias(f"{name}_{what}"))
        return by("dst_pair", "src_pair", "callers"), by("src_pair", "dst_pair", "callees")

    rows = pairs
    for frame, name in ((left_edges, "left"), (right_edges, "right")):
        for part in near(frame, name):
            rows = meet(rows, part, "pair_idx", "left")
    for frame, name in ((left_scc, "left"), (right_scc, "right")):
        rows = meet(rows, frame.select(F.col("idx").alias(f"{name}_idx"), F.col("scc_kind").alias(f"{name}_recursive_kind"), F.col("scc_size").alias(f"{name}_scc_size")), f"{name}_idx", "left")
    empty = F.array().cast("array<bigint>")
    lists = [f"{s}_{w}" for s in ("left", "right") for w in ("callers", "callees")]
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("array<bigint>"), empty) for c in lists})
    for w in ("callers", "callees"):
        rows = rows.withColumn(f"only_in_left_{w}", F.array_sort(F.array_except(f"left_{w}", f"right_{w}"))).withColumn(f"only_in_right_{w}", F.array_sort(F.array_except(f"right_{w}", f"left_{w}")))
    changed = sum([F.size(f"only_in_{s}_{w}") for s in ("left", "right") for w in ("callers", "callees")], F.lit(0))
    kind = F.when(F.col("left_recursive_kind") != F.col("right_recursive_kind"), 2.0).otherwise(0.0)
    return rows.withColumn("total", changed + kind + 0.5 * F.abs(F.col("left_scc_size") - F.col("right_scc_size")))


def diff_summary(diff: DataFrame, left_edges: DataFrame, right_edges: DataFrame) -> DataFrame:
    only_left, only_right = edge_diff(left_edges, right_edges)
    n = lambda frame, name: frame.agg(F.count(F.lit(1)).alias(name))
    counts = diff.agg(
        F.count(F.lit(1)).alias("matched_pairs"), F.count_if(F.col("left_recursive_kind") != F.col("right_recursive_kind")).alias("recursive_kind_mismatches"),
        F.count_if(F.col("left_scc_size") != F.col("right_scc_size")).alias("scc_size_mismatches"),
    )
    for frame, name in ((left_edges, "translated_edges_in_left"), (right_edges, "translated_edges_in_right"), (only_left, "edges_only_in_left"), (only_right, "edges_only_in_right")):
        counts = counts.join(F.broadcast(n(frame, name)))  # one row each
    return counts


# Texts of warnings.
NO_COUNTERPART = "no counterpart exists in the 1:1 pairing table"
NOT_LEFT = "mapped counterpart is not upstream on the Rust side"
NOT_RIGHT = "mapped counterpart is not upstream on the original-code side"


def upstream_pairs(pairs: DataFrame, deviations: DataFrame, left_up: DataFrame, right_up: DataFrame) -> DataFrame:
    """Pairs with an end among the callers of the seeds: flags, overlap, total. *_up: idx."""
    flag = lambda frame, side: frame.select(F.col("idx").alias(f"{side}_idx"), F.lit(True).alias(f"{side}_in_upstream")).distinct()
    rows = meet(meet(pairs, flag(left_up, "left"), "left_idx", "left"), flag(right_up, "right"), "right_idx", "left").na.fill(False, ["left_in_upstream", "right_in_upstream"])
    rows = rows.where("left_in_upstream or right_in_upstream").withColumn("overlap", F.col("left_in_upstream") & F.col("right_in_upstream"))
    return meet(rows, deviations.select("pair_idx", "total"), "pair_idx")


def upstream_warnings(rows: DataFrame, pairs: DataFrame, left_up: DataFrame, right_up: DataFrame) -> DataFrame:
    """side, idx, counterpart, message: callers whose counterpart is missing or not a caller. rows: upstream_pairs."""
    one = lambda cond, side, other, text: rows.where(cond).select(F.lit(side).alias("side"), F.col(f"{side}_idx").alias("idx"), F.col(f"{other}_idx").alias("counterpart"), F.lit(text).alias("message"))
    alone = lambda up, side: meet(up, pairs.select(F.col(f"{side}_idx").alias("idx")), "idx", "left_anti").select(F.lit(side).alias("side"), "idx", F.lit(None).cast("long").alias("counterpart"), F.lit(NO_COUNTERPART).alias("message"))
    parts = [one("left_in_upstream and not right_in_upstream", "left", "right", NOT_RIGHT), one("right_in_upstream and not left_in_upstream", "right", "left", NOT_LEFT), alone(left_up, "left"), alone(right_up, "right")]
    return reduce(DataFrame.unionByName, parts)


def select_seed(functions: DataFrame, side: str, name=None, path=None, line=None, cls=None) -> DataFrame:
    """The one function that fits all that is given; an error names the first few if none or several fit."""
    from ..functions import scalar

    lit = lambda x, kind="string": F.lit(x).cast(kind)
    fits = scalar.path_suffix_matches(F.col("file"), lit(path)) & scalar.line_matches(F.col("line_start"), lit(line, "int")) & scalar.class_matches(F.col("enclosing_type"), lit(cls))
    found = functions.where(fits if name is None else fits & (F.col("name") == name))
    first = found.select("name", "file", "line_start").limit(6).collect()
    if len(first) != 1:
        raise ValueError(f"{side} seed fits {'no function' if not first else 'several functions: ' + ', '.join(f'{r[0]} ({r[1]}:{r[2]})' for r in first[:5])}")
    return found


def top_diff(diff: DataFrame, top: int | None = 20) -> DataFrame:
    return ranked_by(diff, "total", "pair_idx", top)
