"""Operators on small tables, and set forms against sequential ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lithic import model
from lithic.common import cut
from lithic.functions import scalar
from lithic.operators import callgraph, comparing, extraction, matching, prediction
from lithic.sources import files, tables

from .test_parse import HERE

COLUMNS = "idx long, name string, original_name string, file string, line_start int, enclosing_type string, arity int, outputs_count int, loc_code double"


def side(spark, rows):
    full = [(i, r.get("name"), r.get("original"), r.get("file", "src/a.c"), r.get("line", i + 1), r.get("cls"), r.get("arity", 0), r.get("out", 0), float(r.get("loc", 10))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def pairs(frame):
    return sorted((r["left_idx"], r["right_idx"], r["strategy"]) for r in frame.collect())


def sequential(left, right):
    """The cascade, row by row."""
    def norm(x):
        import re

        x = re.sub("([a-z0-9])([A-Z])", r"\1_\2", x).lower().replace("::", "_")
        return [p for p in x.split("_") if p and p not in scalar.NOISE_PARTS]

    used_l, used_r, out = set(), set(), []

    def take(i, j, s):
        used_l.add(i)
        used_r.add(j)
        out.append((i, j, s))

    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if j not in used_r and i not in used_l and a.get("original") == b["name"]:
                take(i, j, "FfiAttribute")
    last = {b["name"]: j for j, b in enumerate(right)}
    for i, a in enumerate(left):
        j = last.get(a["name"])
        if i not in used_l and j is not None and j not in used_r:
            take(i, j, "ExactName")
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if i not in used_l and j not in used_r and norm(a["name"]) == norm(b["name"]):
                take(i, j, "Normalized")
    shape = lambda r: (r["arity"], r["out"], int(r["loc"]).bit_length())
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if i not in used_l and j not in used_r and shape(a) == shape(b) and {t for t in norm(a["name"]) if len(t) >= 4} & set(norm(b["name"])):
                take(i, j, "Fingerprint")
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_equals_sequential(spark, seed):
    pick = random.Random(seed)
    name = lambda: pick.choice(["load", "parseHeader", "parse_header", "impl_load", "c", "inner_c", "readFile", "read_file_rs", "file_close", "close_all_files"])
    row = lambda: {"name": name(), "arity": pick.randint(0, 1), "out": 0, "loc": pick.randint(1, 9), "original": pick.choice([None, None, "load", "file_close"])}
    left, right = [row() for _ in range(14)], [row() for _ in range(14)]
    assert pairs(matching.match(side(spark, left), side(spark, right))) == sequential(left, right)


def test_mapping_uses_first_free_rows(spark):
    left = side(spark, [{"name": "f", "cls": "A"}, {"name": "f"}, {"name": "g", "file": "x/src/bin/m.rs"}])
    right = side(spark, [{"name": "h"}, {"name": "h", "line": 9}, {"name": "k"}])
    entries = [{"left": "f", "right": "h", "left_class": ""}, {"left": "f", "right": "h"}, {"left": "g", "right": "k", "left_path": "bin/m.rs"}, {"left": "g", "right": "nobody"}]
    found = matching.match_mapping(left, right, entries).collect()
    assert [(r.entry_idx, r.left_idx, r.right_idx) for r in found] == [(0, 1, 0), (1, 0, 1), (2, 2, 2)]


@pytest.mark.parametrize("path,suffix,fits", [("a/b/c.rs", "b/c.rs", True), ("a/bb/c.rs", "b/c.rs", False), ("./c.rs", "c.rs", True), ("c.rs", "a/c.rs", False), ("x", None, True), ("x", "", True)])
def test_path_suffix(spark, path, suffix, fits):
    row = spark.createDataFrame([(path, suffix)], "p string, s string").select(scalar.path_suffix_matches(F.col("p"), F.col("s"))).first()
    assert row[0] is fits


def test_missing_and_stub_exemptions(spark):
    left = side(spark, [{"name": "new", "loc": 1}, {"name": "main", "loc": 4, "file": "src/bin/x.rs"}, {"name": "short", "loc": 1}, {"name": "extra"}])
    right = side(spark, [{"name": "A::~A", "loc": 90}, {"name": "main", "loc": 90}, {"name": "short", "loc": 90}, {"name": "gone"}, {"name": "gone", "line": 77}])
    found = matching.match(left, right, [{"left": "new", "right": "A::~A"}, {"left": "main", "right": "main"}], ("Mapping", "ExactName"))
    assert [r.left_name for r in comparing.partial(found, left, right).collect()] == ["short"]
    assert comparing.partial(found, left, right).first().reason == "left LOC 1 is 1% of right LOC 90"
    assert sorted(r.name for r in comparing.missing(right, found, "right").collect()) == ["gone", "gone"] and [r.name for r in comparing.missing(left, found, "left").collect()] == ["extra"]


def test_p95_is_nearest_rank(spark):
    rows = spark.createDataFrame([(float(v), 0.0) for v in range(1, 41)], "loc_code double, loops double")
    assert {r.metric: r.scale for r in comparing.p95_scale(rows, ("loc_code", "loops")).collect()} == {"loc_code": 38.0, "loops": 1.0}


def test_constants_diff(spark):
    rows = [(0, "left", "int", "1"), (0, "left", "int", "1"), (0, "right", "int", "1"), (0, "right", "string", "a"), (0, "left", "bool", "true"), (0, "right", "bool", "true")]
    r = comparing.constants_diff(spark.createDataFrame(rows, "pair_idx long, side string, kind string, value string")).first()
    assert ([tuple(x) for x in r.only_left], [tuple(x) for x in r.only_right], len(r.in_both), r.score) == ([("int", "1")], [("string", "a")], 2, 3.0)


def graph(spark, edges):
    return spark.createDataFrame([("r", a, b) for a, b in edges], "report_id string, src long, dst long")


def nodes(spark, n):
    return spark.createDataFrame([("r", i, f"f{i}", "a.c", i) for i in range(n)], "report_id string, idx long, name string, file string, line_start int")


def test_bottom_up_order(spark):
    edges = [(0, 1), (1, 2), (3, 3), (4, 5), (5, 4), (4, 0)]
    rows = {r.idx: r for r in callgraph.bottom_up(nodes(spark, 6), graph(spark, edges)).collect()}
    assert all(rows[a].pos > rows[b].pos for a, b in edges if rows[a].scc_id is None or rows[a].scc_id != rows[b].scc_id)
    assert [rows[i].scc_kind for i in range(6)] == ["none", "none", "none", "self", "mutual", "mutual"] and rows[4].scc_size == 2


def test_components_and_closure_agree_with_reachability(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(25), pick.randrange(25)) for _ in range(35)]
    reach = {i: set() for i in range(25)}
    for i in reach:
        front = [i]
        while front:
            front = [b for x in front for a, b in edges if a == x and b not in reach[i] and not reach[i].add(b)]
    expected = {i: min([i, *(j for j in reach[i] if i in reach[j])]) for i in reach}
    g = graph(spark, edges).select("src", "dst")
    assert {r.idx: r.scc for r in callgraph.scc_distributed(nodes(spark, 25), g, cut).collect()} == expected
    up = callgraph.callers(g, spark.createDataFrame([(3,), (7,)], "idx long"), cut).collect()
    assert {(r.seed, r.idx) for r in up} == {(s, i) for s in (3, 7) for i in reach if s in reach[i]}


def test_order_is_that_of_a_recursive_search_and_its_task_gets_numbers_only(spark):
    pick = random.Random(7)
    vertices = [("r", 3 * i, pick.choice(["f", "g", None]), pick.choice(["a.c", "b.c", None]), pick.choice([1, 2, None])) for i in range(40)] + [("s", 5, "x", "y", 1)]
    calls = [("r", 3 * pick.randrange(40), 3 * pick.randrange(40)) for _ in range(55)] + [("r", 3, 3), ("r", 6, 1_000), ("r", 1_001, 6), ("t", 1, 2)]
    v = spark.createDataFrame(vertices, "report_id string, idx long, name string, file string, line_start int")
    frame = callgraph.bottom_up(v, spark.createDataFrame(calls, "report_id string, src long, dst long"))
    near, number, low, stack, groups = {i: sorted({b for r, a, b in calls if r == "r" and a == i and b % 3 == 0 and b < 120}) for i in range(0, 120, 3)}, {}, {}, [], []

    def visit(a):
        number[a] = low[a] = len(number)
        stack.append(a)
        for b in near[a]:
            if b not in number:
                visit(b)
                low[a] = min(low[a], low[b])
            elif b in stack:
                low[a] = min(low[a], number[b])
        if low[a] == number[a]:
            groups.append(stack[stack.index(a) :])
            del stack[stack.index(a) :]

    for a in near:
        if a not in number:
            visit(a)
    key, expected, scc = {i: (f or "", n or 0, m or "", i) for r, i, m, f, n in vertices if r == "r"}, [("s", 5, 0, None, "none", 1)], 0
    for group in groups:
        kind = "mutual" if len(group) > 1 else "self" if group[0] in near[group[0]] else "none"
        scc += kind != "none"
        expected += [("r", i, 0, scc if kind != "none" else None, kind, len(group)) for i in sorted(group, key=key.get)]
    expected = expected[:1] + [(r, i, k, *rest) for k, (r, i, _, *rest) in enumerate(expected[1:])]
    assert sorted(map(tuple, frame.collect())) == sorted(expected)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    task = next(x for x in plan.split("\n") if "CoGroups" in x)
    assert "file" not in task and "name" not in task and "InArrow" in task


def recorded(plans):
    """cut that keeps the plans of what it writes."""

    def write(frame):
        plans.append(frame._jdf.queryExecution().sparkPlan().toString())
        return cut(frame)

    return write


def test_closures_and_components_broadcast_no_growing_table(spark, monkeypatch):
    edges, plans = [(i, i + 1) for i in range(12)] + [(12, 9), (3, 0)], []
    g, n = graph(spark, edges).select("src", "dst"), spark.createDataFrame([(12,), (2,)], "idx long")
    monkeypatch.setattr(callgraph, "FRONT", 0)
    monkeypatch.setattr(callgraph, "ROUNDS", 3)
    up = callgraph.callers(g, n, recorded(plans)).collect()
    assert sorted(map(tuple, up)) == sorted([(2, i) for i in range(4)] + [(12, i) for i in range(13)])
    scc = {r.idx: r.scc for r in callgraph.scc_distributed(nodes(spark, 13), g, recorded(plans)).collect()}
    assert scc == {i: 0 if i < 4 else 9 if i > 8 else i for i in range(13)}
    assert len(plans) > 20 and not any("Broadcast" in p for p in plans)


def test_pairs_meet_their_sides_without_broadcasts(spark, monkeypatch):
    plans, names = [], ["f", "g", "parse_it", "g", "h_file"]
    monkeypatch.setattr(matching, "cut", recorded(plans))
    left = side(spark, [{"name": n, "original": "g"} for n in names])
    right = side(spark, [{"name": n} for n in reversed(names)])
    found = cut(matching.match(left, right))
    order = right.select("idx", "name", "file", F.col("line_start").cast("string").alias("line_start"))
    done = [matching.paired(found, left, right), comparing.missing(right, found, "right"), tables.annotate(order, found, left, right), comparing.fallback_deviation(found, left, right, ("loc_code",))]
    plans += [x._jdf.queryExecution().sparkPlan().toString() for x in done]
    assert len(plans) == 8 and not any("Broadcast" in p for p in plans)
    assert [done[0].count(), done[1].count(), done[2].where("left_name = ''").count()] == [4, 1, 1]


def test_ambiguous_and_unresolved_calls(spark):
    functions = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "idx long, name string")
    calls = spark.createDataFrame([(0, "b"), (0, "puts"), (1, "a")], "idx long, callee string")
    assert sorted(tuple(r) for r in callgraph.edges(calls, functions).collect()) == [(0, 1), (0, 2), (1, 0)]
    assert [tuple(r) for r in callgraph.edges(calls, functions, strict=True).collect()] == [(1, 0)]
    assert tuple(callgraph.resolution_counts(calls, functions).first()) == (1, 1, 1)


def test_edges_of_common_names_are_not_exchanged(spark, monkeypatch):
    monkeypatch.setattr(callgraph, "NAMESAKES", 3)
    functions = spark.createDataFrame([(i, "many" if i < 10 else f"f{i}" if i < 15 else None) for i in range(16)], "idx long, name string")
    calls = spark.createDataFrame([(i, c) for i in range(16) for c in ("many", "f12", "puts", None)] * 2, "idx long, callee string")
    found = callgraph.edges(calls, functions)
    assert sorted(map(tuple, found.collect())) == sorted((i, j) for i in range(16) for j in (*range(10), 12))
    assert sorted(map(tuple, callgraph.edges(calls, functions, strict=True).collect())) == [(i, 12) for i in range(16)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("SortMergeJoin")]


def test_graph_diff(spark):
    own = spark.createDataFrame([(i, i, i) for i in range(4)], "pair_idx long, left_idx long, right_idx long")
    a = spark.createDataFrame([(0, 1), (1, 2)], "src_pair long, dst_pair long")
    b = spark.createDataFrame([(0, 1), (1, 3)], "src_pair long, dst_pair long")
    scc = lambda kind: spark.createDataFrame([(i, kind if i == 0 else "none", 1) for i in range(4)], "idx long, scc_kind string, scc_size long")
    rows = {r.pair_idx: r.total for r in callgraph.graph_diff(own, a, b, scc("self"), scc("none")).collect()}
    assert rows == {0: 2.0, 1: 2.0, 2: 1.0, 3: 1.0}


def test_regression_recovers_a_line(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i - (i % 3) + 5) for i in range(60)], "x_a double, x_b double, y_t double")
    learnt = prediction.train(rows, ("a", "b"), ("t",))
    prediction.save(learnt, str(tmp_path / "m.json"))
    fit = prediction.load(str(tmp_path / "m.json"))["targets"]["t"]
    assert abs(fit["coefs"]["a"] - 2) < 1e-4 and abs(fit["coefs"]["b"] + 1) < 1e-4 and abs(fit["intercept"] - 5) < 1e-3 and fit["residual_std"] >= 1e-6


def test_progress_and_annotation(spark, tmp_path):
    order = spark.createDataFrame([("f", "a,b.c", "1"), ('g"x', "a.c", "oops")], "name string, file string, line_start string")
    tables.write_csv(order, str(tmp_path / "o"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "o")).collect())) == sorted(map(tuple, order.collect()))
    progress = spark.createDataFrame([("f", "a,b.c", "TRUE", 0), ("f", "a,b.c", "FALSE", 1), ("f", "a,b.c", "TRUE", 2)], "name string, file string, translated string, row_no int")
    assert {r.name: r.translated for r in tables.merge_progress(order, progress).collect()} == {"f": "TRUE", 'g"x': "FALSE"}


def test_seed_must_be_one(spark):
    rows = side(spark, [{"name": "f"}, {"name": "f", "line": 5}])
    assert callgraph.select_seed(rows, "left", name="f", line=5).count() == 1
    with pytest.raises(ValueError, match="several"):
        callgraph.select_seed(rows, "left", name="f")


def test_extraction_to_report_and_back(spark, tmp_path):
    found = files.scan(spark, HERE)
    parsed = extraction.parse(found).cache()
    assert extraction.errors(parsed).count() == 0
    functions = extraction.functions(parsed)
    assert {"scan_input", "bump", "add", "grow", "pick", "scale_up", "tally"} <= {r.name for r in functions.collect()}
    assert sorted(r.idx for r in functions.collect()) == list(range(functions.count()))
    point = next(r for r in extraction.structs(parsed).collect() if r.name == "point")
    assert (point.metrics.int_count, point.metrics.string_count, point.metrics.array_count) == (2, 1, 1)
    text = extraction.report(parsed).first().value
    (tmp_path / "r.json").write_text(text)
    read = spark.read.schema(model.REPORT).option("multiLine", True).option("mode", "FAILFAST").json(str(tmp_path / "r.json")).withColumn("report_id", F.lit("x"))
    flat = model.flat(model.functions_of(read))
    assert flat.count() == functions.count() and json.loads(text)["schema_version"] == 1
    bump = flat.where("name = 'bump'").first()
    assert bump.branches == 3.0 and bump.enclosing_type == "Counter" and model.structs_of(read).count() == 5
    assert files.scan(spark, HERE, "rust").count() == 1 and extraction.token_table(files.scan(spark, HERE, "rust")).where("kind = 'keyword' and text = 'match'").count() == 1


def test_a_broken_file_is_an_error_row(spark):
    rows = spark.createDataFrame([("bad.py", "python", bytearray(b"def f(:"))], "path string, language string, content binary")
    parsed = extraction.parse(rows)
    assert extraction.errors(parsed).count() == 1 and extraction.functions(parsed).count() == 0
