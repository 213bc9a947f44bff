"""Commands over reports made from the samples, and the stream of new files."""

import json
import shutil

import pytest

from lithic import __main__ as cli
from lithic.plans import commands
from lithic.streaming import ingest

from .test_parse import HERE


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("reports")
    for name, file in (("a.rust.json", "demo.py"), ("a.c.json", "demo.c")):
        (folder / name).write_text(commands.analyze(spark, f"{HERE}/{file}").first().value)
    fn = lambda name, calls, loc: {"name": name, "location": {"file": "a.c", "line_start": loc}, "signature": {"inputs": [], "outputs": []}, "metrics": {m: 1 for m in ("loc_comments", "branches", "loops", "max_loop_nesting", "max_if_nesting", "max_combined_nesting", "calls_unique", "calls_total", "cyclomatic", "cognitive", "early_returns", "goto_count", "inputs", "outputs", "loc_asm", "unsafe_blocks")} | {"loc_code": loc, "halstead": {"volume": 1.0, "difficulty": 1.0}}, "constants": [{"kind": "int", "value": loc, "text": str(loc), "span": [0, 1]}], "calls": [{"callee": c, "count": 1, "span": [0, 1]} for c in calls], "types_used": []}
    make = lambda functions: json.dumps({"schema_version": 1, "language": "c", "source_file": "a", "source_hash": "", "functions": functions, "structs": []})
    (folder / "left.json").write_text(make([fn("main", ["run_it"], 3), fn("run_it", ["leaf"], 40), fn("leaf", [], 5), fn("alone", [], 6)]))
    (folder / "right.json").write_text(make([fn("main", ["runIt"], 30), fn("runIt", ["leaf", "runIt"], 40), fn("leaf", [], 5)]))
    return folder


def test_commands(spark, reports):
    a, b = str(reports / "left.json"), str(reports / "right.json")
    rows = commands.compare(spark, a, b).collect()
    assert [r.left_name for r in rows][0] == "main" and {r.strategy for r in rows} == {"ExactName", "Normalized"}
    found = commands.missing(spark, a, b)
    assert [r.name for r in found["extra_in_left"].collect()] == ["alone"] and [r.left_name for r in found["partial"].collect()] == ["main"]
    assert commands.sort(spark, a, "loc", 1).first().name == "run_it" and commands.constants_diff(spark, a, b).first().score == 2.0
    assert [r.name for r in commands.order(spark, a).collect()] == ["leaf", "run_it", "main", "alone"]
    diff = commands.call_graph_diff(spark, a, b)
    assert diff["summary"].first().recursive_kind_mismatches == 1 and diff["pairs"].first().total == 4.0
    up = commands.upstream(spark, a, b, left_seed={"name": "leaf"})
    assert {r.name for r in up["left_upstream"].collect()} == {"main", "run_it"} and {r.name for r in up["right_upstream"].collect()} == {"main", "runIt"}
    assert "main" in cli.show(commands.compare(spark, a, b), "table") and json.loads(cli.show(found, "json"))["extra_in_left"] == [{"name": "alone"}]


def test_training_folder(spark, reports):
    assert [x[0] for x in commands.training_pairs(str(reports))] == ["a"]


def test_mapping_files(tmp_path):
    (tmp_path / "m.toml").write_text('[[entries]]\nrust = "f"\nother = "g"\nrust_line = 3\n')
    assert commands.load_mapping(str(tmp_path / "m.toml")) == [{"left": "f", "right": "g", "left_line": 3}]


def test_stream_takes_new_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for files in (["demo.c"], ["demo.c", "demo.rs"]):
        for f in files:
            if not (folder / f).exists():
                shutil.copy(f"{HERE}/{f}", folder / f)
        ingest.stream_functions(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["bump", "scan_input"]
