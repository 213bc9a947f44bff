"""Metrics of small samples, counted by hand."""

import os

import pytest

from lithic.parse import analyse
from lithic.parse.metrics import decode_string, parse_float, parse_int
from lithic.sources.files import decode, fnv1a

HERE = os.path.join(os.path.dirname(__file__), "samples")
NAMES = ("branches", "loops", "cyclomatic", "cognitive", "max_if_nesting", "max_loop_nesting", "max_combined_nesting", "early_returns", "goto_count", "calls_total")


def read(file, language):
    with open(os.path.join(HERE, file)) as text:
        return analyse(text.read(), language, file)


@pytest.mark.parametrize("file,language,name,expected", [
    ("demo.c", "c", "scan_input", (4, 1, 7, 8, 1, 1, 2, 1, 1, 1)),
    ("demo.rs", "rust", "bump", (3, 1, 5, 4, 0, 1, 1, 0, 0, 1)),
    ("Demo.java", "java", "add", (4, 1, 6, 5, 1, 1, 1, 2, 0, 3)),
    ("Demo.java", "java", "helper", (2, 0, 3, 2, 0, 0, 0, 1, 0, 0)),
    ("demo.py", "python", "grow", (3, 1, 5, 6, 1, 1, 2, 2, 0, 2)),
    ("demo.f90", "fortran", "pick", (3, 1, 6, 7, 1, 1, 2, 0, 1, 1)),
    ("demo.R", "r", "scale_up", (2, 1, 4, 4, 1, 1, 1, 0, 0, 1)),
    ("demo.pl", "perl", "tally", (4, 1, 8, 10, 1, 1, 2, 0, 2, 1)),
])
def test_metrics(file, language, name, expected):
    m = next(f for f in read(file, language)[0] if f["name"] == name)["metrics"]
    assert tuple(m[n] for n in NAMES) == expected


def test_signatures_and_ffi():
    f = read("demo.rs", "rust")[0][0]
    assert f["enclosing_type"] == "Counter" and f["original_name"] == "bump" and [i["ty"]["text"] for i in f["signature"]["inputs"]] == ["&mut self", "i32"] and f["signature"]["outputs"] == [{"text": "i32"}]
    g = read("demo.py", "python")[0]
    assert [x["name"] for x in g] == ["__init__", "grow"] and g[1]["enclosing_type"] == "Box" and [c["int_value"] for c in g[1]["constants"] if c["kind"] == "int"] == [3, 1, 0, 16]


def test_structs():
    fields = lambda s: [(f["name"], f["ty"]["text"]) for f in s["fields"]]
    assert fields(read("demo.c", "c")[1][0]) == [("x", "int"), ("y", "int"), ("label", "char *"), ("w", "double[4]")]
    a, b = read("demo.rs", "rust")[1]
    assert fields(a) == [("n", "i32"), ("names", "Vec<String>"), ("raw", "*const u8")] and fields(b) == [("_0", "i32"), ("_1", "f64")]
    assert fields(read("Demo.java", "java")[1][0]) == [("count", "int"), ("names", "List<String>")] and fields(read("demo.py", "python")[1][0]) == [("size", "int"), ("n", "")]


def test_lines_with_comments_are_no_code():
    m = read("demo.c", "c")[0][0]["metrics"]
    assert m["loc_comments"] == 1 and m["loc_code"] == 10


@pytest.mark.parametrize("text,value", [("42", 42), ("0x1F", 31), ("0b101", 5), ("0o17", 15), ("1_000u32", 1000), ("100UL", 100), ("-7", -7), ("0xFFFFFFFFFFFFFFFF", -1), ("0x8000000000000000", -(2**63)), ("1'000", 1000), ("abc", None), ("0x", None)])
def test_int_literals(text, value):
    assert parse_int(text) == value


def test_other_literals_and_decoding():
    assert parse_float("1.5f") == 1.5 and parse_float("0x1p3") is None and decode_string(r'"a\nb"') == "a\nb" and decode_string("'x'") == "'x'" and decode_string('r"a\\n"') == "a\\n"
    assert decode(b"abc\xff\xfed\xc3\xa9f") == "abc??déf" and fnv1a("") == "cbf29ce484222325" and fnv1a("a") == "af63dc4c8601ec8c"


def test_empty_and_broken_files():
    for language in ("c", "cpp", "java", "rust", "perl", "r", "fortran", "python"):
        assert analyse("", language, "x") == ([], [])
    for language in ("c", "java", "rust", "perl", "r", "fortran"):
        analyse("} ) int f( { if ( x \n while {{ (", language, "x")
