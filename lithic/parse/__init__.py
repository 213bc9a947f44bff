"""Readers of the eight languages, by name: text and path in, functions and structs out. No Spark in here."""

from __future__ import annotations

from collections.abc import Callable

from .braces import Reader
from .fortran import Lines
from .python import Walk

#: language -> what reads it; add to it to support another.
READERS: dict[str, Callable] = {
    **{name: (lambda text, path, name=name: Reader(text, name, path)) for name in ("c", "cpp", "java", "rust", "perl", "r")},
    "python": Walk,
    "fortran": Lines,
}


def analyse(text: str, language: str, path: str) -> tuple[list[dict], list[dict]]:
    reader = READERS[language](text, path)
    return reader.functions(), reader.structs()
