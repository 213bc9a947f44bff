"""Counts over a whole text that the quality rules and the quality classifier share.

Words are runs of `[^\\x20\\x09-\\x0D]`, lines are what `\\n` parts. All counts come from the UTF-8 bytes: a 256-bin histogram
for characters, the words' hashes for what repeats. A null text counts as an empty one: all counts are 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = b" \t\n\x0b\x0c\r"
#: Fixed by contract: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_stops", "n_exclaims", "n_bars", "n_marks", "n_wide", "max_word")
SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def counts_of(text: str | None) -> tuple:
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return (0,) * len(COUNTS)
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    blanks, wide = int(of[list(BLANKS)].sum()), int(of[0x80:0xC0].sum())
    repeated = 0
    if n > WINDOW:
        each = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        last = n - WINDOW + 1
        window = np.zeros(last, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                window = window * np.uint64(0x9E3779B97F4A7C15) + (each[k : k + last] ^ (each[k : k + last] >> np.uint64(29)))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        if same.any():
            twice = np.zeros(last, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            edge[np.flatnonzero(twice)] += 1
            edge[np.flatnonzero(twice) + WINDOW] -= 1
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return (
        n, len(data) - wide - blanks, int(of[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated,
        len(lines), sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines), len(set(words)),
        int(of[0x41:0x5B].sum()), int(of[0x61:0x7B].sum()), int(of[0x30:0x3A].sum()), int(of[0x2E]), int(of[0x21]), int(of[0x7C]),
        int(of[0x21:0x30].sum() + of[0x3A:0x41].sum() + of[0x5B:0x61].sum() + of[0x7B:0x7F].sum()), int(of[0xC0:].sum()), max(map(len, words), default=0),
    )


def counts(text: Column) -> Column:
    """All counts of a text column, as a struct."""

    @F.pandas_udf(SCHEMA)
    def count(texts):
        import pandas as pd

        return pd.DataFrame([counts_of(x) for x in texts], columns=list(COUNTS))

    return count(text.cast("string"))
