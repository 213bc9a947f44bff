"""One accumulator of metrics for all languages.

Rules: an if adds a branch, 1 to cyclomatic and 1 + nesting to cognitive; an else-if and a case 1 each; an else 1 to cognitive; a loop
1 to cyclomatic and 1 + nesting; each short-circuit operator and goto 1 each; a ternary 1 + nesting. Code lines are the rows
of identifiers, literals, operators, returns, gotos and whole calls; rows with a comment count as comment lines only.

Halstead counts are made from tokens (operator tokens, names and literals), an approximation of counts over operator expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log2


def parse_int(text: str) -> int | None:
    """Signed 64-bit value of a literal; radix prefixes, separators and suffixes are understood."""
    t = re.sub(r"[_']", "", text.strip())
    sign, body = (-1, t[1:]) if t.startswith("-") else (1, t[1:] if t.startswith("+") else t)
    for prefix, radix, digits in (("0x", 16, "[0-9a-fA-F]+"), ("0b", 2, "[01]+"), ("0o", 8, "[0-7]+"), ("", 10, "[0-9]+")):
        if body.lower().startswith(prefix):
            found = re.match(digits, body[len(prefix) :])
            if not found or int(found[0], radix) >= 1 << 64:
                return None
            value = int(found[0], radix)
            return sign * (value - (1 << 64) if value >= 1 << 63 else value)
    return None


def parse_float(text: str) -> float | None:
    try:
        bare = re.sub(r"[fFLldD]+$", "", text.replace("_", ""))
        return None if re.match(r"[+-]?0[xX]", bare) else float(bare)
    except ValueError:
        return None


ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "'": "'"}


def decode_string(text: str) -> str:
    """What stands between the outermost double quotes, simple escapes resolved (not in raw strings); else the text itself."""
    a, b = text.find('"'), text.rfind('"')
    if a < 0 or b <= a:
        return text
    inner = text[a + 1 : b]
    if "r" in text[:a].lower():
        return inner
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), inner, flags=re.S)


@dataclass
class Metrics:
    code: set = field(default_factory=set)
    comments: set = field(default_factory=set)
    asm: set = field(default_factory=set)
    branches: int = 0
    loops: int = 0
    cyclomatic: int = 1
    cognitive: int = 0
    if_nest: int = 0
    loop_nest: int = 0
    both_nest: int = 0
    returns: int = 0
    gotos: int = 0
    unsafe: int = 0
    calls: dict = field(default_factory=dict)
    calls_total: int = 0
    constants: list = field(default_factory=list)
    operators: dict = field(default_factory=dict)
    operands: dict = field(default_factory=dict)

    def rows(self, first: int, last: int | None = None) -> None:
        self.code.update(range(first, (first if last is None else last) + 1))

    def operand(self, text: str) -> None:
        self.operands[text] = self.operands.get(text, 0) + 1

    def operator(self, text: str) -> None:
        self.operators[text] = self.operators.get(text, 0) + 1

    def branch(self, nest: int = 0) -> None:
        self.branches += 1
        self.cyclomatic += 1
        self.cognitive += 1 + nest

    def loop(self, nest: int) -> None:
        self.loops += 1
        self.cyclomatic += 1
        self.cognitive += 1 + nest

    def deepest(self, ifs: int, loops: int) -> None:
        self.if_nest, self.loop_nest, self.both_nest = max(self.if_nest, ifs), max(self.loop_nest, loops), max(self.both_nest, ifs + loops)

    def goto(self) -> None:
        self.gotos += 1
        self.cyclomatic += 1
        self.cognitive += 1

    def call(self, callee: str | None, span: tuple[int, int]) -> None:
        self.calls_total += 1
        if callee:
            had = self.calls.setdefault(callee, [0, list(span)])
            had[0] += 1

    def constant(self, kind: str, value, text: str | None, span: tuple[int, int]) -> None:
        row = dict.fromkeys(("int_value", "float_value", "str_value", "bool_value"))
        row[{"int": "int_value", "float": "float_value", "bool": "bool_value"}.get(kind, "str_value")] = value
        self.constants.append({"kind": kind, **row, "text": text if kind in ("int", "float") else None, "span": list(span)})

    def finish(self, inputs: int, outputs: int) -> tuple[dict, list, list]:
        """The metrics' struct, the calls and the constants."""
        n1, n2, big1, big2 = len(self.operators), len(self.operands), sum(self.operators.values()), sum(self.operands.values())
        halstead = {
            "n1": n1, "n2": n2, "big_n1": big1, "big_n2": big2,
            "volume": (big1 + big2) * log2(n1 + n2) if n1 + n2 else 0.0, "difficulty": n1 / 2 * big2 / n2 if n2 else 0.0,
        }
        out = {
            "loc_code": len(self.code - self.comments), "loc_comments": len(self.comments), "loc_asm": len(self.asm), "inputs": inputs, "outputs": outputs, "branches": self.branches,
            "loops": self.loops, "max_loop_nesting": self.loop_nest, "max_if_nesting": self.if_nest, "max_combined_nesting": self.both_nest, "calls_unique": len(self.calls),
            "calls_total": self.calls_total, "cyclomatic": self.cyclomatic, "cognitive": self.cognitive, "halstead": halstead, "early_returns": max(0, self.returns - 1),
            "goto_count": self.gotos, "unsafe_blocks": self.unsafe,
        }
        calls = sorted(({"callee": k, "count": n, "span": span} for k, (n, span) in self.calls.items()), key=lambda c: (-c["count"], c["callee"]))
        return out, calls, self.constants
