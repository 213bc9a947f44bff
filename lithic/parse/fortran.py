"""Free-form Fortran, statement by statement."""

from __future__ import annotations

import re

from .braces import Reader
from .metrics import Metrics, parse_float, parse_int

UNIT = re.compile(r"^(?!end\b)(?P<head>.*?)\b(?P<kind>function|subroutine|module\s+procedure)\s+(?P<name>\w+)\s*(?:\((?P<args>[^)]*)\))?(?P<rest>.*)$", re.I)
END_UNIT = re.compile(r"^end\s*(function|subroutine|procedure)?\b", re.I)
NOT_CALLED = {"if", "else", "elseif", "do", "while", "call", "select", "case", "where", "forall", "allocate", "deallocate", "write", "read", "print", "return", "then", "end", "intent", "dimension", "integer", "real", "character", "logical", "complex", "type", "function", "subroutine", "kind", "len", "concurrent", "stop"}


class Lines(Reader):
    def __init__(self, text: str, path: str):
        super().__init__(text, "fortran", path)
        # A statement is the tokens of a line and of the lines that `&` joins to it; `;` parts statements.
        self.lines: list[list[int]] = []
        going = False
        for i, t in enumerate(self.all):
            if t.text == ";":
                going = False
                continue
            if t.text == "&":
                going = True
                continue
            new = not self.lines or (t.row > self.all[self.lines[-1][-1]].end_row and not going) or self.is_(i - 1, ";")
            if new:
                self.lines.append([])
            self.lines[-1].append(i)
            going = False

    def line(self, n: int) -> str:
        return " ".join(self.all[i].text for i in self.lines[n]).replace(" ( ", "(").strip()

    def functions(self) -> list[dict]:
        open_: list[dict] = []
        found: list[dict] = []
        for n in range(len(self.lines)):
            text = self.line(n)
            if self.all[self.lines[n][0]].kind == "string":
                continue
            if (u := UNIT.match(text)) and not re.match(r"^(call|interface|end)\b", text, re.I) and "::" not in u["head"] and "=" not in u["head"]:
                open_.append({"name": u["name"], "first": n, "args": [a.strip() for a in (u["args"] or "").split(",") if a.strip()], "is_function": u["kind"].lower() == "function", "head": u["head"], "result": (re.search(r"result\s*\(?\s*(\w+)", u["rest"], re.I) or [None, u["name"]])[1], "inner": []})
            elif (e := END_UNIT.match(text)) and open_ and (e[1] or text.lower() == "end"):
                f = open_.pop()
                f["last"] = n
                found.append(f)
                if open_:
                    open_[-1]["inner"].append((f["first"], n))
        for f in open_:
            found.append(f | {"last": len(self.lines) - 1})
        return [self.unit(f) for f in sorted(found, key=lambda f: f["first"])]

    def unit(self, f: dict) -> dict:
        m = Metrics()
        a, b = self.lines[f["first"]][0], self.lines[f["last"]][-1] + 1
        hidden = {n for x, y in f["inner"] for n in range(x, y + 1)}
        inner_rows = {r for n in hidden for r in (self.all[self.lines[n][0]].row,)}
        for c in self.comments:
            if self.all[a].row <= c.row <= self.all[b - 1].row and c.row not in inner_rows:
                m.comments.add(c.row)
        types = {}
        ifs = loops = 0
        stack: list[str] = []
        for n in range(f["first"], f["last"] + 1):
            if n in hidden:
                continue
            text = self.line(n).lower()
            text = re.sub(r"^(\w+)\s*:\s*(?=do|if|select)", "", text)
            text = re.sub(r"^\d+\s+", "", text)
            nest = ifs + loops
            declared = re.match(r"^(integer|real|character|logical|complex|type|class|double precision)\b.*::", text)
            if declared:
                kind, names = self.line(n).split("::", 1)
                for name in re.findall(r"(\w+)\s*(?:\([^)]*\))?\s*(?:=[^,]*)?(?:,|$)", names):
                    types[name.lower()] = kind.strip()
            if re.match(r"^else\s*if\b|^elsewhere\s*\(", text) or re.match(r"^case\b", text):
                m.branch()
            elif re.match(r"^else\b", text):
                m.cognitive += 1
            elif re.match(r"^(end\s*(if|do|where|select|forall|associate|block))\b", text):
                if stack:
                    kind = stack.pop()
                    ifs -= kind == "if"
                    loops -= kind == "loop"
            elif re.match(r"^(if|where)\s*\(", text):
                m.branch(nest)
                m.deepest(ifs + 1, loops)
                if text.endswith("then") or (text.startswith("where") and text.endswith(")")):
                    stack.append("if")
                    ifs += 1
            elif re.match(r"^(do\b|forall\s*\()", text):
                m.loop(nest)
                m.deepest(ifs, loops + 1)
                stack.append("loop")
                loops += 1
            elif re.match(r"^(select|associate|block)\b", text):
                stack.append("other")
            if re.search(r"(^|\)\s*)(return|stop)\b", text):
                m.returns += 1
                m.rows(self.all[self.lines[n][0]].row)
            if re.search(r"(^|\)\s*)(cycle|exit|go\s*to)\b", text):
                m.goto()
                m.rows(self.all[self.lines[n][0]].row)
            edge = n in (f["first"], f["last"])
            for i in self.lines[n]:
                self.token(i, m, edge, bool(declared), types)
        inputs = [{"name": x, "ty": {"text": types.get(x.lower(), "")}} for x in f["args"]]
        head = re.sub(r"\b(pure|elemental|recursive|impure|module)\b", "", f["head"], flags=re.I).strip()
        outputs = [{"text": head or types.get(f["result"].lower(), "")}] if f["is_function"] else []
        metrics, calls, constants = m.finish(len(inputs), len(outputs))
        attributes = {k: "true" for k in ("pure", "elemental", "recursive") if re.search(rf"\b{k}\b", f["head"], re.I)}
        return {"name": f["name"], "original_name": None, "mangled": None, "enclosing_type": None, "location": self.location(a, b), "signature": {"inputs": inputs, "outputs": outputs}, "metrics": metrics, "constants": constants, "calls": calls, "types_used": [], "attributes": attributes}

    def token(self, i: int, m: Metrics, edge: bool, declared: bool, types: dict) -> None:
        t = self.all[i]
        span, low = (t.start, t.end), t.text.lower()
        if t.kind == "word":
            if edge and low in ("end", "function", "subroutine"):
                return
            if low not in NOT_CALLED:
                m.rows(t.row)
                m.operand(t.text)
                called = self.is_(i - 1, "call", "CALL", "Call") or self.is_(i + 1, "(") and not declared and not edge and low not in types
                if called:
                    last = self.all[min(self.close.get(i + 1, i), len(self.all) - 1)] if self.is_(i + 1, "(") else t
                    m.call(t.text, (t.start, last.end))
                    m.rows(t.row, last.end_row)
        elif t.kind == "number":
            m.rows(t.row)
            m.operand(t.text)
            real = any(c in low for c in ".ed")
            value = parse_float(t.text) if real else parse_int(t.text)
            if value is not None:
                m.constant("float" if real else "int", value, t.text, span)
        elif t.kind == "string":
            m.rows(t.row)
            m.operand(t.text)
            m.constant("string", t.text[1:-1] if t.text[0] == '"' else t.text, None, span)
        elif low in (".true.", ".false."):
            m.rows(t.row)
            m.constant("bool", low == ".true.", None, span)
        elif low in self.spec.short_circuit:
            m.branch()
        elif t.text not in "(),:&" and t.text not in ("::", "=>", "(/", "/)"):
            m.rows(t.row)
            m.operator(t.text)

    def structs(self) -> list[dict]:
        out, own = [], None
        for n in range(len(self.lines)):
            text = self.line(n)
            if own is None and (u := re.match(r"^type\b(?:\s*,[^:]*)?(?:\s*::)?\s*(\w+)$", text, re.I)):
                own = {"name": u[1], "first": n, "fields": []}
            elif own is not None and re.match(r"^end\s*type\b", text, re.I):
                loc = self.location(self.lines[own["first"]][0], self.lines[n][-1] + 1)
                out.append({"name": own["name"], "kind": "type", "location": loc, "fields": [{"name": a, "ty": {"text": b}} for a, b in own["fields"]], "attributes": {}})
                own = None
            elif own is not None and "::" in text:
                kind, names = text.split("::", 1)
                own["fields"] += [(x, kind.strip()) for x in re.findall(r"(\w+)\s*(?:\([^)]*\))?\s*(?:=[^,]*)?(?:,|$)", names)]
        return out
