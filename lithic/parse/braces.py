"""C, C++, Java, Rust, Perl and R: functions, their statements and their structs, from tokens.

A hand-written reader: it follows brackets and the keywords of control flow, so nesting is exact for code that parses; types and
declarators are taken as text. What it does not understand it skips to the end of the statement.
"""

from __future__ import annotations

import re

from .lexing import LANGUAGES, Token, tokens
from .metrics import Metrics, decode_string, parse_float, parse_int

PAIRS = {"(": ")", "[": "]", "{": "}"}
LOOPS = {"for", "while", "do", "loop", "foreach", "until", "repeat"}
IFS = {"if", "unless"}
NOT_CALLED = {"if", "for", "while", "switch", "match", "return", "sizeof", "catch", "function", "foreach", "elsif", "unless", "until", "fn", "in", "loop", "repeat", "sub", "and", "or", "not", "my", "our", "local"}


class Reader:
    def __init__(self, text: str, language: str, path: str):
        self.language, self.spec, self.path = language, LANGUAGES[language], path
        every = tokens(text, language)
        self.comments = [t for t in every if t.kind == "comment"]
        self.all = [t for t in every if t.kind != "comment"]
        self.close = self.brackets()
        self.data = text.encode("utf-8", "surrogatepass")
        self.line_starts = [0, *[m.end() for m in re.finditer(rb"\n", self.data)]]

    def brackets(self) -> dict[int, int]:
        """Index of each closing bracket by that of its opening one; what never closes closes at the end."""
        out, stack = {}, []
        for i, t in enumerate(self.all):
            if t.text in PAIRS and t.kind == "sign":
                stack.append(i)
            elif t.text in (")", "]", "}") and t.kind == "sign":
                while stack and PAIRS[self.all[stack[-1]].text] != t.text:
                    out[stack.pop()] = i
                if stack:
                    out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.all)
        return out

    def source(self, a: int, b: int) -> str:
        """Text of tokens a to b - 1."""
        return self.data[self.all[a].start : self.all[b - 1].end].decode("utf-8", "surrogatepass") if a < b else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.all) and self.all[i].kind != "string" and self.all[i].text in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.all) and self.all[i].kind == "word" and self.all[i].text not in self.spec.keywords

    def location(self, a: int, b: int) -> dict:
        x, y = self.all[a], self.all[min(b, len(self.all)) - 1]
        return {"file": self.path, "line_start": x.row + 1, "line_end": y.end_row + 1, "col_start": x.start - self.line_starts[x.row], "col_end": y.end - self.line_starts[y.end_row], "byte_start": x.start, "byte_end": y.end}

    # --- functions

    def functions(self) -> list[dict]:
        """Headers found, outer before inner, with the token ranges of their bodies."""
        found = {"rust": self.rust_headers, "perl": self.perl_headers, "r": self.r_headers}.get(self.language, self.c_headers)()
        found.sort(key=lambda f: f["start"])
        inner = [(f["start"], f["end"]) for f in found if f.get("own", True)]
        out = []
        for f in found:
            if f["name"]:
                skip = dict(x for x in inner if f["body"][0] <= x[0] and x[1] <= f["end"] and x[0] != f["start"])
                out.append(self.analyse(f, skip))
        return out

    def split_list(self, open_: int) -> list[tuple[int, int]]:
        """Ranges of the comma-parted items inside a bracket."""
        end, out, start, i, angle = self.close.get(open_, len(self.all)), [], open_ + 1, open_ + 1, 0
        while i < end:
            if self.is_(i, *PAIRS):
                i = self.close.get(i, end)
            elif self.is_(i, "<") and self.language in ("cpp", "java", "rust"):
                angle += 1
            elif self.is_(i, ">") and angle:
                angle -= 1
            elif self.is_(i, ",") and not angle:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < end:
            out.append((start, end))
        return [x for x in out if x[0] < x[1]]

    def c_headers(self) -> list[dict]:
        """name ( ... ) [qualifiers] { outside of statements, for C, C++ and Java."""
        out, i = [], 0
        declaring = [(0, len(self.all))]
        while i < len(self.all):
            if self.is_(i, "(") and (self.word(i - 1) or (self.language == "cpp" and self.is_(i - 2, "operator"))) and not self.is_(i - 2, ".", "->", "new", "return", "="):
                end = self.close.get(i, len(self.all))
                j = end + 1
                while j < len(self.all) and not self.is_(j, "{", ";", "}", "=", ","):
                    j = self.close.get(j, j) + 1 if self.is_(j, "(", "[") else j + 1
                plain = all(self.all[k].kind == "word" or self.is_(k, ":", ",", "(", ")", "::", "<", ">", "&", "*", "->", ".", "@", "[", "]") or self.all[k].kind in ("number", "string") for k in range(end + 1, min(j, len(self.all))))
                if self.is_(j, "{") and plain and not any(self.is_(k, *NOT_CALLED) for k in (i - 1,)):
                    first = self.header_start(i - 1)
                    name = self.all[i - 1].text
                    at = i - 2
                    if self.language == "cpp":
                        if self.is_(at, "~"):
                            name, at = "~" + name, at - 1
                        while self.is_(at, "::") and self.word(at - 1):
                            name, at = f"{self.all[at - 1].text}::{name}", at - 2
                    kind = self.source(first, at + 1)
                    typed = re.sub(r"@\w+(\([^)]*\))?", "", kind)
                    result = re.sub(r"\b(static|inline|extern|const|public|private|protected|final|abstract|synchronized|virtual|explicit|constexpr|native|_Noreturn|template\s*<[^>]*>)\b", "", typed).strip()
                    if first <= at or self.language != "c":
                        close = self.close.get(j, len(self.all))
                        out.append({"name": name, "start": first, "end": close + 1, "body": (j, close + 1), "inputs": self.c_params(i), "outputs": [result] if result and not re.fullmatch(r"void", result) else [], "head": self.source(first, j), "pointers": ""})
                        if self.language != "java":
                            i = j if self.language == "cpp" else close
            i += 1
        return out

    def header_start(self, i: int) -> int:
        while i > 0 and not self.is_(i - 1, ";", "}", "{", ":") or self.is_(i - 1, ":") and self.is_(i - 2, ":"):
            i -= 1
            if i == 0:
                break
        if self.is_(i, "public", "private", "protected") and self.is_(i + 1, ":"):
            i += 2
        return i

    def c_params(self, open_: int) -> list[dict]:
        out = []
        for a, b in self.split_list(open_):
            text = self.source(a, b)
            if text == "void":
                continue
            names = [k for k in range(a, b) if self.word(k)]
            cut = next((k for k in range(a, b) if self.is_(k, "=")), b)
            names = [k for k in names if k < cut]
            name = self.all[names[-1]].text if len(names) > 1 or (names and names[-1] > a) else ""
            kind = self.source(a, names[-1]).rstrip() if name else text
            if self.language == "c":
                kind = re.sub(r"\b(const|volatile|register|restrict)\b", "", kind).replace("*", "").strip()
            out.append({"name": name, "ty": {"text": kind}})
        return out

    def rust_headers(self) -> list[dict]:
        out, scopes = [], []
        for i, t in enumerate(self.all):
            scopes = [s for s in scopes if s[1] > i]
            if self.is_(i, "impl") and not self.is_(i - 1, "(", "->", ":", "<", "&", ","):
                j = i + 1
                while j < len(self.all) and not self.is_(j, "{", ";"):
                    j += 1
                if self.is_(j, "{"):
                    head = self.source(i + 1, j)
                    head = re.sub(r"^<[^{]*?>\s+(?=\w)", "", head) if head.startswith("<") else head
                    target = re.split(r"\bwhere\b", head.split(" for ")[-1])[0].strip()
                    scopes.append((target.split("<")[0].strip(), self.close.get(j, len(self.all))))
            if not self.is_(i, "fn") or not self.word(i + 1):
                continue
            j = i + 2
            if self.is_(j, "<"):
                depth = 0
                while j < len(self.all):
                    depth += self.is_(j, "<") - self.is_(j, ">") - 2 * self.is_(j, ">>")
                    j += 1
                    if depth <= 0:
                        break
            if not self.is_(j, "("):
                continue
            close = self.close.get(j, len(self.all))
            k = close + 1
            while k < len(self.all) and not self.is_(k, "{", ";"):
                k = self.close.get(k, k) + 1 if self.is_(k, "(", "[") else k + 1
            result = self.source(close + 2, k) if self.is_(close + 1, "->") else ""
            result = re.split(r"\bwhere\b", result)[0].strip()
            body = (k, self.close.get(k, len(self.all)) + 1) if self.is_(k, "{") else (k, k + 1)
            start = i
            while start > 0 and self.is_(start - 1, "pub", "const", "async", "unsafe", "extern") or (self.is_(start - 1, ")") and self.is_(start - 4, "pub")) or (start > 0 and self.all[start - 1].kind == "string" and self.is_(start - 2, "extern")):
                start -= 4 if self.is_(start - 1, ")") else 1
            attrs, at = [], start
            while self.is_(at - 1, "]"):
                open_ = next((o for o, c in self.close.items() if c == at - 1 and self.is_(o, "[")), None)
                if open_ is None or not self.is_(open_ - 1, "#"):
                    break
                attrs.insert(0, self.source(open_ + 1, at - 1))
                at = open_ - 1
            inputs = []
            for a, b in self.split_list(j):
                text = self.source(a, b)
                name, _, ty = text.partition(":")
                inputs.append({"name": name.strip(), "ty": {"text": ty.strip() or text}})
            name = self.all[i + 1].text
            linked = next((m[1] for x in attrs if (m := re.match(r'link_name\s*=\s*"([^"]*)"', x))), None)
            original = linked or (name if any(re.search(r"\bno_mangle\b", x) for x in attrs) else None)
            out.append({"name": name, "start": start, "end": body[1], "body": body, "inputs": inputs, "outputs": [result] if result and result != "()" else [], "head": self.source(start, k), "original": original, "enclosing": scopes[-1][0] if scopes else None, "attrs": attrs})
        return out

    def perl_headers(self) -> list[dict]:
        out = []
        for i, t in enumerate(self.all):
            if self.is_(i, "sub") and i + 1 < len(self.all) and self.all[i + 1].kind == "word":
                j, inputs = i + 2, []
                if self.is_(j, "("):
                    inputs = [{"name": self.source(a, b), "ty": {"text": ""}} for a, b in self.split_list(j) if self.source(a, b)[:1] in "$@%" and len(self.source(a, b)) > 1]
                    j = self.close.get(j, len(self.all)) + 1
                if self.is_(j, "{"):
                    end = self.close.get(j, len(self.all)) + 1
                    out.append({"name": self.all[i + 1].text, "start": i, "end": end, "body": (j, end), "inputs": inputs, "outputs": [], "head": self.source(i, j)})
        return out

    def r_headers(self) -> list[dict]:
        out = []
        for i, t in enumerate(self.all):
            if self.is_(i, "function") and self.is_(i + 1, "("):
                close = self.close.get(i + 1, len(self.all))
                end = self.close.get(close + 1, close + 1) + 1 if self.is_(close + 1, "{") else self.expression_end(close + 1)
                name = self.all[i - 2].text.strip("`") if self.is_(i - 1, "<-", "=", "<<-") and self.word(i - 2) else None
                if name is None and self.is_(end, "->", "->>") and self.word(end + 1):
                    name = self.all[end + 1].text
                inputs = [{"name": self.all[a].text, "ty": {"text": ""}} for a, b in self.split_list(i + 1)]
                out.append({"name": name, "start": i, "end": end, "body": (close + 1, end), "inputs": inputs, "outputs": [], "head": self.source(i, close + 1)})
        return out

    def expression_end(self, i: int) -> int:
        row = self.all[i].row if i < len(self.all) else 0
        while i < len(self.all) and self.all[i].row == row and not self.is_(i, "}", ";"):
            i = self.close.get(i, i) + 1
            row = self.all[i - 1].end_row if i <= len(self.all) and i else row
        return i

    # --- one function

    def analyse(self, f: dict, skip: dict[int, int]) -> dict:
        m = Metrics()
        first, last = self.all[f["start"]], self.all[min(f["end"], len(self.all)) - 1]
        holes = [(self.all[a].start, self.all[min(b, len(self.all)) - 1].end) for a, b in skip.items()]
        for c in self.comments:
            if first.start <= c.start < last.end and not any(a <= c.start < b for a, b in holes):
                m.comments.update(range(c.row, c.end_row + (not c.text.endswith("\n"))))
        for i in range(f["start"], f["body"][0]):
            self.leaf(i, m, in_body=False)
        Body(self, m, skip, f["body"][1]).statements(*f["body"])
        inputs, outputs = f["inputs"], [{"text": x} for x in f["outputs"]]
        metrics, calls, constants = m.finish(len(inputs), len(outputs))
        return {
            "name": f["name"], "original_name": f.get("original"), "mangled": None, "enclosing_type": f.get("enclosing"), "location": self.location(f["start"], f["end"]),
            "signature": {"inputs": inputs, "outputs": outputs}, "metrics": metrics, "constants": constants, "calls": calls, "types_used": [], "attributes": self.attributes(f),
        }

    def attributes(self, f: dict) -> dict:
        head, out = f["head"], {}
        if self.language in ("c", "cpp"):
            for key in ("static", "inline", "extern", "_Noreturn", "__attribute__"):
                if key in head:
                    out[key.strip("_")] = "true"
        elif self.language == "rust":
            for key in ("pub", "unsafe", "async", "const", "extern"):
                if re.search(rf"\b{key}\b", head.split("fn ")[0]):
                    out[key] = "true"
            out |= {re.split(r"[\s(=]", a)[0]: a for a in f.get("attrs", ())}
        elif self.language == "java":
            out |= {k: "true" for k in ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native") if re.search(rf"\b{k}\b", head.split("(")[0])}
            out |= {a: "true" for a in re.findall(r"@(\w+)", head)}
        return out

    def leaf(self, i: int, m: Metrics, in_body: bool = True) -> None:
        """Rows, Halstead counts and constants of one token."""
        t = self.all[i]
        span = (t.start, t.end)
        if t.kind == "word" and t.text not in self.spec.keywords:
            m.rows(t.row)
            if t.text in self.spec.bools:
                m.constant("bool", t.text.lower() == "true", None, span)
            m.operand(t.text)
        elif t.kind == "number":
            m.rows(t.row)
            m.operand(t.text)
            marks = {"c": ".eEpP", "cpp": ".eEpP", "perl": ".eE"}.get(self.language)
            hexa = t.text[:2].lower() == "0x"
            real = any(c in t.text for c in marks) if marks else not hexa and (bool(re.search(r"[.]|\d[eE][+-]?\d", t.text)) or bool(re.search(r"f(32|64)?$|[dD]$", t.text)) and self.language in ("java", "rust"))
            if self.language == "r":
                real = not t.text.endswith("L")
            value = parse_float(re.sub(r"_?f(32|64)$", "", t.text)) if real else parse_int(t.text)
            if value is not None and in_body:
                m.constant("float" if real else "int", value, t.text, span)
        elif t.kind in ("string", "char"):
            m.rows(t.row, t.end_row)
            m.operand(t.text)
            if in_body:
                m.constant(t.kind, decode_string(t.text) if t.kind == "string" else t.text.strip("'"), None, span)
        elif t.kind == "sign" and t.text not in "(){}[];,:.#@\\" and t.text not in ("::", "->", "=>", "..."):
            if t.text not in self.spec.short_circuit and in_body and not (t.text == "?" and self.language != "rust"):
                m.rows(t.row)
                m.operator(t.text)

    # --- structs

    def structs(self) -> list[dict]:
        words = {"c": ("struct", "union"), "cpp": ("struct", "union", "class"), "rust": ("struct", "union"), "java": ("class", "interface", "record", "enum")}.get(self.language, ())
        out = []
        for i, t in enumerate(self.all):
            if t.kind != "word" or t.text not in words or not self.word(i + 1) or self.is_(i - 1, ".", "enum"):
                continue
            j = i + 2
            while j < len(self.all) and not self.is_(j, "{", ";", "(", ")", "=", "*", ","):
                j += 1
            tuple_like = self.is_(j, "(") and (self.language == "rust" or t.text == "record")
            if not self.is_(j, "{") and not tuple_like:
                continue
            end = self.close.get(j, len(self.all)) + 1
            fields = self.fields(j, end - 1, tuple_like)
            if tuple_like and self.language == "java":
                fields = [(p["name"], p["ty"]["text"]) for p in self.c_params(j)]
            out.append({"name": self.all[i + 1].text, "kind": t.text, "location": self.location(i, end), "fields": [{"name": n, "ty": {"text": x}} for n, x in fields], "attributes": {}})
        return out

    def fields(self, open_: int, end: int, tuple_like: bool) -> list[tuple[str, str]]:
        if self.language == "rust":
            out = []
            for k, (a, b) in enumerate(self.split_list(open_)):
                text = re.sub(r"#\[[^\]]*\]\s*", "", self.source(a, b))
                text = re.sub(r"^pub(\([^)]*\))?\s+", "", text).strip()
                if tuple_like:
                    out.append((f"_{k}", text))
                elif ":" in text:
                    name, _, ty = text.partition(":")
                    out.append((name.strip(), ty.strip()))
            return out
        out, i, start = [], open_ + 1, open_ + 1
        while i < end:
            if self.is_(i, "{"):
                i = start = self.close.get(i, end) + 1
                continue
            if self.is_(i, ":") and self.is_(i - 1, "public", "private", "protected"):
                start = i + 1
            if self.is_(i, ";"):
                out += self.declared(start, i)
                start = i + 1
            i += 1
        return out

    def declared(self, a: int, b: int) -> list[tuple[str, str]]:
        text = self.source(a, b)
        if not text or self.is_(a, "typedef", "using", "friend", "return"):
            return []
        equal = next((k for k in range(a, b) if self.is_(k, "=", ":") and not self.is_(k, "::")), b)
        if any(self.is_(k, "(") for k in range(a, equal)):
            return []
        names = [k for k in range(a, equal) if self.word(k) and not (self.is_(k + 1, "<", "::"))]
        commas = [k for k in range(a, equal) if self.is_(k, ",")]
        if commas and self.language in ("c", "cpp", "java") and not self.is_(a + 1, "<"):
            ends, out, base = [*commas, equal], [], None
            start = a
            for e in ends:
                own = [k for k in range(start, e) if self.word(k)]
                if not own:
                    break
                last = own[-1]
                if base is None:
                    base = re.sub(r"\b(public|private|protected|static|final|const|volatile|mutable)\b", "", self.source(a, last)).strip()
                stars = "*" * sum(self.is_(k, "*") for k in range(start, last)) if start != a else ""
                out.append((self.all[last].text, base + stars + self.source(last + 1, e)))
                start = e + 1
            return out
        if len(names) < 1 or names[-1] == a:
            return []
        last = names[-1]
        base = re.sub(r"\b(public|private|protected|static|final|volatile|mutable)\b|@\w+(\([^)]*\))?", "", self.source(a, last)).strip()
        return [(self.all[last].text, base + self.source(last + 1, equal))]


class Body:
    """Statements of one function; nested functions are skipped."""

    def __init__(self, reader: Reader, m: Metrics, skip: dict[int, int], end: int):
        self.r, self.m, self.skip, self.end = reader, m, skip, end

    def statements(self, i: int, end: int, ifs=0, loops=0, nest=0, owner: str = "") -> None:
        while i < min(end, len(self.r.all)):
            i = max(i + 1, self.statement(i, end, ifs, loops, nest, owner))

    def body(self, i: int, end: int, *depth) -> int:
        """A block or a single statement."""
        if self.r.is_(i, "{"):
            close = self.r.close.get(i, end)
            self.statements(i + 1, close, *depth)
            return close + 1
        return self.statement(i, end, *depth)

    def condition(self, i: int, end: int, *depth) -> int:
        """A bracketed condition, or in Rust all that stands before the block."""
        if self.r.language != "rust" and self.r.is_(i, "("):
            close = self.r.close.get(i, end)
            self.expression(i + 1, close, *depth)
            return close + 1
        start = i
        while i < end and not self.r.is_(i, "{"):
            i = self.r.close.get(i, i) + 1 if self.r.is_(i, "(", "[") else i + 1
        self.expression(start, i, *depth)
        return i

    def statement(self, i: int, end: int, ifs=0, loops=0, nest=0, owner: str = "", else_if: bool = False) -> int:
        r, m = self.r, self.m
        if i in self.skip:
            return self.skip[i]
        text = r.all[i].text if i < len(r.all) and r.all[i].kind == "word" else r.all[i].text if i < len(r.all) and r.all[i].kind == "sign" else ""
        if text == "{":
            return self.body(i, end, ifs, loops, nest, owner)
        if text in IFS:
            if else_if:
                m.branch()
                deeper = (ifs, loops, nest)
            else:
                m.branch(nest)
                deeper = (ifs + 1, loops, nest + 1)
                m.deepest(ifs + 1, loops)
            at = self.body(self.condition(i + 1, end, ifs, loops, nest), end, *deeper)
            while r.is_(at, "elsif"):
                m.branch()
                at = self.body(self.condition(at + 1, end, ifs, loops, nest), end, *deeper)
            if r.is_(at, "else"):
                if r.language != "java":
                    m.cognitive += 1
                if r.is_(at + 1, "if"):
                    return self.statement(at + 1, end, *deeper, else_if=True)
                return self.body(at + 1, end, *deeper)
            return at
        if text in LOOPS and (text != "loop" or r.language == "rust") and not (text == "for" and r.language == "rust" and r.is_(i + 1, "<")):
            m.loop(nest)
            m.deepest(ifs, loops + 1)
            deeper = (ifs, loops + 1, nest + 1)
            at = i + 1
            if text in ("do", "loop", "repeat"):
                at = self.body(at, end, *deeper)
                if text == "do" and r.is_(at, "while", "until"):
                    at = self.condition(at + 1, end, ifs, loops, nest)
                return at
            while r.language == "perl" and at < end and not r.is_(at, "("):
                r.leaf(at, m)
                at += 1
            return self.body(self.condition(at, end, ifs, loops, nest), end, *deeper)
        if text in ("switch", "match") and r.language not in ("perl", "r"):
            at = self.condition(i + 1, end, ifs, loops, nest)
            if r.is_(at, "{"):
                close = r.close.get(at, end)
                (self.arms if text == "match" else self.cases)(at + 1, close, ifs, loops, nest)
                return close + 1
            return at
        if text in ("try", "unsafe", "finally") and r.is_(i + 1, "{") or text == "unsafe":
            if text == "unsafe" and r.language == "rust":
                m.unsafe += 1
            return self.body(i + 1, end, ifs, loops, nest)
        if text == "catch" and r.is_(i + 1, "("):
            if r.language == "java":
                m.branch()
            return self.body(r.close.get(i + 1, end) + 1, end, ifs, loops, nest)
        stop = self.stop(i, end)
        self.expression(i, stop, ifs, loops, nest)
        return stop + 1

    def cases(self, i: int, end: int, ifs, loops, nest) -> None:
        while i < end:
            if self.r.is_(i, "case", "default"):
                if not (self.r.is_(i, "default") and self.r.is_(i + 1, "(")):
                    self.m.branch()
                at = i + 1
                while at < end and not self.r.is_(at, ":", "->"):
                    at += 1
                self.expression(i + 1, at, ifs, loops, nest)
                i = at + 1
            else:
                i = max(i + 1, self.statement(i, end, ifs, loops, nest))

    def arms(self, i: int, end: int, ifs, loops, nest) -> None:
        while i < end:
            at = i
            while at < end and not self.r.is_(at, "=>"):
                at = self.r.close.get(at, at) + 1 if self.r.is_(at, *PAIRS) else at + 1
            if at >= end:
                return self.expression(i, end, ifs, loops, nest)
            self.m.branch()
            self.expression(i, at, ifs, loops, nest)
            if self.r.is_(at + 1, "{"):
                i = self.body(at + 1, end, ifs, loops, nest)
            else:
                stop = at + 1
                while stop < end and not self.r.is_(stop, ","):
                    stop = self.r.close.get(stop, stop) + 1 if self.r.is_(stop, *PAIRS) else stop + 1
                self.statements(at + 1, stop, ifs, loops, nest)
                i = stop
            if self.r.is_(i, ","):
                i += 1

    def stop(self, i: int, end: int) -> int:
        """End of an expression statement: its `;`, or in R and for a block's last value its line or the block."""
        row = None
        while i < end and i < len(self.r.all):
            if self.r.is_(i, ";"):
                return i
            if self.r.language == "r" and row is not None and self.r.all[i].row > row and not (self.r.all[i - 1].kind == "sign" and self.r.all[i - 1].text not in (")", "]", "}")):
                return i - 1
            close = self.r.close.get(i, i) if self.r.is_(i, *PAIRS) else i
            if self.r.is_(i, "{") and self.r.language != "r" and not self.r.is_(close + 1, ";", ".", ")", ",", "?", "=", "}"):
                return close
            row = self.r.all[min(close, len(self.r.all) - 1)].end_row
            i = close + 1
        return end

    def expression(self, i: int, end: int, ifs=0, loops=0, nest=0) -> None:
        """Calls, literals, operators; control flow met inside (blocks, closures, values) is read as statements."""
        r, m = self.r, self.m
        start = i
        while i < min(end, len(r.all)):
            t = r.all[i]
            if i in self.skip:
                i = self.skip[i]
                continue
            if r.is_(i, "{"):
                i = self.body(i, end, ifs, loops, nest)
                continue
            if t.kind == "word" and i > start:
                if t.text in ("if", "match", "loop", "while", "for") and r.language == "rust":
                    i = self.statement(i, end, ifs, loops, nest)
                    continue
                if t.text == "switch" and r.language == "java" or t.text in IFS | LOOPS and r.language == "r":
                    i = self.statement(i, end, ifs, loops, nest)
                    continue
                if r.language == "perl" and t.text in IFS | LOOPS:  # a statement's trailing condition
                    (m.loop if t.text in LOOPS else m.branch)(nest)
                    m.deepest(ifs + (t.text in IFS), loops + (t.text in LOOPS))
                    i += 1
                    continue
            if t.kind == "word" and t.text in ("return", "throw", "yield") and (t.text == "return" or r.language == "java") and not (r.language == "r"):
                m.returns += 1
                m.rows(t.row)
            elif t.kind == "word" and (t.text == "goto" or r.language == "perl" and t.text in ("last", "next", "redo")):
                m.goto()
                m.rows(t.row)
            elif t.kind == "word" and t.text in ("unsafe", "asm", "__asm__") and (r.is_(i + 1, "{", "(", "volatile")):
                if t.text != "unsafe":
                    m.asm.update(range(t.row, r.all[min(r.close.get(i + 1, i), len(r.all) - 1)].end_row + 1))
                    m.rows(t.row)
                else:
                    m.unsafe += 1
            elif t.text in r.spec.short_circuit and t.kind in ("sign", "word") and i > start:
                m.branch()
            elif t.text == "?" and t.kind == "sign" and r.language in ("c", "cpp", "java", "perl"):
                m.branch(nest)
            else:
                self.called(i)
            r.leaf(i, m)
            i += 1

    def called(self, i: int) -> None:
        """A call whose callee's last token is i."""
        r, t = self.r, self.r.all[i]
        macro = r.language == "rust" and r.is_(i + 1, "!") and r.is_(i + 2, "(", "[", "{")
        turbo = r.language == "rust" and r.is_(i + 1, "::") and r.is_(i + 2, "<")
        open_ = i + 2 if macro else i + 1
        if turbo:
            open_ = i + 3
            while open_ < len(r.all) and not r.is_(open_, "(", ";", "{"):
                open_ += 1
        if t.kind != "word" or not r.is_(open_, "(", *("[{" if macro else "")) or t.text in NOT_CALLED:
            return
        if t.text in r.spec.keywords and not (r.language == "java" and t.text in ("this", "super")) or r.is_(i - 1, "fn", "function", "sub"):
            return
        name = t.text.lstrip("&") if r.language == "perl" else t.text.strip("`")
        first = i
        while r.is_(first - 1, "::", ".", "->", ":::", "$") and first >= 2 and (r.all[first - 2].kind == "word" or r.is_(first - 2, ")", "]")):
            if r.language in ("c", "cpp") and r.is_(first - 1, "::") and first == i or r.language == "cpp" and r.is_(first - 1, "::"):
                name = f"{r.all[first - 2].text}::{name}"
            first -= 2
        close = r.close.get(open_, i)
        last = r.all[min(close, len(r.all) - 1)]
        if macro:
            name += "!"
        self.m.call(name, (r.all[first].start, last.end))
        self.m.rows(r.all[first].row, last.end_row)
