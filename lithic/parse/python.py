"""Python, by the standard library's syntax trees."""

from __future__ import annotations

import ast
import io
import tokenize

from .metrics import Metrics


class Walk:
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path
        self.tree = ast.parse(source)
        lines = source.encode("utf-8", "surrogatepass").split(b"\n")
        self.starts = [0]
        for x in lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.comments = [t.start[0] - 1 for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]

    def span(self, n) -> tuple[int, int]:
        return self.starts[n.lineno - 1] + n.col_offset, self.starts[n.end_lineno - 1] + n.end_col_offset

    def location(self, n) -> dict:
        a, b = self.span(n)
        return {"file": self.path, "line_start": n.lineno, "line_end": n.end_lineno, "col_start": n.col_offset, "col_end": n.end_col_offset, "byte_start": a, "byte_end": b}

    def text(self, n) -> str:
        return ast.get_source_segment(self.source, n) or ""

    def functions(self) -> list[dict]:
        out, stack = [], [(self.tree, None)]
        while stack:
            node, cls = stack.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(self.analyse(node, cls))
            inner = node.name if isinstance(node, ast.ClassDef) else cls
            stack += [(x, inner) for x in reversed(list(ast.iter_child_nodes(node)))]
        return out

    def analyse(self, f, cls) -> dict:
        m = Metrics()
        inner = [x for x in ast.walk(f) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and x is not f]
        hidden = {r for x in inner for r in range(x.lineno - 1, x.end_lineno)}
        m.comments.update(r for r in self.comments if f.lineno - 1 <= r < f.end_lineno and r not in hidden)
        m.rows(f.lineno - 1)
        m.operand(f.name)
        a = f.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        for x in every:
            m.rows(x.lineno - 1)
            m.operand(x.arg)
        for x in f.body:
            self.visit(x, m, 0, 0, 0)
        inputs = [{"name": x.arg, "ty": {"text": self.text(x.annotation) if x.annotation else ""}} for x in every]
        outputs = [{"text": self.text(f.returns)}] if f.returns and self.text(f.returns) != "None" else []
        metrics, calls, constants = m.finish(len(inputs), len(outputs))
        attributes = {self.text(d).split("(")[0]: "true" for d in f.decorator_list} | ({"async": "true"} if isinstance(f, ast.AsyncFunctionDef) else {})
        return {"name": f.name, "original_name": None, "mangled": None, "enclosing_type": cls, "location": self.location(f), "signature": {"inputs": inputs, "outputs": outputs}, "metrics": metrics, "constants": constants, "calls": calls, "types_used": [], "attributes": attributes}

    def visit(self, root, m: Metrics, ifs: int, loops: int, nest: int) -> None:
        stack = [(root, ifs, loops, nest)]
        while stack:
            n, i, l, k = stack.pop()
            push = lambda nodes, *depth: stack.extend((x, *depth) for x in reversed(list(nodes)) if x is not None)  # noqa: B023, E731
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            if isinstance(n, ast.If):
                m.branch(k)
                m.deepest(i + 1, l)
                rest, parts = n.orelse, [([n.test], (i, l, k)), (n.body, (i + 1, l, k + 1))]
                while len(rest) == 1 and isinstance(rest[0], ast.If) and self.source.encode("utf-8", "surrogatepass")[self.span(rest[0])[0] : self.span(rest[0])[0] + 4] == b"elif":
                    m.branch()
                    parts += [([rest[0].test], (i, l, k)), (rest[0].body, (i + 1, l, k + 1))]
                    rest = rest[0].orelse
                if rest:
                    m.cognitive += 1
                    parts.append((rest, (i + 1, l, k + 1)))
                for nodes, depth in reversed(parts):
                    push(nodes, *depth)
                continue
            if isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
                m.loop(k)
                m.deepest(i, l + 1)
                if n.orelse:
                    m.cognitive += 1
                push([*n.body, *n.orelse], i, l + 1, k + 1)
                push([n.test] if isinstance(n, ast.While) else [n.target, n.iter], i, l, k)
                continue
            if isinstance(n, ast.BoolOp):
                for _ in n.values[1:]:
                    m.branch()
            elif isinstance(n, ast.IfExp):
                m.branch(k)
            elif isinstance(n, (ast.ExceptHandler, ast.match_case)):
                m.branch()
            elif isinstance(n, (ast.Return, ast.Raise, ast.Yield, ast.YieldFrom)):
                m.returns += 1
                m.rows(n.lineno - 1, n.end_lineno - 1)
            elif isinstance(n, ast.Call):
                name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
                m.call(name, self.span(n))
                m.rows(n.lineno - 1, n.end_lineno - 1)
            elif isinstance(n, ast.Constant):
                self.constant(n, m)
            if isinstance(n, (ast.BinOp, ast.UnaryOp, ast.Compare, ast.Assign, ast.AugAssign, ast.AnnAssign)):
                m.operator(self.text(n))
                m.rows(n.lineno - 1, n.end_lineno - 1)
            if isinstance(n, (ast.Name, ast.Attribute, ast.keyword)):
                name = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else n.arg
                if name:
                    m.operand(name)
                    m.rows(n.end_lineno - 1 if isinstance(n, ast.Attribute) else n.lineno - 1)
            push(ast.iter_child_nodes(n), i, l, k)

    def constant(self, n, m: Metrics) -> None:
        text, v = self.text(n), n.value
        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string" if isinstance(v, str) else None
        if kind is None:
            return
        if kind == "int" and not -(1 << 63) <= v < 1 << 64:
            return
        if kind == "int" and v >= 1 << 63:
            v -= 1 << 64
        if kind == "string" and "'" in text[:3] and '"' not in text:
            v = text  # single-quoted strings keep their quotes
        m.constant(kind, v, text, self.span(n))
        m.operand(text)
        m.rows(n.lineno - 1, n.end_lineno - 1)

    def structs(self) -> list[dict]:
        out = []
        for c in ast.walk(self.tree):
            if not isinstance(c, ast.ClassDef):
                continue
            fields: dict[str, str] = {}
            for x in c.body:
                if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                    fields.setdefault(x.target.id, self.text(x.annotation))
                elif isinstance(x, ast.Assign):
                    for t in x.targets:
                        if isinstance(t, ast.Name):
                            fields.setdefault(t.id, "")
                elif isinstance(x, ast.FunctionDef) and x.name == "__init__":
                    for y in ast.walk(x):
                        targets = y.targets if isinstance(y, ast.Assign) else [y.target] if isinstance(y, (ast.AnnAssign, ast.AugAssign)) else []
                        for t in targets:
                            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                                fields.setdefault(t.attr, self.text(y.annotation) if isinstance(y, ast.AnnAssign) else "")
            out.append({"name": c.name, "kind": "class", "location": self.location(c), "fields": [{"name": k, "ty": {"text": v}} for k, v in fields.items()], "attributes": {self.text(d).split("(")[0]: "true" for d in c.decorator_list}})
        return sorted(out, key=lambda s: s["location"]["byte_start"])
