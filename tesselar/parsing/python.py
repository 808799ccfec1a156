"""Python, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from tesselar.parsing.base import Node, Ref

PIECE = 200_000  # characters that are read at once; more only if a single statement has more
#: A line that begins a statement; what goes on with the one before doesn't.
_STATEMENT = re.compile(r"^(?!(?:else|elif|except|finally)\b)[A-Za-z_@]", re.M)


def pieces(source: str) -> Iterator[tuple[ast.Module, int]]:
    """The trees of a source's pieces, each of whole statements, and how many lines are before them."""
    at, line = 0, 0
    while True:
        size = PIECE
        while True:
            cut = _STATEMENT.search(source, at + size)
            end = cut.start() if cut else len(source)
            try:
                tree = ast.parse(source[at:end])
                break
            except SyntaxError as e:  # a statement that goes on, or a broken one
                if end == len(source):
                    e.lineno = (e.lineno or 0) + line
                    raise
                size *= 2
        yield tree, line
        line, at = line + source.count("\n", at, end), end
        if at >= len(source):
            return


def visibility(name: str) -> str:
    dunder = name.startswith("__") and name.endswith("__")
    return "private" if name.startswith("_") and not dunder else ""


class Python:
    language = "python"

    def __init__(self, source: str, path: str):
        self.source, self.path, self.line = source.replace("\r\n", "\n").replace("\r", "\n"), path, 0
        self.nodes: list[Node] = []
        self.refs: list[Ref] = []
        self.taken: set[str] = set()

    def parse(self) -> tuple[list[Node], list[Ref]]:
        """All at once."""
        nodes, refs = [], []
        for n, r in self.parts():
            nodes += n
            refs += r
        return nodes, refs

    def parts(self) -> Iterator[tuple[list[Node], list[Ref]]]:
        """What is found, piece by piece; nothing, if one of them is broken."""
        if len(self.source) > PIECE:
            for _ in pieces(self.source):
                pass
        for tree, self.line in pieces(self.source):
            self.body(tree.body, self.path, None)
            yield self.nodes, self.refs
            self.nodes, self.refs = [], []

    def unique(self, qn: str, line: int) -> str:
        """A repeated name gets its line."""
        qn = f"{qn}@{line}" if qn in self.taken else qn
        self.taken.add(qn)
        return qn

    def add(self, label: str, name: str, qn: str, at: ast.AST, visibility: str = "", **properties: str) -> str:
        first, last = at.lineno + self.line, (at.end_lineno or at.lineno) + self.line
        qn = self.unique(qn, first)
        self.nodes.append(Node(label, name, qn, first, last, visibility, {k: v for k, v in properties.items() if v}))
        return qn

    def body(self, statements: list[ast.stmt], scope: str, owner: str | None) -> None:
        for s in statements:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                self.function(s, scope, owner)
            elif isinstance(s, ast.ClassDef):
                qn = self.add("Struct", s.name, f"{scope}::{s.name}", s, visibility(s.name))
                self.refs.append(Ref("Defines", scope, qn))
                for base in s.bases:
                    self.refs.append(Ref("Extends", qn, ast.unparse(base).replace(".", "::")))
                self.body(s.body, qn, qn)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    self.imported(scope, s, a.name.replace(".", "::"), a.asname or "", False)
            elif isinstance(s, ast.ImportFrom):
                for a in s.names:
                    module = (s.module or "").replace(".", "::")
                    path = "::" * bool(s.level) + "::".join(x for x in (module, a.name) if x)
                    self.imported(scope, s, path, a.asname or "", a.name == "*")
            elif isinstance(s, ast.Assign | ast.AnnAssign) and owner is None:
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z0-9_]+", t.id) and re.search("[A-Z]", t.id):
                        qn = self.add("Constant", t.id, f"{scope}::{t.id}", s, type_annotation=ast.unparse(s.annotation) if isinstance(s, ast.AnnAssign) else "")
                        self.refs.append(Ref("Defines", scope, qn))
                self.calls(s, scope)
            elif isinstance(s, ast.If | ast.Try | ast.With):
                self.body([x for f in ("body", "orelse", "finalbody") for x in getattr(s, f, [])], scope, owner)

    def function(self, s: ast.FunctionDef | ast.AsyncFunctionDef, scope: str, owner: str | None) -> None:
        is_async = "true" if isinstance(s, ast.AsyncFunctionDef) else "false"
        receiver = {"receiver_type": owner.rsplit("::", 1)[-1]} if owner else {}
        qn = self.add("Method" if owner else "Function", s.name, f"{scope}::{s.name}", s, visibility(s.name), is_async=is_async, **receiver)
        self.refs.append(Ref("HasMethod" if owner else "Defines", owner or scope, qn))
        for x in s.body:
            self.calls(x, qn)

    def imported(self, scope: str, at: ast.AST, path: str, alias: str, glob: bool) -> None:
        qn = self.add("Import", path, f"{scope}::import {path}", at, path=path, alias=alias, is_glob="true" if glob else "false")
        self.refs.append(Ref("Defines", scope, qn))

    def calls(self, tree: ast.AST, caller: str) -> None:
        for c in ast.walk(tree):
            if isinstance(c, ast.Call) and isinstance(c.func, ast.Name):
                line = c.lineno + self.line
                qn = f"{caller}::call@{line}:{c.col_offset}#{line}.{c.col_offset}-{c.end_lineno + self.line}.{c.end_col_offset}"
                self.nodes.append(Node("CallSite", c.func.id, qn, line, line, "", {"callee_name": c.func.id, "caller_qn": caller, "col": str(c.col_offset)}))
                self.refs.append(Ref("Defines", caller, qn))
