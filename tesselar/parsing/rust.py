"""Rust: items, use trees, impls, derives, calls and macros."""

from __future__ import annotations

import re

from tesselar.parsing.base import Extractor


class Rust(Extractor):
    language = "rust"
    methods_called = False
    numbered = False

    def items(self, i: int, end: int, scope: str, owner: str | None) -> None:
        derives: list[str] = []
        while i < end if derives else self.going(i, end):
            if self.text(i) == "#":
                j = i + 2 if self.text(i + 1) == "!" else i + 1
                stop = self.close.get(j, j)
                if self.text(j + 1) == "derive":
                    derives += [self.text(k) for k in range(j + 3, stop - 1) if self.is_name(k) and self.text(k + 1) != "::"]
                i = stop + 1
                continue
            begin, visibility, flags = i, "", set()
            if self.text(i) == "pub":
                i = self.close[i + 1] + 1 if self.text(i + 1) == "(" else i + 1
                visibility = self.between(begin, i)
            while self.text(i) in ("async", "unsafe", "const", "extern", "default") and (self.text(i + 1) in ("fn", "async", "unsafe", "extern", "const", "trait", "impl") or self.tokens[i + 1 : i + 2] and self.tokens[i + 1].kind == "text"):
                flags.add(self.text(i))
                i += 2 if i + 1 < end and self.tokens[i + 1].kind == "text" else 1
            word = self.text(i)
            stop = self.statement(i, end)
            if word in ("use", "static", "const", "type"):
                stop = min(end, self.until(i, end, ";") + 1)
            if word == "fn":
                self.function(i, stop, begin, scope, owner, visibility, "async" in flags)
            elif word in ("struct", "union"):
                qn = self.struct(i, stop, begin, scope, visibility)
                self.derive(qn, derives)
            elif word == "enum":
                qn = self.define(scope, None, "Enum", self.text(i + 1), begin, stop, visibility)
                self.derive(qn, derives)
                self.variants(self.until(i, stop, "{"), qn)
            elif word == "trait":
                self.trait(i, stop, begin, scope, visibility)
            elif word == "impl":
                self.impl(i, stop, scope)
            elif word in ("const", "static") and owner is None:
                k = i + 2 if self.text(i + 1) == "mut" else i + 1
                typed = self.until(k, stop, "=", ";")
                self.define(scope, None, "Constant", self.text(k), begin, stop, visibility, type_annotation=self.between(k + 2, typed))
            elif word == "type" and owner is None:
                eq = self.until(i, stop, "=")
                self.define(scope, None, "TypeAlias", self.text(i + 1), begin, stop, visibility, target_type=self.between(eq + 1, stop - 1))
            elif word == "use":
                for path, alias, glob in self.use_tree(i + 1, stop - 1, ""):
                    self.imported(scope, path, begin, stop, alias, glob)
            elif word == "mod":
                qn = self.define(scope, None, "Module", self.text(i + 1), begin, stop, visibility)
                if self.text(i + 2) == "{":
                    self.items(i + 3, self.close[i + 2], qn, None)
            elif word == "macro_rules":
                stop = self.statement(i, end)
            derives = []
            i = max(stop, begin + 1)

    def function(self, i: int, stop: int, begin: int, scope: str, owner: str | None, visibility: str, is_async: bool) -> None:
        body = self.until(i, stop, "{", ";")
        qn = self.callable(scope, owner, self.text(i + 1), begin, stop, visibility, is_async="true" if is_async else "false")
        if self.text(body) == "{":
            self.call_sites(body, self.close[body], qn)

    def struct(self, i: int, stop: int, begin: int, scope: str, visibility: str) -> str:
        qn = self.define(scope, None, "Struct", self.text(i + 1), begin, stop, visibility)
        body = self.until(i, stop, "{", ";", "(")
        if self.text(body) == "{":
            self.fields(body + 1, self.close[body], qn)
        return qn

    def fields(self, i: int, end: int, owner: str) -> None:
        while i < end:
            if self.text(i) == "#":
                i = self.close.get(i + 1, i + 1) + 1
                continue
            begin = i
            if self.text(i) == "pub":
                i = self.close[i + 1] + 1 if self.text(i + 1) == "(" else i + 1
            stop = i + 2
            while stop < end and self.text(stop) != ",":
                stop = self.angles(stop, end) if self.text(stop) == "<" else self.close.get(stop, stop) + 1
            if self.is_name(i) and self.text(i + 1) == ":":
                qn = self.node("Field", self.text(i), f"{owner}::{self.text(i)}", begin, stop, self.between(begin, i), type_annotation=self.between(i + 2, stop))
                self.ref("HasField", owner, qn)
            i = stop + 1

    def variants(self, body: int, owner: str) -> None:
        i, end = body + 1, self.close.get(body, body)
        while i < end:
            if self.text(i) == "#":
                i = self.close.get(i + 1, i + 1) + 1
                continue
            stop = self.until(i, end, ",")
            if self.is_name(i):
                qn = self.node("Variant", self.text(i), f"{owner}::{self.text(i)}", i, stop)
                self.ref("HasVariant", owner, qn)
            i = stop + 1

    def trait(self, i: int, stop: int, begin: int, scope: str, visibility: str) -> None:
        qn = self.define(scope, None, "Trait", self.text(i + 1), begin, stop, visibility)
        body = self.until(i, stop, "{")
        k = self.angles(i + 2, body)
        if self.text(k) == ":":
            for part in re.split(r"\+", re.sub(r"<[^<>]*>", "", self.between(k + 1, self.until(k, body, "where")))):
                if part.strip() and not part.strip().startswith("'"):
                    self.ref("Extends", qn, part.strip())
        self.items(body + 1, self.close.get(body, body), qn, qn)

    def impl(self, i: int, stop: int, scope: str) -> None:
        body = self.until(i, stop, "{", ";")
        k = self.angles(i + 1, body)
        head = self.until(k, body, "where")
        split = next((j for j in range(k, head) if self.text(j) == "for"), None)
        kind = self.between(split + 1 if split else k, head)
        name = re.sub(r"<.*", "", kind, flags=re.S).strip().lstrip("&").split("::")[-1]
        qn = f"{scope}::{name}"
        if split:
            self.ref("Implements", qn, re.sub(r"<.*", "", self.between(k, split), flags=re.S).strip())
        if self.text(body) == "{":
            self.items(body + 1, self.close[body], qn, qn)

    def derive(self, qn: str, derives: list[str]) -> None:
        for d in derives:
            self.ref("DeriveImplements", qn, d)

    def use_tree(self, i: int, end: int, prefix: str) -> list[tuple[str, str, bool]]:
        """The leaves of a use tree: path, alias, whether it takes all."""
        join = lambda tail: "::".join(x for x in (prefix, tail) if x)
        path = []
        while i < end and self.text(i) not in ("{", "*", "as", ","):
            if self.text(i) != "::":
                path.append(self.text(i))
            i += 1
        here = join("::".join(path))
        if self.text(i) == "{" and i < end:
            out, k, stop = [], i + 1, self.close[i]
            while k < stop:
                j = self.until(k, stop, ",")
                if self.text(k) == "self" and j - k in (1, 3):
                    out.append((here, self.text(k + 2) if j - k == 3 else "", False))
                else:
                    out += self.use_tree(k, j, here)
                k = j + 1
            return out
        if self.text(i) == "*" and i < end:
            return [(f"{here}::*", "", True)]
        return [(here, self.text(i + 1) if self.text(i) == "as" and i < end else "", False)] if here else []
