"""What all extractors share: emitted nodes and references, call sites, and walks over brackets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

from tesselar.parsing.tokens import Token, pairs, tokenise

# Words that stand before a parenthesis and call nothing.
NO_CALL = {"if", "for", "while", "match", "switch", "return", "catch", "when", "guard", "fn", "fun", "func", "function", "sizeof", "typeof", "in", "as", "let", "var", "val", "else", "do", "try", "await", "yield", "super", "this", "self", "where", "case", "throw", "delete", "instanceof", "synchronized", "defer", "alignof", "decltype", "static_assert", "mut", "loop", "unsafe", "async", "and", "or", "not"}

WINDOW = 200_000  # tokens that are held at once; more only if a single item has more


@dataclass
class Node:
    label: str
    name: str
    qualified_name: str
    start_line: int = 0
    end_line: int = 0
    visibility: str = ""
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class Ref:
    kind: str
    from_qualified_name: str
    to_qualified_name: str


class Extractor:
    """A file's tokens, and what is found in them. A language defines items().

    Tokens are read in windows, so that a file of any length takes the memory of one: items in the first half are taken
    off, and the rest is read on. An item that comes to the end of its window is read again in one of twice the size.
    """

    language = ""
    methods_called = True  # whether a call after a dot is a call site, by its last name
    numbered = True  # whether callables and call sites are numbered in their file

    def __init__(self, source: str, path: str):
        self.source, self.path = source, path
        self.tokens: list[Token] = []
        self.close: dict[int, int] = {}
        self.nodes: list[Node] = []
        self.refs: list[Ref] = []
        self.seq = 0
        self.half: int | None = None  # where the outermost items pause, before the last window
        self.paused: int | None = None

    def parse(self) -> tuple[list[Node], list[Ref]]:
        """All at once."""
        nodes, refs = [], []
        for n, r in self.parts():
            nodes += n
            refs += r
        return nodes, refs

    def parts(self) -> Iterator[tuple[list[Node], list[Ref]]]:
        """What is found, window by window."""
        more, size = self.stream(), WINDOW
        held: list[Token] = []
        while True:
            held += islice(more, size - len(held))
            last = len(held) < size
            self.tokens, self.close = held, pairs(held)
            self.half, self.paused = None if last else size // 2, None
            seq = self.seq
            self.items(0, len(held), self.path, None)
            if last:
                yield self.nodes, self.refs
                return
            if self.paused is None or self.paused >= size:
                self.nodes, self.refs, self.seq = [], [], seq
                size *= 2
                continue
            yield self.nodes, self.refs
            self.nodes, self.refs = [], []
            held, size = held[self.paused :], max(WINDOW, size // 2)

    def stream(self) -> Iterator[Token]:
        return tokenise(self.source, self.language)

    def going(self, i: int, end: int) -> bool:
        """Whether there are items on from i. The outermost ones pause in the second half of a window."""
        if self.half is not None and i >= self.half and end == len(self.tokens) and self.paused is None:
            self.paused = i
            return False
        return i < end

    def items(self, i: int, end: int, scope: str, owner: str | None) -> None:
        raise NotImplementedError

    # Tokens.

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def between(self, i: int, j: int) -> str:
        """The source from token i to before token j."""
        return self.source[self.tokens[i].start : self.tokens[j - 1].end] if i < j <= len(self.tokens) else ""

    def until(self, i: int, end: int, *signs: str) -> int:
        """The next of these signs outside of brackets."""
        while i < end and self.text(i) not in signs:
            i = self.close.get(i, i) + 1
        return min(i, end)

    def statement(self, i: int, end: int) -> int:
        """After the item at i: past its block, or its semicolon."""
        j = self.until(i, end, "{", ";")
        return min(end, (self.close.get(j, j) if self.text(j) == "{" else j) + 1)

    def angles(self, i: int, end: int) -> int:
        """After the generic parameters at i, if any."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < end:
            t = self.text(i)
            if t in "([{" and len(t) == 1:
                i = self.close.get(i, i)
            depth += (t == "<") - (t == ">")
            i += 1
            if not depth:
                break
        return i

    # Findings.

    def node(self, label: str, name: str, qn: str, a: int, b: int, visibility: str = "", **properties: str) -> str:
        """Adds a node from token a to before token b."""
        first, last = self.tokens[a], self.tokens[max(a, min(b, len(self.tokens)) - 1)]
        self.nodes.append(Node(label, name, qn, first.line, last.line + last.text.count("\n"), visibility, {k: v for k, v in properties.items() if v}))
        return qn

    def ref(self, kind: str, a: str, b: str) -> None:
        self.refs.append(Ref(kind, a, b))

    def number(self) -> str:
        self.seq += 1
        return f"#{self.seq}" if self.numbered else ""

    def define(self, scope: str, owner: str | None, label: str, name: str, a: int, b: int, visibility: str = "", **properties: str) -> str:
        """A type, constant or the like, with its Defines reference."""
        qn = self.node(label, name, f"{scope}::{name}", a, b, visibility, **properties)
        self.ref("Defines", scope, qn)
        return qn

    def callable(self, scope: str, owner: str | None, name: str, a: int, b: int, visibility: str = "", **properties: str) -> str:
        label = "Method" if owner else "Function"
        if owner:
            properties["receiver_type"] = owner.rsplit("::", 1)[-1]
        qn = self.node(label, name, f"{scope}::{name}{self.number()}", a, b, visibility, **properties)
        self.ref("HasMethod" if owner else "Defines", owner or scope, qn)
        return qn

    def imported(self, scope: str, path: str, a: int, b: int, alias: str = "", glob: bool = False) -> None:
        qn = f"{scope}::{'use ' if self.language == 'rust' else 'import '}{path}"
        self.node("Import", path, qn, a, b, path=path, alias=alias, is_glob="true" if glob else "false")
        self.ref("Defines", scope, qn)

    def call_sites(self, i: int, end: int, caller: str) -> None:
        """Names before a parenthesis, with what qualifies them; macros with their sign."""
        for k in range(i, end):
            t = self.tokens[k]
            if t.kind != "name":
                continue
            after = self.angles(k + 1, end) if self.text(k + 1) == "<" and self.language in ("java", "kotlin", "typescript", "cpp") else k + 1
            if self.text(k + 1) == "::" and self.text(k + 2) == "<":
                after = self.angles(k + 2, end)
            macro = self.language == "rust" and self.text(k + 1) == "!" and self.text(k + 2) in ("(", "[", "{")
            if not macro and (self.text(after) != "(" or after >= end or t.text in NO_CALL):
                continue
            first = k
            while self.text(first - 1) in ("::",) and self.is_name(first - 2) and first - 2 >= i:
                first -= 2
            dotted = self.text(first - 1) in (".", "?.", "->") or self.text(first - 1) == "?"
            if dotted and not self.methods_called:
                continue
            if self.text(first - 1) in ("fn", "func", "fun", "function") or (self.language == "typescript" and self.text(first - 1) == "new"):
                continue
            name = t.text if self.methods_called else "".join(x.text for x in self.tokens[first : k + 1])
            callee = name + "!" if macro else name
            stop = self.close.get(k + 2 if macro else after, k)
            self.site(caller, callee, self.tokens[first], self.tokens[stop])

    def site(self, caller: str, callee: str, first: Token, last: Token) -> None:
        if self.numbered:
            qn = f"{caller}::call@{first.line}:{first.col + 1}{self.number()}"
        else:
            qn = f"{caller}::call@{first.line}:{first.col}#{first.start}-{last.end}"
        self.nodes.append(Node("CallSite", callee, qn, first.line, first.line, "", {"callee_name": callee, "caller_qn": caller, "col": str(first.col)}))
        self.ref("Defines", caller, qn)
