"""A tokenizer for languages with braces: names, numbers, strings and signs, with their places; comments are dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_SIGNS = r"::|->|=>|\.\.\.|\.\.=|\.\.|&&|\|\||[-+*/%^&|=!<>]=|[{}()\[\];:,.<>=+\-*/%!?@#&|^~$\\'`]"
_NAME = r"[^\W\d]\w*"
_NUMBER = r"\d(?:[\w.]|(?<=[eE])[+-])*"


class Token(NamedTuple):
    kind: str  # name, number, text or sign
    text: str
    start: int
    end: int
    line: int
    col: int


def _pattern(language: str) -> re.Pattern:
    texts = [r'"(?:\\.|[^"\\\n])*"']
    if language == "rust":
        texts = [r'b?r(#*)".*?"\1', r'b?"(?:\\.|[^"\\])*"', r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"]
    elif language in ("typescript", "kotlin", "swift", "java"):
        texts = [r'""".*?"""', r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", *([r"`(?:\\.|[^`\\])*`"] if language == "typescript" else [])]
    elif language == "go":
        texts += [r"`[^`]*`", r"'(?:\\.|[^'\\\n])+'"]
    else:
        texts = [r'@?"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])+'"]
    return re.compile("|".join([r"(?P<space>\s+)", r"(?P<line>//[^\n]*)", r"(?P<block>/\*)", f"(?P<text>{'|'.join(f'(?:{t})' for t in texts)})".replace(r"\1", r"(?P=hashes)").replace("(#*)", "(?P<hashes>#*)"), rf"(?P<life>'{_NAME})" if language == "rust" else r"(?P<life>(?!))", rf"(?P<name>{_NAME})", f"(?P<number>{_NUMBER})", f"(?P<sign>{_SIGNS})", r"(?P<other>.)"]), re.S)


_PATTERNS: dict[str, re.Pattern] = {}
_NESTED = {"rust", "kotlin", "swift"}


_COMMENT = re.compile(r"/\*|\*/")


def tokenise(source: str, language: str) -> Iterator[Token]:
    """Never fails: what can't be read is skipped; an open comment or string ends the text."""
    pattern = _PATTERNS.setdefault(language, _pattern(language))
    at, line, begin, size, match = 0, 1, 0, len(source), pattern.match
    while at < size:
        m = match(source, at)
        kind, end = m.lastgroup, m.end()
        if kind in ("name", "sign", "number"):  # on one line
            yield Token(kind, m[0], at, end, line, at - begin)
            at = end
            continue
        if kind == "hashes":
            kind = "text"
        if kind == "block":
            depth = 1
            while depth and (n := _COMMENT.search(source, end)):
                depth = depth - 1 if n[0] == "*/" else depth + (language in _NESTED)
                end = n.end()
            if depth:
                end = len(source)
        elif kind in ("text", "life"):
            yield Token("sign" if kind == "life" else kind, m[0], at, end, line, at - begin)
        if lines := source.count("\n", at, end):
            line += lines
            begin = source.rfind("\n", at, end) + 1
        at = end


def pairs(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket the place of its closing one; an open one closes at the end."""
    opens, out = [], {}
    closing = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "sign":
            continue
        if t.text in "([{" and len(t.text) == 1:
            opens.append(i)
        elif t.text in closing:
            while opens:
                j = opens.pop()
                out[j] = i
                if tokens[j].text == closing[t.text]:
                    break
    for j in opens:
        out[j] = len(tokens) - 1
    return out
