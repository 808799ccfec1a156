"""TypeScript, Java, Kotlin, Swift, Go, C, C++ and Objective-C."""

from __future__ import annotations

import re

from tesselar.parsing.base import Extractor
from tesselar.parsing.tokens import tokenise

MODIFIERS = {"public", "private", "protected", "internal", "open", "fileprivate", "static", "final", "abstract", "override", "suspend", "inline", "data", "sealed", "inner", "companion", "lateinit", "const", "mutating", "async", "readonly", "export", "default", "declare", "virtual", "explicit", "extern", "constexpr", "native", "synchronized", "transient", "volatile", "strictfp", "operator", "infix", "tailrec", "external", "weak", "lazy", "required", "convenience", "indirect", "nonisolated", "expect", "actual", "value", "typedef"}
ACCESS = {"public", "private", "protected", "internal", "open", "fileprivate"}


class Braces(Extractor):
    """Items with modifiers in front. types: keyword to label."""

    types: dict[str, str] = {}
    functions: set[str] = set()
    default_visibility = ""
    inherits = "Extends"

    def head(self, i: int, end: int) -> tuple[int, set[str]]:
        """After annotations and modifiers; the modifiers."""
        found = set()
        while i < end:
            if self.text(i) == "@" and self.is_name(i + 1) and self.text(i + 1) not in self.types and self.text(i + 1) not in ("interface", "implementation", "protocol", "end", "property", "import"):
                i += 2
                while self.text(i) == ".":
                    i += 2
                i = self.close[i] + 1 if self.text(i) == "(" else i
            elif self.text(i) in MODIFIERS and (self.is_name(i + 1) or self.text(i + 1) in ("(", "*", "[", "{", "<", "@", "~")):
                found.add(self.text(i))
                i = self.close[i + 1] + 1 if self.text(i + 1) == "(" and self.text(i) in ACCESS else i + 1
            else:
                break
        return i, found

    def seen(self, modifiers: set[str]) -> str:
        return next((m for m in sorted(modifiers) if m in ACCESS), self.default_visibility)

    def body_of(self, i: int, end: int) -> tuple[int, int]:
        """The opening brace of the item at i, if it has one before a semicolon, and where the item ends."""
        j = self.until(i, end, "{", ";")
        return (j, self.close.get(j, j) + 1) if self.text(j) == "{" else (end, j + 1)

    def supertypes(self, text: str) -> list[str]:
        bare = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"\([^()]*\)", "", text)))
        return [x.strip() for x in re.split(r",|&", bare) if re.fullmatch(r"[\w.:]+", x.strip())]


class TypeScript(Braces):
    language, methods_called, numbered = "typescript", False, False
    types = {"class": "Struct", "interface": "Trait", "enum": "Enum"}

    def items(self, i, end, scope, owner):
        while self.going(i, end):
            begin = i
            i, mods = self.head(i, end)
            seen, word = "pub" if "export" in mods else "", self.text(i)
            if word == "import":
                i = self.import_(i, end, scope)
                continue
            if word in self.types and self.is_name(i + 1):
                body, stop = self.body_of(i, end)
                qn = self.define(scope, None, self.types[word], self.text(i + 1), begin, stop, seen)
                self.heritage(i + 2, body, qn)
                if body < end:
                    self.variants(body, qn) if word == "enum" else self.members(body + 1, self.close[body], qn)
            elif word == "function":
                k = i + 2 if self.text(i + 1) == "*" else i + 1
                body, stop = self.body_of(k, end)
                qn = self.callable(scope, None, self.text(k), begin, stop, seen, is_async="true" if "async" in mods else "false")
                if body < end:
                    self.call_sites(body, self.close[body], qn)
            elif word == "type" and self.text(i + 2) in ("=", "<"):
                eq = self.until(i, end, "=")
                stop = self.line_end(eq, end)
                self.define(scope, None, "TypeAlias", self.text(i + 1), begin, stop, seen, target_type=self.between(eq + 1, stop).rstrip(";"))
            elif (word in ("const", "let", "var") or "const" in mods) and self.is_name(i + (word in ("const", "let", "var"))):
                i += word in ("const", "let", "var")
                stop = self.line_end(i, end)
                arrow = next((k for k in range(i, stop) if self.text(k) == "=>"), None)
                eq = self.until(i, stop, "=")
                if arrow and (self.text(eq + 1) in ("(", "async", "<") or self.is_name(eq + 1)) and "{" not in [self.text(k) for k in range(eq, arrow) if k not in self.close]:
                    qn = self.callable(scope, None, self.text(i), begin, stop, seen, is_async="true" if self.text(eq + 1) == "async" else "false")
                    self.call_sites(arrow, stop, qn)
                elif word == "const" or "const" in mods:
                    qn = self.define(scope, None, "Constant", self.text(i), begin, stop, seen, type_annotation=self.between(i + 2, eq) if self.text(i + 1) == ":" else "")
                    self.call_sites(eq, stop, qn)
            else:
                stop = self.line_end(i, end)
            i = max(stop, begin + 1)

    def line_end(self, i, end):
        """After the statement: at a semicolon, or where a line ends outside of brackets and nothing continues it."""
        while i < end:
            if self.text(i) == ";":
                return i + 1
            last = self.close.get(i, i)
            if last + 1 < end and self.tokens[last + 1].line > self.tokens[last].line and self.text(last) not in ("=", "=>", ",", "|", "&", "+", "?", ":", "&&", "||", ".") and self.text(last + 1) not in (".", "|", "&", "?", ":", "&&", "||", "="):
                return last + 1
            i = last + 1
        return end

    def import_(self, i, end, scope):
        stop = self.line_end(i, end)
        source = next((k for k in range(i, stop) if self.tokens[k].kind == "text"), None)
        if source is None:
            return stop
        module = self.text(source)[1:-1].replace("/", "::")
        named = self.until(i, source, "{")
        if source == i + 1:
            self.imported(scope, module, i, stop)
        if self.is_name(i + 1) and self.text(i + 1) not in ("type", "from"):
            self.imported(scope, f"{module}::default", i, stop, self.text(i + 1))
        star = next((k for k in range(i, source) if self.text(k) == "*"), None)
        if star:
            self.imported(scope, f"{module}::*", i, stop, self.text(star + 2), True)
        if named < source:
            k = named + 1
            while k < self.close[named]:
                j = self.until(k, self.close[named], ",")
                k += self.text(k) == "type" and j - k > 1
                if self.is_name(k):
                    self.imported(scope, f"{module}::{self.text(k)}", i, stop, self.text(k + 2) if self.text(k + 1) == "as" else "")
                k = j + 1
        return stop

    def heritage(self, i, body, qn):
        i = self.angles(i, body)
        marks = [k for k in range(i, body) if self.text(k) in ("extends", "implements")] + [body]
        for a, b in zip(marks, marks[1:], strict=False):
            for name in self.supertypes(self.between(a + 1, b)):
                self.ref("Extends" if self.text(a) == "extends" else "Implements", qn, name)

    def variants(self, body, owner):
        i, end = body + 1, self.close[body]
        while i < end:
            stop = self.until(i, end, ",")
            if self.is_name(i):
                qn = self.node("Variant", self.text(i), f"{owner}::{self.text(i)}", i, stop)
                self.ref("HasVariant", owner, qn)
            i = stop + 1

    def members(self, i, end, owner):
        while i < end:
            begin = i
            i, mods = self.head(i, end)
            if self.text(i) in ("get", "set") and self.is_name(i + 1):
                i += 1
            name, k = self.text(i), i + 1
            k += self.text(k) in ("?", "!")
            k = self.angles(k, end)
            if self.text(k) == "(" and self.is_name(i):
                j = self.close[k] + 1
                while j < end and self.text(j) not in ("{", ";") and self.tokens[j].line == self.tokens[j - 1].line:
                    j = self.close.get(j, j) + 1 if self.text(j) != "{" else j
                has_body = self.text(j) == "{"
                stop = self.close[j] + 1 if has_body else j + (self.text(j) == ";")
                qn = self.callable(owner, owner, name, begin, stop, self.seen(mods), is_async="true" if "async" in mods else "false")
                if has_body:
                    self.call_sites(j, self.close[j], qn)
                i = stop
                continue
            stop = self.line_end(i, end)
            if self.is_name(i) and self.text(k) in (":", "=", ";"):
                typed = self.until(k, stop, "=", ";")
                qn = self.node("Field", name, f"{owner}::{name}", begin, stop, self.seen(mods), type_annotation=self.between(k + 1, typed) if self.text(k) == ":" else "")
                self.ref("HasField", owner, qn)
            i = max(stop, begin + 1)


class Declared(Braces):
    """Languages that declare functions as type, name, parameters, body: Java, C, C++ and Objective-C's C."""

    def declared(self, i, end, begin, scope, owner, seen):
        """The function whose parameters open at the first parenthesis of the statement, if it is one; where the statement ends."""
        k = self.until(i, end, "(", "{", ";", "=")
        body, stop = self.body_of(k, end)
        if self.text(k) != "(" or not self.is_name(k - 1) or self.text(k - 1) in ("if", "for", "while", "switch", "return", "catch", "synchronized", "sizeof"):
            return None, (self.until(k, end, ";") + 1 if self.text(k) == "=" else stop)
        name, where, receiver = self.text(k - 1), scope, owner
        if self.text(k - 2) == "::" and self.is_name(k - 3):
            receiver = where = f"{scope}::{self.text(k - 3)}"
        if self.text(k - 2) == "~":
            name = "~" + name
        qn = self.callable(where, receiver, name, begin, stop, seen)
        if body < end:
            self.call_sites(body, self.close[body], qn)
        return qn, stop


class Java(Declared):
    language, default_visibility = "java", "package"
    types = {"class": "Struct", "record": "Struct", "interface": "Trait", "enum": "Enum"}

    def items(self, i, end, scope, owner):
        while self.going(i, end):
            begin = i
            i, mods = self.head(i, end)
            word = self.text(i)
            if word == "@" and self.text(i + 1) == "interface":
                i, word = i + 1, "interface"
            if word in ("import", "package"):
                stop = self.until(i, end, ";") + 1
                if word == "import":
                    k = i + 2 if self.text(i + 1) == "static" else i + 1
                    path = self.between(k, stop - 1).replace(".", "::")
                    self.imported(scope, path, begin, stop, glob=path.endswith("*"))
                    self.ref("Imports", scope, path)
            elif word in self.types and self.is_name(i + 1):
                body, stop = self.body_of(i, end)
                qn = self.define(scope, None, self.types[word], self.text(i + 1), begin, stop, self.seen(mods))
                marks = [k for k in range(i, min(body, stop)) if self.text(k) in ("extends", "implements")] + [min(body, stop)]
                for a, b in zip(marks, marks[1:], strict=False):
                    for name in self.supertypes(self.between(a + 1, b)):
                        self.ref("Extends" if self.text(a) == "extends" else "Implements", qn, name)
                if body < end:
                    first = self.enumerators(body, qn) if word == "enum" else body + 1
                    self.items(first, self.close[body], qn, qn)
            elif owner and self.text(i) == "{":
                stop = self.close[i] + 1
            else:
                qn, stop = self.declared(self.angles(i, end), end, begin, scope, owner, self.seen(mods))
                if qn is None and owner:
                    k = self.until(i, stop, "=", ";", ",")
                    if self.is_name(k - 1) and k - 1 > i:
                        self.define(scope, None, "Constant", self.text(k - 1), begin, stop, self.seen(mods), type_annotation=self.between(i, k - 1))
            i = max(stop, begin + 1)

    def enumerators(self, body, owner):
        i, end = body + 1, self.close[body]
        last = self.until(i, end, ";")
        while i < last:
            stop = self.until(i, last, ",")
            if self.is_name(i):
                self.define(owner, None, "Constant", self.text(i), i, stop, "public")
            i = stop + 1
        return last + 1


class Kotlin(Braces):
    language, default_visibility = "kotlin", "public"
    types = {"class": "Struct", "object": "Struct", "interface": "Trait"}

    def items(self, i, end, scope, owner):
        while self.going(i, end):
            begin = i
            i, mods = self.head(i, end)
            word, label = self.text(i), None
            if word == "enum" and self.text(i + 1) == "class":
                i, word, label = i + 1, "class", "Enum"
            if word == "import":
                line = self.tokens[i].line
                stop = next((k for k in range(i, end) if self.tokens[k].line > line), end)
                path = self.between(i + 1, next((k for k in range(i, stop) if self.text(k) == "as"), stop)).replace(".", "::")
                self.imported(scope, path, begin, stop, glob=path.endswith("*"))
                self.ref("Imports", scope, path)
            elif word in self.types:
                name = self.text(i + 1) if self.is_name(i + 1) else "Companion"
                body, stop = self.header(i + 1, end)
                qn = self.define(scope, None, label or self.types[word], name, begin, stop, self.seen(mods))
                k = self.angles(i + 2, end)
                k = self.close[k] + 1 if self.text(k) == "(" else k
                if self.text(k) == ":":
                    for base in self.supertypes(self.between(k + 1, min(body, stop))):
                        self.ref("Extends", qn, base)
                if body < end:
                    first = Java.enumerators(self, body, qn) if label == "Enum" else body + 1
                    self.items(first, self.close[body], qn, qn)
            elif word == "fun":
                k = self.until(i, end, "(")
                body, stop = self.header(self.close.get(k, k) + 1, end)
                extension = self.text(k - 3) if self.text(k - 2) == "." else ""
                qn = self.callable(scope, owner, self.text(k - 1), begin, stop, self.seen(mods), extension_receiver=extension, is_async="true" if "suspend" in mods else "false")
                self.call_sites(body if body < end else self.close.get(k, k), stop, qn)
            elif word in ("val", "var") and self.is_name(i + 1):
                stop = self.line_of(i, end)
                eq = self.until(i, stop, "=")
                self.define(scope, None, "Constant", self.text(i + 1), begin, stop, self.seen(mods), type_annotation=self.between(i + 3, eq) if self.text(i + 2) == ":" else "")
            else:
                stop = self.line_of(i, end)
            i = max(stop, begin + 1)

    def line_of(self, i, end):
        while i < end:
            last = self.close.get(i, i)
            if last + 1 >= end or self.tokens[last + 1].line > self.tokens[last].line and self.text(last) not in ("=", ",", ":") and self.text(last + 1) not in (".", ":", "?", "{"):
                return min(end, last + 1)
            i = last + 1
        return end

    def header(self, i, end):
        """The opening brace of a declaration, which may have none, and its end."""
        while i < end:
            if self.text(i) == "{":
                return i, self.close[i] + 1
            last = self.close.get(i, i)
            if self.text(i) == "=":
                return end, self.line_of(i, end)
            if last + 1 >= end or self.tokens[last + 1].line > self.tokens[last].line and self.text(last + 1) not in ("{", ":", "=", ".") and self.text(last) not in (",", ":"):
                return end, min(end, last + 1)
            i = last + 1
        return end, end


class Swift(Kotlin):
    language, default_visibility = "swift", "internal"
    types = {"class": "Struct", "struct": "Struct", "actor": "Struct", "extension": "Struct", "enum": "Enum", "protocol": "Trait"}

    def items(self, i, end, scope, owner):
        while self.going(i, end):
            begin = i
            i, mods = self.head(i, end)
            word = self.text(i)
            if word == "import":
                stop = self.line_of(i, end)
                self.imported(scope, self.between(i + 1, stop).replace(".", "::"), begin, stop)
                self.ref("Imports", scope, self.between(i + 1, stop))
            elif word in self.types and self.is_name(i + 1):
                body, stop = self.header(i + 1, end)
                qn = self.define(scope, None, self.types[word], self.text(i + 1), begin, stop, self.seen(mods))
                k = self.angles(i + 2, end)
                if self.text(k) == ":":
                    for base in self.supertypes(self.between(k + 1, min(body, stop))):
                        self.ref("Extends", qn, base)
                if body < end:
                    self.items(body + 1, self.close[body], qn, qn)
            elif word in ("func", "init", "deinit", "subscript"):
                k = self.until(i, end, "(", "{")
                name = self.text(i + 1) if word == "func" else word
                body, stop = self.header(self.close.get(k, k) + 1 if self.text(k) == "(" else k, end)
                qn = self.callable(scope, owner, name, begin, stop, self.seen(mods))
                if body < end:
                    self.call_sites(body, self.close[body], qn)
            elif word in ("let", "var", "typealias") and self.is_name(i + 1):
                stop = self.line_of(i, end)
                eq = self.until(i, stop, "=", "{")
                self.define(scope, None, "Constant", self.text(i + 1), begin, stop, self.seen(mods), type_annotation=self.between(i + 3, eq) if self.text(i + 2) == ":" else "")
            elif word == "case" and owner:
                stop = self.line_of(i, end)
                for k in range(i + 1, stop):
                    if self.is_name(k) and self.text(k - 1) in ("case", ","):
                        self.define(scope, None, "Constant", self.text(k), begin, stop, self.seen(mods))
            else:
                stop = self.line_of(i, end)
            i = max(stop, begin + 1)


class Go(Braces):
    language = "go"

    def items(self, i, end, scope, owner):
        seen = lambda name: "public" if name[:1].isupper() else "package"
        while self.going(i, end):
            begin, word = i, self.text(i)
            stop = self.line(i, end)
            if word == "import":
                texts = range(i, stop) if self.text(i + 1) != "(" else range(i + 2, self.close[i + 1])
                for k in texts:
                    if self.tokens[k].kind == "text":
                        path = self.text(k)[1:-1].replace("/", "::")
                        self.imported(scope, path, k, k + 1, self.text(k - 1) if self.is_name(k - 1) and self.text(k - 1) != "import" else "")
                        self.ref("Imports", scope, path)
                stop = self.close[i + 1] + 1 if self.text(i + 1) == "(" else stop
            elif word == "func":
                receiver, k = None, i + 1
                if self.text(k) == "(":
                    receiver = re.sub(r"\[.*", "", self.between(k + 1, self.close[k]).split()[-1].lstrip("*"))
                    k = self.close[k] + 1
                body, stop = self.body_of(self.until(k, end, "("), end)
                own = f"{scope}::{receiver}" if receiver else None
                qn = self.callable(own or scope, own, self.text(k), begin, stop, seen(self.text(k)))
                if body < end:
                    self.call_sites(body, self.close[body], qn)
            elif word in ("type", "const", "var"):
                many = self.text(i + 1) == "("
                k, last = (i + 2, self.close[i + 1]) if many else (i + 1, stop)
                while k < last:
                    upto = min(last, self.line(k, last))
                    if word == "type" and self.is_name(k):
                        kind = self.text(k + 1)
                        if kind == "[":
                            kind = self.text(self.close[k + 1] + 1)
                        label = {"struct": "Struct", "interface": "Trait"}.get(kind, "TypeAlias")
                        self.define(scope, None, label, self.text(k), k, upto, seen(self.text(k)), target_type=self.between(k + 1 + (kind == "="), upto) if label == "TypeAlias" else "")
                    elif self.is_name(k):
                        self.define(scope, None, "Constant", self.text(k), k, upto, seen(self.text(k)))
                    k = max(upto, k + 1)
                stop = last + 1 if many else stop
            i = max(stop, begin + 1)

    def line(self, i, end):
        while i < end:
            last = self.close.get(i, i)
            if last + 1 >= end or self.tokens[last + 1].line > self.tokens[last].line or self.text(i) == ";":
                return min(end, last + 1)
            i = last + 1
        return end


class C(Declared):
    language, default_visibility = "c", "public"
    types = {"struct": "Struct", "union": "Struct", "enum": "Enum"}

    def parts(self):
        tokens = tokenise(self.source, self.language)
        token, line, at = next(tokens, None), 1, 0
        for m in re.finditer(r'^[ \t]*#[ \t]*(?:include|import)[ \t]*[<"]([^>"]+)[>"]', self.source, re.M):
            line, at = line + self.source.count("\n", at, m.start()), m.start()
            while token and token.line < line:
                token = next(tokens, None)
            if token is None:
                break
            self.tokens = [token]
            self.imported(self.path, m[1].replace("/", "::"), 0, 1)
            self.ref("Imports", self.path, m[1])
        yield self.nodes, self.refs
        self.nodes, self.refs = [], []
        yield from super().parts()

    def stream(self):
        return (t for t in super(C, self).stream() if not self.directive(t))

    def directive(self, token):
        """Whether the token stands in a preprocessor line, continued ones included."""
        if not hasattr(self, "_lines"):
            self._lines, more = set(), False
            for n, text in enumerate(self.source.split("\n"), 1):
                if more or text.lstrip().startswith("#"):
                    self._lines.add(n)
                    more = text.rstrip().endswith("\\")
                else:
                    more = False
        return token.line in self._lines

    def items(self, i, end, scope, owner):
        while self.going(i, end):
            begin = i
            typedef = self.text(i) == "typedef"
            i, mods = self.head(i, end)
            if owner and self.text(i) in ACCESS and self.text(i + 1) == ":":
                i += 2
                continue
            i, stop = self.item(i, end, begin, scope, owner, typedef or "typedef" in mods)
            i = max(stop, begin + 1)

    def item(self, i, end, begin, scope, owner, typedef):
        word = self.text(i)
        body, stop = self.body_of(i, end)
        if word in self.types and body < end and self.until(i, body, "(", "=", ";") == body:
            stop = self.until(self.close[body], end, ";") + 1
            k = i + 2 if self.text(i + 1) in ("class", "struct") else i + 1
            name = self.text(k) if self.is_name(k) else (self.text(stop - 2) if self.is_name(stop - 2) else "")
            if name:
                qn = self.define(scope, None, self.types[word], name, begin, stop, "public")
                self.inside(word, k + 1, body, qn)
            if typedef and self.is_name(stop - 2) and self.text(stop - 2) != name:
                self.define(scope, None, "Constant", self.text(stop - 2), begin, stop, "public")
            return i, stop
        if typedef:
            stop = self.until(i, end, ";") + 1
            last = next((k for k in range(stop - 2, i, -1) if self.is_name(k)), None)
            if last is not None:
                self.define(scope, None, "Constant", self.text(last), begin, stop, "public", type_annotation=self.between(i, last))
            return i, stop
        qn, stop = self.declared(i, end, begin, scope, owner, "public")
        if qn is None and owner:
            self.member(i, stop, begin, scope)
        return i, stop

    def inside(self, word, k, body, qn):
        if word == "enum":
            Java.enumerators(self, body, qn)

    def member(self, i, stop, begin, scope):
        pass


class Cpp(C):
    language = "cpp"
    types = {"struct": "Struct", "union": "Struct", "class": "Struct", "enum": "Enum"}

    def item(self, i, end, begin, scope, owner, typedef):
        word = self.text(i)
        if word == "namespace":
            body, stop = self.body_of(i, end)
            name = self.between(i + 1, body) or "anonymous" if body < end else ""
            if name:
                qn = self.define(scope, None, "Struct", name, begin, stop, "public")
                self.items(body + 1, self.close[body], qn, None)
            return i, stop
        if word == "template":
            after = self.angles(i + 1, end)
            return self.item(self.head(after, end)[0], end, begin, scope, owner, False)
        if word == "using":
            stop = self.until(i, end, ";") + 1
            k = i + 2 if self.text(i + 1) == "namespace" else i + 1
            self.imported(scope, self.between(k, stop - 1), begin, stop)
            return i, stop
        return super().item(i, end, begin, scope, owner, typedef)

    def inside(self, word, k, body, qn):
        if word == "enum":
            Java.enumerators(self, body, qn)
            return
        if self.text(k) == ":":
            for base in self.supertypes(re.sub(r"\b(public|private|protected|virtual)\b", "", self.between(k + 1, body))):
                self.ref("Extends", qn, base)
        self.items(body + 1, self.close[body], qn, qn)

    def member(self, i, stop, begin, scope):
        k = self.until(i, stop, "=", ";", "[", "{")
        if self.is_name(k - 1) and k - 1 > i:
            self.define(scope, None, "Constant", self.text(k - 1), begin, stop, "public", type_annotation=self.between(i, k - 1))


class ObjC(C):
    language = "objc"

    def items(self, i, end, scope, owner):
        while self.going(i, end):
            begin = i
            if self.text(i) == "@" and self.text(i + 1) in ("interface", "implementation", "protocol"):
                stop = next((k for k in range(i, end) if self.text(k) == "@" and self.text(k + 1) == "end"), end)
                if self.text(i + 3) in (";", ",") and self.text(i + 1) == "protocol":
                    i = self.until(i, end, ";") + 1
                    continue
                qn = self.define(scope, None, "Trait" if self.text(i + 1) == "protocol" else "Struct", self.text(i + 2), begin, stop + 2, "public")
                self.methods(i + 3, stop, qn)
                i = stop + 2
            elif self.text(i) == "@" and self.text(i + 1) in ("import", "class"):
                stop = self.until(i, end, ";") + 1
                if self.text(i + 1) == "import":
                    self.imported(scope, self.between(i + 2, stop - 1).replace(".", "::"), begin, stop)
                i = stop
            else:
                typedef = self.text(i) == "typedef"
                i, _ = self.head(i, end)
                _, stop = self.item(i, end, begin, scope, owner, typedef)
                i = max(stop, begin + 1)

    def methods(self, i, end, owner):
        while i < end:
            if self.text(i) in ("-", "+") and self.text(i + 1) == "(":
                k = self.close[i + 1] + 1
                stop = self.until(k, end, "{", ";")
                body = stop if self.text(stop) == "{" else None
                parts, j = [self.text(k)], k + 1
                while j < stop:
                    if self.text(j) == ":" and self.is_name(j - 1):
                        if j - 1 != k:
                            parts.append(self.text(j - 1))
                        parts[-1] += ":"
                    j = self.close.get(j, j) + 1
                last = self.close[body] + 1 if body else stop + 1
                qn = self.callable(owner, owner, "".join(parts), i, last, "public")
                if body:
                    self.call_sites(body, self.close[body], qn)
                    self.messages(body, self.close[body], qn)
                i = last
            else:
                i = self.close.get(i, i) + 1

    def messages(self, i, end, caller):
        """[receiver selector ...]: the first word of the selector."""
        for k in range(i, end):
            if self.text(k) == "[":
                first = self.close.get(k + 1, k + 1) + 1
                while self.text(first) == "." and self.is_name(first + 1):
                    first += 2
                if self.is_name(first) and self.text(first + 1) in (":", "]"):
                    self.site(caller, self.text(first), self.tokens[k], self.tokens[self.close.get(k, k)])
