"""Read-only graph pattern queries, compiled to DataFrame plans.

    [UNWIND list AS x] [OPTIONAL] MATCH pattern, ... [WHERE ...] [WITH items] RETURN [DISTINCT] items [ORDER BY ...] [SKIP n] [LIMIT n]

A pattern is a chain (a:Label {key: value})-[r:REL|REL]->(b). Clauses can follow each other. Edges carry their ends'
ids and labels, so a node is joined only when another of its columns is asked for. Values stay typed; text() gives
the rows as strings.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.graph import PropertyGraph

#: Words that a query may not hold, in whatever case, even within a literal.
WRITES = ["CREATE", "DELETE", "MERGE", "SET", "REMOVE", "DROP", "ALTER", "CALL", "LOAD"]
WRITE_PATTERN = rf"(?i)(?<![A-Za-z0-9_])({'|'.join(WRITES)})(?![A-Za-z0-9_])"
CLAUSES = ["OPTIONAL MATCH", "MATCH", "WHERE", "UNWIND", "WITH", "RETURN", "ORDER BY", "SKIP", "LIMIT"]
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+\.\d+|\d+)|(?P<name>`[^`]+`|[A-Za-z_]\w*)|(?P<sign><>|<=|>=|->|<-|\.\.|[-+*/=<>()\[\]{},.:|$]))""")


class CypherError(ValueError):
    """A query that can't be compiled. reason: a code for callers."""

    def __init__(self, message: str, reason: str = "query_syntax"):
        super().__init__(message)
        self.reason = reason


def is_read_only(query: str) -> bool:
    return not re.search(WRITE_PATTERN, query)


def read_only(query: Column) -> Column:
    """The same test for a column of queries."""
    return ~query.rlike(WRITE_PATTERN)


def escape(literal: str) -> str:
    """The literal's text for a place between single quotes."""
    return literal.replace("\\", "\\\\").replace("'", "\\'")


@dataclass
class _Item:
    expr: tuple
    name: str
    text: str


@dataclass
class _Scope:
    """What a clause has so far: rows, and what each variable is."""

    df: DataFrame | None = None
    labels: dict[str, str | None] = field(default_factory=dict)  # of nodes
    rels: set[str] = field(default_factory=set)
    values: set[str] = field(default_factory=set)
    joined: set[str] = field(default_factory=set)  # nodes of which the columns have been joined


class Compiler:
    def __init__(self, graph: PropertyGraph, query: str, params: dict | None = None):
        if not is_read_only(query):
            raise CypherError("only reading queries are run", "read_only_query_required")
        self.graph, self.params, self.query = graph, params or {}, query
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while query[at:].strip():
            m = _TOKEN.match(query, at)
            if not m:
                raise CypherError(f"can't read from: {query[at : at + 30]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind], m.start(kind), m.end(kind)))
            at = m.end()
        self.k, self.fresh = 0, 0

    # Tokens.

    def peek(self, n: int = 0) -> str:
        return self.tokens[self.k + n][1] if self.k + n < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        """Takes these words if they come next."""
        if all(self.peek(i).upper() == w for i, w in enumerate(words)) and all(self.tokens[self.k + i][0] == "name" for i in range(len(words))):
            self.k += len(words)
            return True
        return False

    def sign(self, s: str) -> bool:
        if self.peek() == s and self.tokens[self.k][0] == "sign":
            self.k += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.sign(s):
            raise CypherError(f"{s!r} is missing before {self.peek()!r}")

    def name(self) -> str:
        if self.k >= len(self.tokens) or self.tokens[self.k][0] != "name":
            raise CypherError(f"a name is missing before {self.peek()!r}")
        self.k += 1
        return self.tokens[self.k - 1][1].strip("`")

    # Expressions, as trees.

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.word("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.word("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.total()
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.sign(op):
                return (op, left, self.total())
        for words, op in ((("STARTS", "WITH"), "starts"), (("ENDS", "WITH"), "ends"), (("CONTAINS",), "contains"), (("IN",), "in")):
            if self.word(*words):
                return (op, left, self.total())
        if self.word("IS", "NOT", "NULL"):
            return ("not", ("null", left))
        if self.word("IS", "NULL"):
            return ("null", left)
        return left

    def total(self) -> tuple:
        left = self.term()
        while self.peek() in ("+", "-") and self.tokens[self.k][0] == "sign":
            op = self.peek()
            self.k += 1
            left = (op, left, self.term())
        return left

    def term(self) -> tuple:
        left = self.atom()
        while self.peek() in ("*", "/") and self.tokens[self.k][0] == "sign":
            op = self.peek()
            self.k += 1
            left = (op, left, self.atom())
        return left

    def atom(self) -> tuple:
        if self.k >= len(self.tokens):
            raise CypherError("the query ends too early")
        kind, text, *_ = self.tokens[self.k]
        if kind in ("text", "number"):
            self.k += 1
            return ("value", re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "text" else ast.literal_eval(text))
        if self.sign("-"):
            return ("-", ("value", 0), self.atom())
        if self.sign("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.sign("$"):
            name = self.name()
            if name not in self.params:
                raise CypherError(f"parameter {name} is missing")
            return ("value", self.params[name])
        if self.sign("["):
            out = []
            while not self.sign("]"):
                out.append(self.expression())
                self.sign(",")
            return ("list", out)
        if kind == "name" and text.upper() in ("TRUE", "FALSE", "NULL"):
            self.k += 1
            return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()])
        name = self.name()
        if self.sign("("):
            distinct = self.word("DISTINCT")
            args = []
            while not self.sign(")"):
                args.append(("star",) if self.sign("*") else self.expression())
                self.sign(",")
            return ("call", name.lower(), args, distinct)
        return ("property", name, self.name()) if self.sign(".") else ("variable", name)

    def items(self) -> list[_Item]:
        out = []
        while True:
            begin = self.tokens[self.k][2] if self.k < len(self.tokens) else 0
            expr = self.expression()
            text = self.query[begin : self.tokens[self.k - 1][3]]
            out.append(_Item(expr, self.name() if self.word("AS") else text, text))
            if not self.sign(","):
                return out

    # Patterns.

    def node(self) -> tuple[str, str | None, list]:
        self.need("(")
        name, label, where = "", None, []
        if self.peek() not in (":", ")", "{"):
            name = self.name()
        if self.sign(":"):
            label = self.name()
        if self.sign("{"):
            while not self.sign("}"):
                key = self.name()
                self.need(":")
                where.append((key, self.expression()))
                self.sign(",")
        self.need(")")
        if not name:
            self.fresh += 1
            name = f"_n{self.fresh}"
        return name, label, where

    def chain(self) -> list:
        out = [self.node()]
        while self.peek() in ("-", "<-"):
            back = self.sign("<-")
            if not back:
                self.need("-")
            name, kinds = "", []
            if self.sign("["):
                if self.peek() not in (":", "]"):
                    name = self.name()
                if self.sign(":"):
                    kinds.append(self.name())
                    while self.sign("|"):
                        kinds.append(self.name())
                self.need("]")
            if back:
                self.need("-")
            else:
                self.need("->")
            if not name:
                self.fresh += 1
                name = f"_r{self.fresh}"
            out.append((name, kinds, back, self.node()))
        return out

    # Plans.

    def nodes_as(self, name: str, label: str | None) -> DataFrame:
        nodes = self.graph.nodes if label is None else self.graph.scan(label)
        return nodes.select(*[F.col(c).alias(f"{name}.{c}") for c in self.graph.nodes.columns])

    def use(self, scope: _Scope, name: str) -> None:
        """Joins the node's columns, if only its id and label are there."""
        if name in scope.joined or name not in scope.labels:
            return
        nodes = self.graph.nodes if scope.labels[name] is None else self.graph.scan(scope.labels[name])
        more = [c for c in nodes.columns if c not in ("id", "label")]
        side = nodes.select(F.col("id").alias(f"{name}.id"), F.col("label").alias(f"{name}.label"), *[F.col(c).alias(f"{name}.{c}") for c in more])
        scope.df = scope.df.join(side, [f"{name}.id", f"{name}.label"], "left")
        scope.joined.add(name)

    def match(self, scope: _Scope, optional: bool) -> None:
        chains = [self.chain()]
        while self.sign(","):
            chains.append(self.chain())
        where = self.expression() if self.word("WHERE") else None
        if optional:
            inner = _Scope()
            for c in chains:
                self.add_chain(inner, c)
            if where:
                self.filter(inner, where)
            for n in sorted(set(inner.labels) & set(scope.labels)):
                if n not in inner.labels:
                    raise CypherError(f"{n} isn't bound")
            keys = [k for n in sorted(set(inner.labels) & set(scope.labels)) for k in (f"{n}.id", f"{n}.label")]
            if not keys:
                raise CypherError("an optional pattern must share a variable with what comes before")
            fresh = [c for c in inner.df.columns if c in keys or c not in scope.df.columns]
            scope.df = scope.df.join(inner.df.select(*[_col(c) for c in fresh]), keys, "left")
            scope.labels = inner.labels | scope.labels
            scope.rels |= inner.rels
            scope.joined |= inner.joined - set(k for k in scope.labels if k in scope.joined)
            return
        for c in chains:
            self.add_chain(scope, c)
        if where:
            self.filter(scope, where)

    def add_chain(self, scope: _Scope, chain: list) -> None:
        (name, label, where), *steps = chain
        if not steps:
            if name in scope.labels:
                if label:
                    scope.df = scope.df.where(_col(f"{name}.label") == label)
            else:
                side = self.nodes_as(name, label)
                # Patterns without a shared variable are conditions' business: equal keys in WHERE make joins of them.
                scope.df = side if scope.df is None else scope.df.crossJoin(side)
                scope.labels[name] = label
                scope.joined.add(name)
        left = (name, label)
        for rel, kinds, back, (right, right_label, right_where) in steps:
            edges = self.graph.edges
            if kinds:
                edges = edges.where(F.col("rel").isin(kinds) | F.col("kind").isin(kinds))
            a, b = (right, left[0]) if back else (left[0], right)
            edges = edges.select(*[F.col(c).alias({"from_id": f"{a}.id", "from_label": f"{a}.label", "to_id": f"{b}.id", "to_label": f"{b}.label"}.get(c, f"{rel}.{c}")) for c in edges.columns]) if a != b else edges.where("from_id = to_id and from_label = to_label").select(F.col("from_id").alias(f"{a}.id"), F.col("from_label").alias(f"{a}.label"), *[F.col(c).alias(f"{rel}.{c}") for c in edges.columns if c not in ("from_id", "from_label", "to_id", "to_label")])
            for n, wanted in (left, (right, right_label)):
                if wanted:
                    edges = edges.where(_col(f"{n}.label") == wanted)
            known = [n for n in dict.fromkeys((a, b)) if n in scope.labels]
            if scope.df is None:
                scope.df = edges
            elif known:
                scope.df = scope.df.join(edges, [k for n in known for k in (f"{n}.id", f"{n}.label")])
            else:
                scope.df = scope.df.crossJoin(edges)
            for n, wanted in (left, (right, right_label)):
                scope.labels[n] = scope.labels.get(n) or wanted
            scope.rels.add(rel)
            for key, value in right_where:
                self.filter(scope, ("=", ("property", right, key), value))
            left = (right, right_label)
        for key, value in where:
            self.filter(scope, ("=", ("property", name, key), value))

    def filter(self, scope: _Scope, tree: tuple) -> None:
        self.prepare(scope, tree)
        scope.df = scope.df.where(self.column(scope, tree))

    def prepare(self, scope: _Scope, tree) -> None:
        """Joins what the tree asks of nodes."""
        if isinstance(tree, list):
            for x in tree:
                self.prepare(scope, x)
        elif isinstance(tree, tuple):
            if tree[0] == "property":
                if tree[1] in scope.labels and tree[2] not in ("id", "label"):
                    self.use(scope, tree[1])
            elif tree[0] == "variable":
                return
            else:
                for x in tree[1:]:
                    self.prepare(scope, x)

    def column(self, scope: _Scope, tree: tuple) -> Column:
        op = tree[0]
        if op == "value":
            return F.array(*map(F.lit, tree[1])) if isinstance(tree[1], list) else F.lit(tree[1])
        if op == "list":
            return F.array(*[self.column(scope, x) for x in tree[1]])
        if op == "property":
            if tree[1] not in scope.labels and tree[1] not in scope.rels:
                if tree[1] in scope.values:
                    return _col(tree[1])[tree[2]]
                raise CypherError(f"{tree[1]} isn't bound")
            if f"{tree[1]}.{tree[2]}" not in scope.df.columns:
                raise CypherError(f"{tree[1]} has no property {tree[2]}", "unknown_property")
            return _col(f"{tree[1]}.{tree[2]}")
        if op == "variable":
            if tree[1] in scope.values:
                return _col(tree[1])
            if tree[1] in scope.labels:
                return _col(f"{tree[1]}.id")
            if tree[1] in scope.rels:
                return _col(f"{tree[1]}.rel")
            raise CypherError(f"{tree[1]} isn't bound")
        if op == "call":
            return self.call(scope, tree)
        args = [self.column(scope, x) for x in tree[1:]]
        a = args[0]
        if op == "null":
            return a.isNull()
        if op == "not":
            return ~a
        b = args[1]
        if op == "in":
            return F.array_contains(b, a)
        return {
            "and": lambda: a & b, "or": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b), "contains": lambda: F.contains(a, b), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b,
        }[op]()

    def call(self, scope: _Scope, tree: tuple) -> Column:
        _, name, args, distinct = tree
        if name in AGGREGATES:
            if args == [("star",)]:
                return F.count("*")
            x = self.column(scope, args[0])
            if distinct:
                return {"count": F.count_distinct, "collect": F.collect_set, "sum": F.sum_distinct}[name](x)
            return AGGREGATES[name](x)
        plain = {"tolower": F.lower, "toupper": F.upper, "size": F.length, "abs": F.abs, "trim": F.trim}
        if name in plain:
            return plain[name](self.column(scope, args[0]))
        if name == "label" or name == "labels":
            return _col(f"{args[0][1]}.label")
        if name == "type":
            return _col(f"{args[0][1]}.rel")
        if name == "coalesce":
            return F.coalesce(*[self.column(scope, x) for x in args])
        raise CypherError(f"there is no function {name}")

    def whole(self, scope: _Scope, item: _Item) -> Column:
        """A returned expression; a node alone comes as JSON of its columns."""
        if item.expr[0] == "variable" and item.expr[1] in scope.labels:
            name = item.expr[1]
            self.use(scope, name)
            return F.to_json(F.struct(*[_col(c).alias(c.removeprefix(f"{name}.")) for c in scope.df.columns if c.startswith(f"{name}.")]))
        return self.column(scope, item.expr)

    @staticmethod
    def aggregates(tree) -> bool:
        if isinstance(tree, list):
            return any(map(Compiler.aggregates, tree))
        return isinstance(tree, tuple) and (tree[0] == "call" and tree[1] in AGGREGATES or any(map(Compiler.aggregates, tree[1:])))

    def project(self, scope: _Scope, items: list[_Item], distinct: bool) -> None:
        for i in items:
            self.prepare(scope, i.expr)
            if i.expr[0] == "variable":
                self.use(scope, i.expr[1])
        if scope.df is None:
            raise CypherError("nothing has been matched")
        if any(self.aggregates(i.expr) for i in items):
            keys = [i for i in items if not self.aggregates(i.expr)]
            out = scope.df.groupBy(*[self.whole(scope, i).alias(i.name) for i in keys]).agg(*[self.column(scope, i.expr).alias(i.name) for i in items if i not in keys])
            scope.df = out.select(*[_col(i.name) for i in items])
        else:
            out = [self.whole(scope, i).alias(i.name) for i in items]
            scope.df = scope.df.select(*out)
        if distinct:
            scope.df = scope.df.distinct()

    def with_(self, scope: _Scope) -> None:
        distinct, items = self.word("DISTINCT"), self.items()
        plain = [i for i in items if i.expr[0] == "variable" and i.expr[1] in scope.labels and i.name == i.expr[1]]
        for i in items:
            self.prepare(scope, i.expr)
        carried = [c for i in plain for c in scope.df.columns if c.startswith(f"{i.name}.")]
        others = [i for i in items if i not in plain]
        if any(self.aggregates(i.expr) for i in others):
            keys = [_col(c) for c in carried] + [self.column(scope, i.expr).alias(i.name) for i in others if not self.aggregates(i.expr)]
            df = scope.df.groupBy(*keys).agg(*[self.column(scope, i.expr).alias(i.name) for i in others if self.aggregates(i.expr)])
        else:
            df = scope.df.select(*[_col(c) for c in carried], *[self.column(scope, i.expr).alias(i.name) for i in others])
        scope.df = df.distinct() if distinct else df
        scope.labels = {i.name: scope.labels[i.name] for i in plain}
        scope.joined &= set(scope.labels)
        scope.rels, scope.values = set(), {i.name for i in others}
        if self.word("WHERE"):
            self.filter(scope, self.expression())

    def run(self) -> DataFrame:
        scope = _Scope()
        while self.k < len(self.tokens):
            if self.word("OPTIONAL", "MATCH"):
                self.match(scope, True)
            elif self.word("MATCH"):
                self.match(scope, False)
            elif self.word("UNWIND"):
                values = self.column(scope, self.expression())
                if not self.word("AS"):
                    raise CypherError("UNWIND needs AS")
                name = self.name()
                rows = scope.df if scope.df is not None else self.graph.nodes.sparkSession.range(1).select()
                scope.df = rows.select("*", F.explode(values).alias(name))
                scope.values.add(name)
            elif self.word("WITH"):
                self.with_(scope)
            elif self.word("WHERE"):
                self.filter(scope, self.expression())
            elif self.word("RETURN"):
                return self.returned(scope)
            else:
                raise CypherError(f"unexpected {self.peek()!r}")
        raise CypherError("RETURN is missing")

    def returned(self, scope: _Scope) -> DataFrame:
        distinct, items = self.word("DISTINCT"), self.items()
        self.project(scope, items, distinct)
        out = scope.df
        if self.word("ORDER", "BY"):
            by, names = [], {i.name: i.name for i in items} | {i.text: i.name for i in items}
            while True:
                begin = self.tokens[self.k][2]
                self.expression()
                text = self.query[begin : self.tokens[self.k - 1][3]]
                if text not in names:
                    raise CypherError(f"ORDER BY {text}: it must be returned")
                down = self.word("DESC") or not self.word("ASC") and False
                by.append(_col(names[text]).desc() if down else _col(names[text]).asc())
                if not self.sign(","):
                    break
            out = out.orderBy(*by)
        if self.word("SKIP"):
            out = out.offset(int(self.atom()[1]))
        if self.word("LIMIT"):
            out = out.limit(int(self.atom()[1]))
        if self.k < len(self.tokens):
            raise CypherError(f"unexpected {self.peek()!r}")
        return out


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def compile_query(graph: PropertyGraph, query: str, params: dict | None = None) -> DataFrame:
    return Compiler(graph, query, params).run()


def text(df: DataFrame, separator: str = " | ") -> DataFrame:
    """The rows as one string each; nulls are empty."""
    return df.select(F.concat_ws(separator, *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in df.columns]).alias("row"))
