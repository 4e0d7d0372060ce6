"""Query text to a small typed tree: lexer and recursive-descent parser.

    query   = part+ RETURN [DISTINCT] items [ORDER BY item [DESC], ...] [SKIP n] [LIMIT n]
    part    = [OPTIONAL] MATCH pattern, ... [WHERE expr] | WITH items [WHERE expr]
    pattern = (v:Label {k: value}) (-[r:TYPE|TYPE *m..n]-> | <-[...]-) (...) ...
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query that can't be read or bound."""


@dataclass
class Node:
    var: str | None
    label: str | None
    props: dict[str, Any] = field(default_factory=dict)


@dataclass
class Edge:
    var: str | None
    types: list[str]
    forward: bool = True
    low: int = 1
    high: int | None = 1
    hops: bool = False  # written with a star


@dataclass
class Pattern:
    nodes: list[Node]
    edges: list[Edge]


@dataclass
class Expr:
    kind: str  # lit, param, prop, var, call, op, not, isnull, exists, inquery, list, shortest
    value: Any = None
    args: list = field(default_factory=list)


@dataclass
class Item:
    expr: Expr
    name: str


@dataclass
class Match:
    patterns: list[Pattern]
    optional: bool
    where: Expr | None


@dataclass
class Project:
    items: list[Item]
    distinct: bool = False
    where: Expr | None = None
    order: list[tuple[Expr, str, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    last: bool = False


TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<param>\$[A-Za-z_]\w*)|(?P<op><>|<=|>=|->|<-|\.\.|[-+*/%=<>()\[\]{}:,.|;]))""")
AGGREGATES = {"COUNT", "COLLECT", "AVG", "SUM", "MIN", "MAX"}


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        pos, end = 0, len(text.rstrip())
        while pos < end:
            m = TOKEN.match(text, pos)
            if not m:
                raise QueryError(f"unexpected character at {pos}: {text[pos : pos + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
            pos = m.end()
        self.tokens.append(("end", "", end, end))

    # tokens
    def peek(self, *words: str, ahead: int = 0) -> bool:
        kind, value, *_ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return (value.upper() if kind == "name" else value) in words and kind in ("name", "op")

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise QueryError(f"expected {word} at {self.tokens[self.at][2]}, found {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value, *_ = self.tokens[self.at]
        if kind != "name":
            raise QueryError(f"expected a name at {self.tokens[self.at][2]}, found {value!r}")
        self.at += 1
        return value

    def integer(self) -> int:
        kind, value, *_ = self.tokens[self.at]
        if kind != "num" or "." in value:
            raise QueryError(f"expected a number at {self.tokens[self.at][2]}")
        self.at += 1
        return int(value)

    # statements
    def query(self, nested: bool = False) -> list[Match | Project]:
        parts: list[Match | Project] = []
        while True:
            if self.peek("OPTIONAL") or self.peek("MATCH"):
                optional = self.take("OPTIONAL")
                self.need("MATCH")
                patterns = [self.pattern()]
                while self.take(","):
                    patterns.append(self.pattern())
                parts.append(Match(patterns, optional, self.expr() if self.take("WHERE") else None))
            elif self.take("WITH"):
                p = self.project()
                p.where = self.expr() if self.take("WHERE") else None
                parts.append(p)
            elif self.take("RETURN"):
                p = self.project()
                p.last = True
                parts.append(p)
                self.take(";")
                if not nested and self.tokens[self.at][0] != "end":
                    raise QueryError(f"unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")
                return parts
            else:
                raise QueryError(f"expected MATCH, WITH or RETURN at {self.tokens[self.at][2]}, found {self.tokens[self.at][1]!r}")

    def project(self) -> Project:
        out = Project([], distinct=self.take("DISTINCT"))
        out.items.append(self.item())
        while self.take(","):
            out.items.append(self.item())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                start = self.at
                e = self.expr()
                text = self.source(start)
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                out.order.append((e, text, down))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            out.skip = self.integer()
        if self.take("LIMIT"):
            out.limit = self.integer()
        return out

    def source(self, start: int) -> str:
        return self.text[self.tokens[start][2] : self.tokens[self.at - 1][3]]

    def item(self) -> Item:
        start = self.at
        e = self.expr()
        text = self.source(start)
        return Item(e, self.name() if self.take("AS") else text)

    # patterns
    def pattern(self) -> Pattern:
        out = Pattern([self.node()], [])
        while self.peek("-") or self.peek("<-"):
            out.edges.append(self.edge())
            out.nodes.append(self.node())
        return out

    def node(self) -> Node:
        self.need("(")
        out = Node(self.name() if self.tokens[self.at][0] == "name" else None, None)
        if self.take(":"):
            out.label = self.name()
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out.props[key] = self.primary()
                self.take(",")
        self.need(")")
        return out

    def edge(self) -> Edge:
        back = self.take("<-")
        if not back:
            self.need("-")
        out = Edge(None, [], not back)
        if self.take("["):
            if self.tokens[self.at][0] == "name":
                out.var = self.name()
            if self.take(":"):
                out.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    out.types.append(self.name())
            if self.take("*"):
                out.hops, out.high = True, None
                if self.tokens[self.at][0] == "num":
                    out.low = out.high = self.integer()
                if self.take(".."):
                    out.high = self.integer() if self.tokens[self.at][0] == "num" else None
            self.need("]")
        self.need("-" if back else "->")
        return out

    # expressions
    def expr(self) -> Expr:
        left = self.conjunction()
        while self.take("OR"):
            left = Expr("op", "OR", [left, self.conjunction()])
        return left

    def conjunction(self) -> Expr:
        left = self.negation()
        while self.take("AND"):
            left = Expr("op", "AND", [left, self.negation()])
        return left

    def negation(self) -> Expr:
        return Expr("not", args=[self.negation()]) if self.take("NOT") else self.comparison()

    def comparison(self) -> Expr:
        left = self.sum()
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return Expr("isnull", not no, [left])
        if self.take("CONTAINS"):
            return Expr("op", "CONTAINS", [left, self.sum()])
        for word in ("STARTS", "ENDS"):
            if self.take(word):
                self.need("WITH")
                return Expr("op", word, [left, self.sum()])
        if self.take("IN"):
            if self.peek("(") and self.peek("MATCH", ahead=1):
                self.need("(")
                inner = self.query(nested=True)
                self.need(")")
                return Expr("inquery", inner, [left])
            return Expr("op", "IN", [left, self.sum()])
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return Expr("op", op, [left, self.sum()])
        return left

    def sum(self) -> Expr:
        left = self.product()
        while self.peek("+") or self.peek("-"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = Expr("op", op, [left, self.product()])
        return left

    def product(self) -> Expr:
        left = self.primary()
        while self.peek("*") or self.peek("/") or self.peek("%"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = Expr("op", op, [left, self.primary()])
        return left

    def primary(self) -> Expr:
        kind, value, *_ = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Expr("lit", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "num":
            self.at += 1
            return Expr("lit", float(value) if "." in value else int(value))
        if kind == "param":
            self.at += 1
            return Expr("param", value[1:])
        if self.take("-"):
            return Expr("op", "-", [Expr("lit", 0), self.primary()])
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return Expr("list", args=items)
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        word = self.name()
        upper = word.upper()
        if upper in ("TRUE", "FALSE"):
            return Expr("lit", upper == "TRUE")
        if upper == "NULL":
            return Expr("lit", None)
        if upper == "EXISTS" and (self.peek("(") or self.peek("{")):
            close = ")" if self.take("(") else "}"
            if close == "}":
                self.need("{")
            self.take("MATCH")
            inner = self.pattern()
            self.need(close)
            return Expr("exists", inner)
        if upper == "SHORTESTPATH":
            self.need("(")
            inner = self.pattern()
            self.need(")")
            return Expr("shortest", inner)
        if self.take("("):
            distinct = self.take("DISTINCT")
            args = []
            if self.take("*"):
                args = [Expr("lit", "*")]
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return Expr("call", (upper, distinct), args)
        if self.take("."):
            return Expr("prop", (word, self.name()))
        return Expr("var", word)


def parse(text: str) -> list[Match | Project]:
    """The parts of a query; QueryError where it can't be read."""
    return Parser(text).query()


def has_aggregate(e: Expr) -> bool:
    return (e.kind == "call" and e.value[0] in AGGREGATES) or any(has_aggregate(a) for a in e.args if isinstance(a, Expr))


def walk(e: Expr):
    yield e
    for a in e.args:
        if isinstance(a, Expr):
            yield from walk(a)
