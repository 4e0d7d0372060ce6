"""The query tree, bound to a graph, as DataFrame plans.

A node variable ``v`` is carried as columns ``v__prop``, only for properties the query names, so scans read
no more. Joins start at the pattern's most restricted node. EXISTS and IN become semi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LABELS, TYPES, GraphResult, PropertyGraph
from ..operators import traverse
from .syntax import AGGREGATES, Edge, Expr, Item, Match, Node, Pattern, Project, QueryError, has_aggregate, parse, walk

WHOLE = ["id", "label", "name", "path"]


class Planner:
    def __init__(self, graph: PropertyGraph, params: dict | None = None, match_case: bool = False, most_hops: int = 8):
        self.graph, self.params, self.match_case, self.most_hops = graph, params or {}, match_case, most_hops
        self.vars: dict[str, str] = {}  # name -> node, edge, value
        self.props: dict[str, set[str]] = {}
        self.fresh = 0

    # what the query names
    def collect(self, parts: list) -> None:
        def expr(e: Expr) -> None:
            for x in walk(e):
                if x.kind == "prop":
                    self.props.setdefault(x.value[0], set()).add(x.value[1])
                elif x.kind == "var":
                    self.props.setdefault(x.value, set()).add("*")

        for p in parts:
            if isinstance(p, Match):
                if p.where:
                    expr(p.where)
            else:
                for e in [i.expr for i in p.items] + [o for o, _, _ in p.order] + ([p.where] if p.where else []):
                    expr(e)

    def value(self, e: Expr):
        if e.kind == "lit":
            return e.value
        if e.kind == "param":
            if e.value not in self.params:
                raise QueryError(f"no value for ${e.value}")
            return self.params[e.value]
        raise QueryError("a property in a pattern must be a literal or a parameter")

    def needed(self, var: str, kind: str) -> list[str]:
        own = self.props.get(var, set())
        known = self.graph.nodes.columns if kind == "node" else self.graph.edges.columns
        for p in own - {"*"}:
            if p not in known:
                raise QueryError(f"no property {p} of {var}")
        whole = (WHOLE if kind == "node" else ["id", "type", "src", "dst"]) if "*" in own else []
        return list(dict.fromkeys(["id", *whole, *sorted(own - {"*"})]))

    def scan(self, node: Node, var: str) -> DataFrame:
        if node.label is not None and node.label not in LABELS:
            raise QueryError(f"unknown label {node.label}")
        df = self.graph.nodes
        if node.label:
            df = df.filter(F.col("label") == node.label)
        for k, v in node.props.items():
            if k not in df.columns:
                raise QueryError(f"no property {k} of a node")
            df = df.filter(F.col(k) == F.lit(self.value(v)))
        return df.select(*[F.col(c).alias(f"{var}__{c}") for c in self.needed(var, "node")])

    def links(self, edge: Edge, var: str | None) -> DataFrame:
        for t in edge.types:
            if t not in TYPES:
                raise QueryError(f"unknown type {t}")
        df = traverse.typed(self.graph.edges, edge.types)
        extra = [F.col(c).alias(f"{var}__{c}") for c in self.needed(var, "edge")] if var else []
        return df.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), *extra)

    def new(self) -> str:
        self.fresh += 1
        return f"_n{self.fresh}"

    def match(self, pattern: Pattern, bound: DataFrame | None, hints: set[str]) -> DataFrame:
        """The pattern's rows, joined to what is bound already."""
        names = [n.var or self.new() for n in pattern.nodes]
        known = [n in self.vars and self.vars[n] == "node" for n in names]
        weight = [2 * k + (3 if n.props else 0) + (2 if v in hints else 0) + (n.label is not None) for k, n, v in zip(known, pattern.nodes, names, strict=True)]
        start = max(range(len(names)), key=lambda k: (weight[k], -k))
        if any(known):
            start = known.index(True)
        df = bound
        if not known[start]:
            first = self.scan(pattern.nodes[start], names[start])
            if df is not None:
                raise QueryError("patterns of one query must share a variable")
            df = first
        else:
            df = self._restrict(df, pattern.nodes[start], names[start])
        self.vars[names[start]] = "node"
        for k in [*range(start, len(names) - 1), *range(start - 1, -1, -1)]:
            edge = pattern.edges[k]
            here, there = (k, k + 1) if k >= start else (k + 1, k)
            df = self.hop(df, names[here], edge, (k >= start) == edge.forward, pattern.nodes[there], names[there])
        return df

    def _restrict(self, df: DataFrame, node: Node, var: str) -> DataFrame:
        """Label and properties on a variable that is bound already."""
        if node.label or node.props:
            keys = self.scan(node, var).select(F.col(f"{var}__id"))
            df = df.join(keys, f"{var}__id", "left_semi")
        return df

    def hop(self, df: DataFrame, here: str, edge: Edge, outward: bool, node: Node, there: str) -> DataFrame:
        if edge.hops:
            high = self.most_hops if edge.high is None else edge.high
            seeds = df.select(F.col(f"{here}__id").alias("id")).distinct()
            paths = traverse.simple_paths(self.graph.edges, seeds, edge.low, high, edge.types, outward)
            step = paths.select(F.col("start").alias("_here"), F.col("end").alias("_there"))
        else:
            e = self.links(edge, edge.var)
            a, b = ("_src", "_dst") if outward else ("_dst", "_src")
            step = e.withColumnsRenamed({a: "_here", b: "_there"})
            if edge.var:
                self.vars[edge.var] = "edge"
        df = df.join(step, F.col(f"{here}__id") == F.col("_here")).drop("_here")
        if there in self.vars:
            return self._restrict(df.filter(F.col("_there") == F.col(f"{there}__id")).drop("_there"), node, there)
        if not node.var and not node.label and not node.props:
            # an anonymous node: only that the edge is there
            self.vars[there] = "node"
            return df.withColumnRenamed("_there", f"{there}__id")
        self.vars[there] = "node"
        return df.join(self.scan(node, there), F.col("_there") == F.col(f"{there}__id")).drop("_there")

    # expressions
    def column(self, e: Expr, df: DataFrame) -> Column:
        if e.kind in ("lit", "param"):
            return F.lit(self.value(e))
        if e.kind == "list":
            return F.array(*[self.column(a, df) for a in e.args])
        if e.kind == "prop":
            var, prop = e.value
            if self.vars.get(var) not in ("node", "edge"):
                raise QueryError(f"unknown variable {var}")
            return F.col(f"{var}__{prop}")
        if e.kind == "var":
            kind = self.vars.get(e.value)
            if kind is None:
                raise QueryError(f"unknown variable {e.value}")
            if kind == "value":
                return F.col(f"`{e.value}`")
            return F.struct(*[F.col(f"{e.value}__{c}").alias(c) for c in (WHOLE if kind == "node" else ["id", "type", "src", "dst"])])
        if e.kind == "not":
            return ~self.column(e.args[0], df)
        if e.kind == "isnull":
            c = self.column(e.args[0], df)
            return c.isNull() if e.value else c.isNotNull()
        if e.kind == "op":
            if e.value == "IN":
                return self.column(e.args[0], df).isin(*[self.column(a, df) for a in e.args[1].args]) if e.args[1].kind == "list" else F.array_contains(self.column(e.args[1], df), self.column(e.args[0], df))
            a, b = (self.column(x, df) for x in e.args)
            if e.value in ("CONTAINS", "STARTS", "ENDS"):
                if not self.match_case:
                    a, b = F.lower(a), F.lower(b)
                return a.contains(b) if e.value == "CONTAINS" else a.startswith(b) if e.value == "STARTS" else a.endswith(b)
            return {"AND": lambda: a & b, "OR": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: a % b}[e.value]()
        if e.kind == "call":
            name, distinct = e.value
            if name in AGGREGATES:
                return self.aggregate(name, distinct, e.args, df)
            one = {"LOWER": F.lower, "TOLOWER": F.lower, "UPPER": F.upper, "TOUPPER": F.upper, "TRIM": F.trim, "ABS": F.abs}
            if name in one and len(e.args) == 1:
                return one[name](self.column(e.args[0], df))
            if name == "COALESCE":
                return F.coalesce(*[self.column(a, df) for a in e.args])
            if name in ("SIZE", "LENGTH") and e.args[0].kind != "shortest":
                c = self.column(e.args[0], df)
                return F.when(c.isNotNull(), F.length(c)) if e.args[0].kind in ("prop", "lit", "param") else F.size(c)
            if name in ("LABELS", "TYPE", "ID") and e.args[0].kind == "var":
                return F.col(f"{e.args[0].value}__{ {'LABELS': 'label', 'TYPE': 'type', 'ID': 'id'}[name]}")
            raise QueryError(f"unknown function {name}")
        if e.kind == "flag":
            return F.col(e.value)
        raise QueryError(f"{e.kind} can't stand here")

    def aggregate(self, name: str, distinct: bool, args: list[Expr], df: DataFrame) -> Column:
        arg = args[0]
        if name == "COUNT":
            if arg.kind == "lit" and arg.value == "*":
                return F.count(F.lit(1))
            c = F.col(f"{arg.value}__id") if arg.kind == "var" and self.vars.get(arg.value) != "value" else self.column(arg, df)
            return F.count_distinct(c) if distinct else F.count(c)
        if name == "COLLECT":
            c = self.column(Expr("prop", (arg.value, "name")) if arg.kind == "var" and self.vars.get(arg.value) == "node" else arg, df)
            return F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))
        c = self.column(arg, df)
        return {"AVG": F.avg, "SUM": F.sum_distinct if distinct else F.sum, "MIN": F.min, "MAX": F.max}[name](c)

    # predicates
    def where(self, df: DataFrame, e: Expr) -> DataFrame:
        if e.kind == "op" and e.value == "AND":
            return self.where(self.where(df, e.args[0]), e.args[1])
        if e.kind in ("exists", "inquery"):
            return self.semi(df, e, "left_semi")
        if e.kind == "not" and e.args[0].kind in ("exists", "inquery"):
            return self.semi(df, e.args[0], "left_anti")
        df, e = self.flags(df, e)
        return df.filter(self.column(e, df))

    def flags(self, df: DataFrame, e: Expr) -> tuple[DataFrame, Expr]:
        """EXISTS and IN inside OR or NOT: a column that says whether they hold."""
        if e.kind in ("exists", "inquery"):
            key, right = self.keys(df, e)
            flag = self.new()
            right = right.withColumn(flag, F.lit(True))
            df = df.join(right, key == F.col(right.columns[0]), "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop(right.columns[0])
            return df, Expr("flag", flag)
        args = []
        for a in e.args:
            if isinstance(a, Expr):
                df, a = self.flags(df, a)
            args.append(a)
        return df, Expr(e.kind, e.value, args)

    def keys(self, df: DataFrame, e: Expr) -> tuple[Column, DataFrame]:
        """What to look up, and the table of what is there."""
        inner = Planner(self.graph, self.params, self.match_case, self.most_hops)
        name = self.new() + "_k"
        if e.kind == "inquery":
            rows = inner.run(e.value)
            return self.column(e.args[0], df), rows.select(F.col(f"`{rows.columns[0]}`").alias(name)).distinct()
        shared = [n.var for n in e.value.nodes if n.var and n.var in self.vars]
        if len(shared) != 1:
            raise QueryError("EXISTS needs one variable of the query")
        rows = inner.match(e.value, None, set())
        return F.col(f"{shared[0]}__id"), rows.select(F.col(f"{shared[0]}__id").alias(name)).distinct()

    def semi(self, df: DataFrame, e: Expr, how: str) -> DataFrame:
        key, right = self.keys(df, e)
        return df.join(right, key == F.col(right.columns[0]), how)

    # projection
    def shortest(self, df: DataFrame, parts: Project) -> tuple[DataFrame, Project]:
        """LENGTH(shortestPath(...)) as a column: breadth first from the bound starts."""
        def replace(e: Expr) -> Expr:
            nonlocal df
            if e.kind == "call" and e.value[0] == "LENGTH" and e.args[0].kind == "shortest":
                p = e.args[0].value
                s, t, edge = p.nodes[0].var, p.nodes[-1].var, p.edges[0]
                if self.vars.get(s) != "node" or self.vars.get(t) != "node":
                    raise QueryError("shortestPath needs bound ends")
                far = traverse.distances(self.graph.edges, df.select(F.col(f"{s}__id").alias("id")).distinct(), edge.types, edge.forward, edge.high)
                flag = self.new()
                far = far.filter("depth > 0").select(F.col("start").alias("_s"), F.col("node").alias("_t"), F.col("depth").alias(flag))
                df = df.join(far, (F.col(f"{s}__id") == F.col("_s")) & (F.col(f"{t}__id") == F.col("_t"))).drop("_s", "_t")
                return Expr("flag", flag)
            return Expr(e.kind, e.value, [replace(a) if isinstance(a, Expr) else a for a in e.args])

        items = [Item(replace(i.expr), i.name) for i in parts.items]
        return df, Project(items, parts.distinct, parts.where, parts.order, parts.skip, parts.limit, parts.last)

    def project(self, df: DataFrame, p: Project) -> DataFrame:
        df, p = self.shortest(df, p)
        names = [i.name for i in p.items]
        hidden: list[Item] = []
        order = []
        for e, text, down in p.order:
            same = [i.name for i in p.items if i.expr == e]
            if text in names or same:
                name = text if text in names else same[0]
            elif e.kind == "var" and e.value in names:
                name = e.value
            else:
                name = self.new()
                hidden.append(Item(e, name))
            order.append((name, down))
        items = [*p.items, *hidden]
        if any(has_aggregate(i.expr) for i in items):
            keys = [i for i in items if not has_aggregate(i.expr)]
            for i in hidden:
                if not has_aggregate(i.expr):
                    raise QueryError(f"ORDER BY {i.name}: neither returned nor aggregated")
            nodes = [i for i in keys if i.expr.kind == "var" and self.vars.get(i.expr.value) in ("node", "edge")] if not p.last else []
            by = [self.column(i.expr, df).alias(i.name) for i in keys if i not in nodes]
            by += [F.col(c) for i in nodes for c in df.columns if c.startswith(f"{i.expr.value}__")]
            out = df.groupBy(*by).agg(*[self.column(i.expr, df).alias(i.name) for i in items if i not in keys]) if by else df.agg(*[self.column(i.expr, df).alias(i.name) for i in items])
        else:
            nodes = [i for i in items if i.expr.kind == "var" and self.vars.get(i.expr.value) in ("node", "edge")] if not p.last else []
            columns = [self.column(i.expr, df).alias(i.name) for i in items if i not in nodes]
            columns += [F.col(c).alias(c.replace(f"{i.expr.value}__", f"{i.name}__", 1)) for i in nodes for c in df.columns if c.startswith(f"{i.expr.value}__")]
            out = df.select(*columns)
        if p.distinct:
            out = out.distinct()
        if not p.last:
            kinds = {i.name: self.vars.get(i.expr.value) if i.expr.kind == "var" else "value" for i in p.items}
            self.vars = {k: v or "value" for k, v in kinds.items()}
        if order:
            out = out.orderBy(*[F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_first() for n, down in order])
        if p.skip:
            out = out.offset(p.skip)
        if p.limit is not None:
            out = out.limit(p.limit)
        if p.where:
            out = self.where(out, p.where)
        return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in {i.name for i in hidden}])

    def hints(self, e: Expr | None) -> set[str]:
        """Variables that an equality with a literal restricts."""
        return {x.args[0].value[0] for x in walk(e) if x.kind == "op" and x.value == "=" and x.args[0].kind == "prop" and x.args[1].kind in ("lit", "param")} if e else set()

    def run(self, parts: list) -> DataFrame:
        self.collect(parts)
        df: DataFrame | None = None
        for p in parts:
            if isinstance(p, Project):
                if df is None:
                    raise QueryError("nothing is matched")
                df = self.project(df, p)
            elif p.optional:
                df = self.optional(df, p)
            else:
                for pattern in p.patterns:
                    df = self.match(pattern, df, self.hints(p.where))
                if p.where:
                    df = self.where(df, p.where)
        return df

    def optional(self, df: DataFrame | None, p: Match) -> DataFrame:
        if df is None:
            raise QueryError("OPTIONAL MATCH needs something matched before")
        for pattern in p.patterns:
            shared = [n.var for n in pattern.nodes if n.var and self.vars.get(n.var) == "node"]
            if len(shared) != 1:
                raise QueryError("OPTIONAL MATCH needs one variable of the query")
            inner = Planner(self.graph, self.params, self.match_case, self.most_hops)
            inner.props, inner.fresh = {k: v for k, v in self.props.items() if k not in shared}, self.fresh + 1000
            right = inner.match(pattern, None, self.hints(p.where))
            if p.where:
                right = inner.where(right, p.where)
            key = f"{shared[0]}__id"
            right = right.withColumnRenamed(key, "_opt").select("_opt", *[c for c in right.columns if c != key and not c.startswith(f"{shared[0]}__")])
            df = df.join(right, F.col(key) == F.col("_opt"), "left").drop("_opt")
            self.vars |= {k: v for k, v in inner.vars.items() if k not in self.vars}
            self.fresh = inner.fresh
        return df


def run_query(graph: PropertyGraph, text: str, params: dict | None = None, match_case: bool = False, most_hops: int = 8) -> GraphResult:
    """A query in the default dialect. Raises QueryError for what can't be read or bound."""
    return GraphResult(Planner(graph, params, match_case, most_hops).run(parse(text)))
