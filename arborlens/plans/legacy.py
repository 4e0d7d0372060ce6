"""The narrow dialect: five query forms, tried in order, with the quirks that go with them.

Only the first CONTAINS of a WHERE clause counts, else its first equality; AND and OR mean nothing. AVG and
SUM count. Text that fits no form gives an empty result. LIMIT in the text is ignored; pages come from
``limit`` and ``offset``, in insertion order, and aggregates ignore pages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphResult, PropertyGraph
from ..operators import match, traverse

_NODE = r"\(\s*(\w+)\s*:\s*(\w+)\s*(?:\{([^}]*)\})?\s*\)"
_END = r"\(\s*(\w+)\s*(?::\s*(\w+)\s*)?\)"
FILTERED = re.compile(rf"^\s*MATCH\s+{_NODE}\s+WHERE\s+(.+?)\s+RETURN\s+(.+)$", re.I | re.S)
PATH = re.compile(rf"^\s*MATCH\s+{_END}\s*-\[\s*:\s*(\w+)\s*\*\s*(\d+)\s*\.\.\s*(\d+)\s*\]->\s*{_END}\s+RETURN\s+(.+)$", re.I | re.S)
COUNTED = re.compile(rf"^\s*MATCH\s+{_NODE}\s+RETURN\s+(COUNT|COLLECT|AVG|SUM)\s*\(\s*([^)]+?)\s*\)", re.I | re.S)
PLAIN = re.compile(rf"^\s*MATCH\s+{_NODE}\s+RETURN\s+(.+)$", re.I | re.S)
HOP = re.compile(rf"^\s*MATCH\s+{_END}\s*-\[\s*:\s*(\w+)\s*\]->\s*{_END}\s+RETURN\s+(.+)$", re.I | re.S)
ENDS, PER_PAIR = 50, 10


def _props(text: str | None) -> dict[str, str]:
    return dict(re.findall(r"(\w+)\s*:\s*['\"]([^'\"]*)['\"]", text or ""))


def _where(df: DataFrame, var: str, clause: str) -> DataFrame:
    if m := re.search(rf"{var}\.(\w+)\s+CONTAINS\s+['\"]([^'\"]*)['\"]", clause, re.I):
        return df.filter(match.contains(F.col(m[1]), m[2])) if m[1] in df.columns else df.filter("false")
    if m := re.search(rf"{var}\.(\w+)\s*=\s*['\"]([^'\"]*)['\"]", clause, re.I):
        return df.filter(F.col(m[1]) == m[2]) if m[1] in df.columns else df.filter("false")
    return df


def _select(df: DataFrame, var: str, returned: str) -> DataFrame:
    """``v.a, v.b`` as columns a and b; ``v`` as a column node; anything else as rows without columns' values."""
    found = list(dict.fromkeys(re.findall(rf"\b{var}\.(\w+)", returned)))
    if found:
        return df.select(*[F.col(p) if p in df.columns else F.lit(None).cast("string").alias(p) for p in found])
    if re.search(rf"\b{var}\b", returned):
        return df.select(F.struct("*").alias("node"))
    return df.select(F.lit(None).cast("string").alias("empty"))


def run_legacy(graph: PropertyGraph, text: str, limit: int = 100, offset: int = 0) -> GraphResult:
    empty = graph.nodes.filter("false").select("id")
    if m := FILTERED.match(text):
        rows = match.page(_where(match.with_properties(match.by_label(graph, m[2]), _props(m[3])), m[1], m[4]), limit, offset)
        return GraphResult(_select(rows, m[1], m[5]), rows)
    if m := PATH.match(text):
        found = traverse.variable_length(graph, m[2], m[3], m[7], int(m[4]), int(m[5]), ENDS, PER_PAIR)
        return GraphResult(found.orderBy("a", "b", "pathLength").offset(offset).limit(limit))
    if m := COUNTED.match(text):
        rows = match.with_properties(match.by_label(graph, m[2]), _props(m[3]))
        name, arg = m[4].upper(), m[5]
        if name != "COLLECT":
            return GraphResult(rows.agg(F.count(F.lit(1)).alias(f"{name}({arg})")), rows)
        prop = arg.split(".")[1] if "." in arg else "name"
        value = F.col(prop)
        true = value.isNotNull() & ~value.cast("string").isin("", "0", "false")
        listed = F.transform(F.array_sort(F.collect_list(F.when(true, F.struct("ord", value.alias("v"))))), lambda s: s["v"])
        return GraphResult(rows.agg(listed.alias(f"{name}({arg})")), rows)
    if m := PLAIN.match(text):
        rows = match.page(match.with_properties(match.by_label(graph, m[2]), _props(m[3])), limit, offset)
        return GraphResult(_select(rows, m[1], m[4]), rows)
    if m := HOP.match(text):
        rows = match.one_hop(graph, m[3], m[2], m[5])
        shown = [F.col(c).alias(v) for c, v in (("a", m[1]), ("b", m[4])) if v in m[6]]
        rows = rows.orderBy("a.id", "b.id").offset(offset).limit(limit)
        return GraphResult(rows.select(*shown) if shown else empty)
    return GraphResult(empty)


def accepts(text: str) -> bool:
    return any(p.match(text) for p in (FILTERED, PATH, COUNTED, PLAIN, HOP))


def tidy(text: str) -> str:
    """White space and spaces around operators."""
    text = re.sub(r"\s+", " ", text.strip())
    return re.sub(r"\s*(<>|<=|>=|=|<(?!-)|(?<!-)>)\s*", r" \1 ", text)


def validate(text: str) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a query's text, before it is parsed."""
    errors, warnings = [], []
    if not re.match(r"\s*(MATCH|OPTIONAL|WITH|RETURN|CREATE|MERGE|DELETE|SET|CALL|UNWIND)\b", text, re.I):
        errors.append("must start with a clause")
    for a, b in ("()", "[]", "{}"):
        if text.count(a) != text.count(b):
            errors.append(f"unbalanced {a}{b}")
    if re.match(r"\s*MATCH\b", text, re.I) and not re.search(r"\b(RETURN|DELETE|SET|CREATE|MERGE)\b", text, re.I):
        warnings.append("MATCH without RETURN")
    if re.search(r"\*(?!\s*\d)", text) and "COUNT(*)" not in text.upper():
        warnings.append("unbounded path")
    return errors, warnings
