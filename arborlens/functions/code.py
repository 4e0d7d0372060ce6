"""Regex analysers of source text, line by line, as DataFrames (path, content) -> rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


#: White space as the analysers see it: ASCII's, Unicode's separators and the byte order mark.
SPACE = r"[\t-\r \p{Z}\x{FEFF}]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


#: How a module's name is found in a line.
IMPORT = rf"import{SPACE}+(?:(?:\{{[^}}]*\}}|\*{SPACE}+as{SPACE}+\w+|\w+){SPACE}+from{SPACE}+)?['\"`]([^'\"`]+)['\"`]"
REQUIRE = rf"require{SPACE}*\({SPACE}*['\"`]([^'\"`]+)['\"`]{SPACE}*\)"
DYNAMIC = rf"import{SPACE}*\({SPACE}*['\"`]([^'\"`]+)['\"`]{SPACE}*\)"


def dependencies(files: DataFrame) -> DataFrame:
    """path, line, kind, module, content: the first import, require and dynamic import of each line, and the line."""
    kinds = {"import": IMPORT, "require": REQUIRE, "dynamic": DYNAMIC}
    rows = lines(files).select("path", "line", trimmed(F.col("text")).alias("content"))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("content", p, 1).alias("module")) for k, p in kinds.items()])
    return rows.select("path", "line", "content", F.explode(found).alias("m")).select("path", "line", "m.*", "content").filter("module <> ''")


#: How a line begins that is of a kind. ``const x = ...`` is a function and a variable.
STRUCTURE = {
    "import": r"^(?:import|from) ",
    "export": r"^export ",
    "function": rf"^(?:function|const|let|var){SPACE}+\w+{SPACE}*[=\(]",
    "class": rf"^class{SPACE}+\w+",
    "variable": rf"^(?:const|let|var){SPACE}+\w+{SPACE}*=",
}


def structure(files: DataFrame) -> DataFrame:
    """path, line, kind, content: lines that import, export, or declare functions, classes and variables."""
    rows = lines(files).select("path", "line", trimmed(F.col("text")).alias("content"))
    kinds = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(k)) for k, p in STRUCTURE.items()]))
    return rows.select("path", "line", F.explode(kinds).alias("kind"), "content")


#: Words before a bracket that aren't calls.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "typeof", "instanceof"]


def calls(files: DataFrame) -> DataFrame:
    """path, line, name, index: words before an opening bracket, which may stand on a later line; the index counts
    UTF-16 units of the whole text. A null content has none."""
    import re

    call = re.compile(r"([A-Za-z0-9_]+)[\t-\r \xa0  -     　﻿]*\(")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["content"], strict=True):
                text = text or ""
                line, units, at = 1, 0, 0
                for m in call.finditer(text):
                    before = text[at : m.start()]
                    line, units, at = line + before.count("\n"), units + len(before.encode("utf-16-le")) // 2, m.start()
                    if m[1] not in NOT_CALLS:
                        rows.append((path, line, m[1], units))
            yield pd.DataFrame(rows, columns=["path", "line", "name", "index"])

    return files.select("path", "content").mapInPandas(run, "path string, line long, name string, index long")


#: Parts of lines that count as branches, each once a line.
BRANCHES = ["if", "else", "for", "while", "case", "catch", "&&", "||", "?"]


def complexity(files: DataFrame) -> DataFrame:
    """path, branches, maxNesting, maxLine, meanLine, commentRatio. A line opens one level at most and closes one at
    most, never below nought; lengths are UTF-16 units. A null content counts as an empty one."""
    all_ = F.split(F.coalesce("content", F.lit("")), "\n")
    count = lambda test: F.size(F.filter(all_, test))
    having = lambda part: count(lambda x: x.contains(part))
    branches = sum(map(having, BRANCHES[1:]), having(BRANCHES[0]))

    def step(s: Column, x: Column) -> Column:
        opened = s["now"] + F.when(x.contains("{"), 1).otherwise(0)
        closed = F.when(x.contains("}"), F.greatest(opened - 1, F.lit(0))).otherwise(opened)
        return F.struct(closed.alias("now"), F.greatest(s["most"], opened).alias("most"))

    depth = F.aggregate(all_, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])
    lengths = F.transform(all_, lambda x: F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", "")))
    return files.select(
        "path", branches.alias("branches"), depth.alias("maxNesting"), F.array_max(lengths).alias("maxLine"),
        (F.aggregate(lengths, F.lit(0).cast("long"), lambda s, n: s + n) / F.size(all_)).alias("meanLine"),
        (count(lambda x: trimmed(x).rlike(r"^(?://|/\*|\*)")) / F.size(all_)).alias("commentRatio"),
    )


def find_patterns(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """path, pattern, index, match, groups: every match of every pattern, with its place."""
    import re

    compiled = {k: re.compile(p) for k, p in patterns.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, k, m.start(), m[0], [g or "" for g in m.groups()]) for p, c in zip(part["path"], part["content"], strict=True) for k, r in compiled.items() for m in r.finditer(c or "")]
            yield pd.DataFrame(rows, columns=["path", "pattern", "index", "match", "groups"])

    return files.select("path", "content").mapInPandas(run, "path string, pattern string, index long, match string, groups array<string>")


def snippet(content: str, start: int, kind: str = "function", name: str = "", most: int = 100) -> str:
    """The lines of a definition: two before it, to its end by braces or indent, three after; a class: twenty."""
    rows = (content or "").split("\n")
    at = max(0, start - 1)
    if at >= len(rows):
        return ""
    if kind.lower() == "class":
        end = at + 20
    elif "{" in "".join(rows[at : at + 3]):
        depth, end, opened = 0, at, False
        for k in range(at, len(rows)):
            depth += rows[k].count("{") - rows[k].count("}")
            opened |= "{" in rows[k]
            end = k
            if opened and depth <= 0:
                break
        end += 3
    else:
        indent = len(rows[at]) - len(rows[at].lstrip())
        end = at
        for k in range(at + 1, len(rows)):
            if rows[k].strip() and len(rows[k]) - len(rows[k].lstrip()) <= indent:
                break
            end = k
        end += 3
    first = max(0, at - 2)
    return "\n".join(rows[first : min(len(rows), end + 1, first + most)])


def snippets(definitions: DataFrame) -> DataFrame:
    """id, content, startLine, type, name -> id, snippet."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["snippet"] = [snippet(c, int(s), t or "", n or "") for c, s, t, n in zip(part["content"], part["startLine"], part["type"], part["name"], strict=True)]
            yield part[["id", "snippet"]]

    return definitions.select("id", "content", "startLine", "type", "name").mapInPandas(run, "id string, snippet string")


#: Processors by name: (path, content) -> rows.
PROCESSORS = {"structure": structure, "dependencies": dependencies, "calls": calls, "complexity": complexity}
