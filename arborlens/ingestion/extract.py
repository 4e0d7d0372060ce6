"""Definitions, imports and calls of source files: one pass of Python code over (path, content).

Python files go through ``ast``. JavaScript, TypeScript and Java go through a scanner that blanks comments
and strings and then matches declarations by pattern and braces; code built at run time, decorators with
nested braces in their arguments and overloads without bodies are beyond it. A file that can't be parsed
gives one row of kind ``error``. One row per (file, name, line): a method is not a function too.
"""

from __future__ import annotations

import ast
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ["path", "kind", "ord", "name", "type", "startLine", "endLine", "parameters", "parentClass", "decorators", "extends", "isAsync", "docstring", "module", "exportedName", "importType", "callType", "error"]
SCHEMA = (
    "path string, kind string, ord long, name string, type string, startLine long, endLine long, parameters array<string>, "
    "parentClass string, decorators array<string>, extends array<string>, isAsync boolean, docstring string, "
    "module string, exportedName string, importType string, callType string, error string"
)


class Language(ABC):
    """A plug-in: rows (dicts) of one file's definitions, imports and calls."""

    extensions: tuple[str, ...] = ()

    @abstractmethod
    def rows(self, content: str) -> Iterator[dict]: ...


class PythonSource(Language):
    extensions = (".py",)

    def rows(self, content: str) -> Iterator[dict]:
        yield from self._body(ast.parse(content), None)

    def _body(self, tree: ast.AST, parent: str | None) -> Iterator[dict]:
        for node in ast.iter_child_nodes(tree):
            inner = parent
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = node.args
                names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                yield {"kind": "def", "name": node.name, "type": "method" if parent else "function", "startLine": node.lineno, "endLine": node.end_lineno, "parameters": names, "parentClass": parent, "decorators": [ast.unparse(d) for d in node.decorator_list], "isAsync": isinstance(node, ast.AsyncFunctionDef), "docstring": ast.get_docstring(node)}
                inner = None
            elif isinstance(node, ast.ClassDef):
                yield {"kind": "def", "name": node.name, "type": "class", "startLine": node.lineno, "endLine": node.end_lineno, "decorators": [ast.unparse(d) for d in node.decorator_list], "extends": [ast.unparse(b) for b in node.bases], "docstring": ast.get_docstring(node)}
                inner = node.name
            elif isinstance(node, ast.Import):
                for n in node.names:
                    yield {"kind": "import", "name": n.asname or n.name.split(".")[0], "module": n.name, "exportedName": n.name, "importType": "namespace", "startLine": node.lineno}
            elif isinstance(node, ast.ImportFrom):
                for n in node.names:
                    yield {"kind": "import", "name": n.asname or n.name, "module": "." * node.level + (node.module or ""), "exportedName": n.name, "importType": "named", "startLine": node.lineno}
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(tree, ast.Module):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        yield {"kind": "def", "name": t.id, "type": "variable", "startLine": node.lineno, "endLine": node.end_lineno}
            if isinstance(node, ast.Call):
                f = node.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    yield {"kind": "call", "name": name, "callType": "function_call", "startLine": node.lineno, "endLine": node.end_lineno}
            yield from self._body(node, inner)


def blank(text: str) -> str:
    """The text with comments and the insides of strings as spaces; lines and places stay."""
    out, i, n, before = list(text), 0, len(text), ""

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end)
            i = end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            wipe(i, end)
            i = end
        elif c in "'\"`":
            j = i + 1
            while j < n and text[j] != c and not (c != "`" and text[j] == "\n"):
                j += 2 if text[j] == "\\" else 1
            wipe(i + 1, j)
            i, before = j + 1, c
        elif c == "/" and (not before or before in "(,=:[!&|?{};\n"):
            m = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(text, i)
            if m:
                wipe(i + 1, m.end() - 1)
                i, before = m.end(), "/"
            else:
                i, before = i + 1, c
        else:
            if not c.isspace():
                before = c
            i += 1
    return "".join(out)


def block_end(code: str, at: int) -> int:
    """The place after the block that opens at or after a place; the line's end without one."""
    open_ = code.find("{", at)
    line = code.find("\n", at)
    semi = code.find(";", at)
    if open_ < 0 or 0 <= semi < open_:
        return line if line >= 0 else len(code)
    depth = 0
    for m in re.finditer(r"[{}]", code[open_:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return open_ + m.end()
    return len(code)


class Scanned(Language):
    """What the scanner's languages share."""

    keywords = frozenset("if for while switch catch return typeof new await function constructor super do else try with in of instanceof throw case void delete yield synchronized assert".split())

    @staticmethod
    def line(text: str, at: int) -> int:
        return text.count("\n", 0, at) + 1

    def definition(self, code: str, m: re.Match, name: str, kind: str, **more) -> dict:
        return {"kind": "def", "name": name, "type": kind, "startLine": self.line(code, m.start(1)), "endLine": self.line(code, max(m.start(1), block_end(code, m.end()) - 1)), **more}

    def inside(self, spans: list[tuple[int, int, str]], at: int) -> str | None:
        best = [s for s in spans if s[0] < at < s[1]]
        return max(best)[2] if best else None

    def calls(self, code: str) -> Iterator[dict]:
        for m in re.finditer(r"(\bnew\s+)?((?:[\w$]+\s*\??\.\s*)*)([\w$]+)\s*\(", code):
            if m[3] in self.keywords or m[3].isdigit() or re.search(r"\bfunction\s*\*?\s*$|\b(class|interface|enum)\s+$", code[max(0, m.start() - 20) : m.start(3)]):
                continue
            close, depth = len(code), 0
            for b in re.finditer(r"[()]", code[m.end() - 1 :]):
                depth += 1 if b[0] == "(" else -1
                if not depth:
                    close = m.end() - 1 + b.end()
                    break
            if re.match(r"\s*(:[^={;]+)?\{", code[close : close + 80]) and not m[1] and not m[2]:
                continue  # a method's head
            yield {"kind": "call", "name": m[3], "callType": "constructor_call" if m[1] else "method_call" if m[2] else "function_call", "startLine": self.line(code, m.start()), "endLine": self.line(code, close - 1)}

    @staticmethod
    def parameters(text: str) -> list[str]:
        return [re.sub(r"[\s?:=].*", "", p.strip().lstrip(".")) for p in re.sub(r"<[^<>]*>|\{[^{}]*\}|\[[^\[\]]*\]", "x", text, flags=re.S).split(",") if p.strip()]


class ScriptSource(Scanned):
    extensions = (".js", ".jsx", ".ts", ".tsx")

    def rows(self, content: str) -> Iterator[dict]:
        code = blank(content)
        classes = [(m.start(), block_end(code, m.end()), m[2]) for m in re.finditer(r"(\b(?:abstract\s+)?class\s+)([\w$]+)", code)]
        for m in re.finditer(r"(\bclass\s+)([\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w$.]+))?", code):
            yield self.definition(code, m, m[2], "class", extends=[m[3]] if m[3] else [])
        for word, kind in (("interface", "interface"), ("enum", "enum")):
            for m in re.finditer(rf"(\b{word}\s+)([\w$]+)", code):
                yield self.definition(code, m, m[2], kind)
        for m in re.finditer(r"(\btype\s+)([\w$]+)(?:<[^=]*>)?\s*=", code):
            yield self.definition(code, m, m[2], "type")
        for m in re.finditer(r"((?:\basync\s+)?\bfunction\s*\*?\s*)([\w$]+)\s*(?:<[^(]*>)?\(([^)]*)\)", code):
            yield self.definition(code, m, m[2], "function", parameters=self.parameters(m[3]), isAsync="async" in m[1])
        for m in re.finditer(r"(\b(?:const|let|var)\s+)([\w$]+)(?:\s*:[^=;\n]+?)?\s*=\s*(async\s*)?(?:function\b[^(]*)?(?:\(([^)]*)\)(?:\s*:[^=\n{]+)?\s*(?:=>|(?=\{))|([\w$]+)\s*=>)", code):
            yield self.definition(code, m, m[2], "function", parameters=self.parameters(m[4] or m[5] or ""), isAsync=bool(m[3]))
        arrows = {m.start(2) for m in re.finditer(r"(\b(?:const|let|var)\s+)([\w$]+)(?:\s*:[^=;\n]+?)?\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)(?:\s*:[^=\n{]+)?\s*=>|[\w$]+\s*=>)", code)}
        for m in re.finditer(r"^((?:export\s+)?(?:const|let|var)\s+)([\w$]+)", code, re.M):
            if m.start(2) not in arrows:
                line = self.line(code, m.start(1))
                yield {"kind": "def", "name": m[2], "type": "variable", "startLine": line, "endLine": line}
        for m in re.finditer(r"^(\s*(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*)([\w$]+)\s*(?:<[^(]*>)?\(([^)]*)\)\s*(?::[^={;\n]+)?\{", code, re.M):
            owner = self.inside(classes, m.start(2))
            if owner and m[2] not in self.keywords - {"constructor"}:
                head = re.match(r"\s*", m[1]).end() + m.start(1)
                d = self.definition(code, m, m[2], "method", parameters=self.parameters(m[3]), parentClass=owner, isAsync="async" in m[1])
                yield d | {"startLine": self.line(code, head), "endLine": self.line(code, max(head, block_end(code, m.end() - 1) - 1))}
        yield from self.imports(content, code)
        yield from self.calls(code)

    def imports(self, content: str, code: str) -> Iterator[dict]:
        def row(m: re.Match, name: str, module: str, exported: str, kind: str) -> dict:
            return {"kind": "import", "name": name, "module": module, "exportedName": exported, "importType": kind, "startLine": self.line(code, m.start())}

        for m in re.finditer(r"\bimport\s+(?:type\s+)?([^'\"();]+?)\s+from\s+(['\"])([^'\"]*)\2", content):
            if code[m.start()] != "i":
                continue
            what, module = m[1], m[3]
            names = re.search(r"\{([^}]*)\}", what)
            rest = re.sub(r"\{[^}]*\}", "", what)
            if star := re.search(r"\*\s+as\s+([\w$]+)", rest):
                yield row(m, star[1], module, "*", "namespace")
                rest = re.sub(r"\*\s+as\s+[\w$]+", "", rest)
            for name in re.findall(r"[\w$]+", rest):
                yield row(m, name, module, "default", "default")
            for part in (names[1] if names else "").split(","):
                words = re.findall(r"[\w$]+", re.sub(r"^\s*type\s+", "", part))
                if words:
                    yield row(m, words[-1], module, words[0], "named")
        for m in re.finditer(r"^\s*import\s+(['\"])([^'\"]*)\1", content, re.M):
            yield row(m, m[2], m[2], "*", "namespace")
        for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\s*\(\s*(['\"])([^'\"]*)\2", content):
            if code[m.start()] == " ":
                continue
            if m[1].startswith("{"):
                for part in m[1][1:-1].split(","):
                    words = re.findall(r"[\w$]+", part)
                    if words:
                        yield row(m, words[-1], m[3], words[0], "named")
            else:
                yield row(m, m[1], m[3], "default", "default")
        for m in re.finditer(r"\bimport\s*\(\s*(['\"])([^'\"]*)\1", content):
            yield row(m, m[2], m[2], "*", "dynamic")


class JavaSource(Scanned):
    extensions = (".java",)

    def rows(self, content: str) -> Iterator[dict]:
        code = blank(content)
        spans = []
        for m in re.finditer(r"(\b(class|interface|enum)\s+)(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w.]+))?", code):
            spans.append((m.start(), block_end(code, m.end()), m[3]))
            yield self.definition(code, m, m[3], m[2], extends=[m[4]] if m[4] else [])
        for m in re.finditer(r"^(\s*(?:@\w+\s+)?(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\],.? ]+?\s+)(\w+)\s*\(([^)]*)\)\s*(?:throws [\w, .]+)?\{", code, re.M):
            if m[2] not in self.keywords and not re.search(r"\b(new|return|else)\b", m[1]):
                head = m.start(1) + re.match(r"\s*", m[1]).end()
                names = [p.split()[-1] for p in m[3].split(",") if p.strip()]
                yield {"kind": "def", "name": m[2], "type": "method", "startLine": self.line(code, head), "endLine": self.line(code, block_end(code, m.end() - 1) - 1), "parameters": names, "parentClass": self.inside(spans, m.start(2))}
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)\.(\w+|\*)\s*;", code, re.M):
            yield {"kind": "import", "name": m[2], "module": m[1], "exportedName": m[2], "importType": "namespace" if m[2] == "*" else "named", "startLine": self.line(code, m.start(1))}
        yield from self.calls(code)


#: Plug-ins by extension.
REGISTRY: dict[str, Language] = {e: source for source in (PythonSource(), ScriptSource(), JavaSource()) for e in source.extensions}
#: Names that are no definitions.
NOISE = {"anonymous", "default", "undefined", "null"}


def rows_of(path: str, content: str | None) -> list[dict]:
    """Rows of one file, in order; definitions once per name and line, methods before functions."""
    source = REGISTRY.get("." + path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if source is None or not content:
        return []
    try:
        found = list(source.rows(content))
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"kind": "error", "error": f"{type(e).__name__}: {e}"}]
    best: dict = {}
    out = []
    for r in found:
        if r["kind"] == "def":
            if r["name"] in NOISE or (len(r["name"]) < 2 and r["type"] != "variable"):
                continue
            key = (r["name"], r["startLine"])
            if key in best:
                if best[key]["type"] == "function" and r["type"] == "method" or best[key]["type"] == "variable" and r["type"] == "function":
                    best[key].update(r)
                continue
            best[key] = r
        out.append(r)
    return out


def extract(files: DataFrame) -> DataFrame:
    """(path, content) -> rows of SCHEMA."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"path": p, "ord": k, **r} for p, c in zip(part["path"], part["content"], strict=True) for k, r in enumerate(rows_of(p, c))]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("ord", "startLine", "endLine"):
                out[c] = out[c].astype("Int64")
            for c in ("parameters", "decorators", "extends"):
                out[c] = [x if isinstance(x, list) else None for x in out[c]]
            out["isAsync"] = out["isAsync"].astype("boolean")
            yield out.astype(object).where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
