"""Imports to files, calls to definitions, callers of calls: joins with ranks."""

from __future__ import annotations

import builtins
import collections
import datetime
import json
import logging
import math
import random
import re
import statistics
import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..tables import first_by
from .structure import node_id

def python_names() -> frozenset[str]:
    """Public names of Python's built-ins and plain types, of the classes of dates and loggers, and of the modules for
    JSON, patterns, numbers and identifiers, as the Python that runs has them. Other lists are given to ``is_builtin``."""
    holders = [builtins, str, bytes, list, dict, set, tuple, int, float, datetime.datetime, datetime.date, datetime.time, logging.Logger, json, re, math, random, statistics, uuid, collections]
    return frozenset(n for o in holders for n in dir(o) if not n.startswith("_"))


#: What ECMAScript 2023 defines, by object: global functions, constructors, and their public methods.
SCRIPT_NAMES = {
    "globals": "decodeURI decodeURIComponent encodeURI encodeURIComponent escape eval isFinite isNaN parseFloat parseInt unescape",
    "constructors": "AggregateError Array ArrayBuffer BigInt Boolean DataView Date Error EvalError Function Map Number Object Promise Proxy RangeError ReferenceError RegExp Set SharedArrayBuffer String Symbol SyntaxError TypeError URIError WeakMap WeakRef WeakSet",
    "Array": "at concat copyWithin entries every fill filter find findIndex findLast findLastIndex flat flatMap forEach from includes indexOf isArray join keys lastIndexOf map of pop push reduce reduceRight reverse shift slice some sort splice unshift values",
    "Date": "getDate getDay getFullYear getHours getMilliseconds getMinutes getMonth getSeconds getTime now setDate setFullYear setHours setMinutes setMonth setSeconds toDateString toISOString toJSON toTimeString",
    "JSON": "parse stringify",
    "Map and Set": "add clear delete get has set",
    "Math": "abs acos asin atan atan2 ceil cos exp floor log max min pow random round sign sin sqrt tan trunc",
    "Number": "isInteger isSafeInteger toExponential toFixed toPrecision",
    "Object": "assign create defineProperties defineProperty freeze fromEntries hasOwnProperty isPrototypeOf preventExtensions propertyIsEnumerable seal toLocaleString toString valueOf",
    "Promise": "all allSettled any catch finally race reject resolve then",
    "RegExp": "exec test",
    "String": "charAt charCodeAt codePointAt endsWith localeCompare match matchAll normalize padEnd padStart repeat replace replaceAll search split startsWith substring toLowerCase toUpperCase trim trimEnd trimStart",
}


def script_names() -> frozenset[str]:
    return frozenset(n for names in SCRIPT_NAMES.values() for n in names.split())


SUFFIXES = ["", ".js", ".ts", ".tsx", ".jsx", "/index.js", "/index.ts", "/index.tsx", "/index.jsx"]


def is_builtin(path: Column, name: Column, python: Collection[str] | None = None, script: Collection[str] | None = None) -> Column:
    """Names not worth resolving: a language's own, up to two letters, dunders, names that end with an underscore.

    The languages' names are parameters: Python's default to ``python_names``, those of JavaScript and TypeScript to
    ``script_names``. Names of browsers, frameworks, databases and test tools are in neither; give them where they count.
    """
    is_python, is_script = P.extname(path) == ".py", P.extname(path).isin(".js", ".jsx", ".ts", ".tsx")
    own = (is_python & name.isin(*sorted(python_names() if python is None else python))) | (is_script & name.isin(*sorted(script_names() if script is None else script)))
    return own | (F.length(name) <= 2) | name.rlike(r"^__\w+__$|^\w+_$")


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (path, name, module, exportedName, importType, ord) with targetFile, null where none is found.
    The last import of a local name counts."""
    files = paths.select(F.col("path").alias("file")).distinct()
    keyed = imports.groupBy("path", "name").agg(F.max_by(F.struct("module", "exportedName", "importType", "ord"), "ord").alias("i")).select("path", "name", "i.*")
    folder = P.dirname(F.col("path"), "")
    module = F.col("module")
    python = P.extname(F.col("path")) == ".py"
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    tail = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    up = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    inside = lambda base, x: F.regexp_replace(F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(x, F.lit(""))), "^/", "")
    relative = inside(up, tail)
    as_file = [F.concat(relative, F.lit(".py")), F.concat(relative, F.lit("/__init__.py")), F.concat(inside(relative, F.col("exportedName")), F.lit(".py"))]
    absolute = [F.concat(tail, F.lit(".py")), F.concat(tail, F.lit("/__init__.py")), F.concat(tail, F.lit("/"), F.col("exportedName"), F.lit(".py")), F.concat(inside(folder, tail), F.lit(".py"))]
    base = P.resolve(folder, module)
    script = [F.concat(base, F.lit(s)) for s in SUFFIXES]
    java = [F.concat(tail, F.lit("/"), F.col("exportedName"), F.lit(".java"))]
    options = F.when(python & (dots > 0), F.array(*as_file)).when(python, F.array(*absolute)).when(P.extname(F.col("path")) == ".java", F.array(*java)).when(module.startswith("."), F.array(*script)).otherwise(F.array().cast("array<string>"))
    asked = keyed.withColumn("_o", options)
    exact = asked.select("path", "name", F.posexplode("_o").alias("tier", "file")).join(files, "file").withColumn("whole", F.lit(0))
    # Python and Java packages under some other root: a file that ends with the whole dotted path
    last = F.element_at(F.split(tail, "/"), -1)
    stems = files.withColumn("stem", F.regexp_replace(P.basename(F.col("file")), r"\.[^.]*$", ""))
    far = asked.filter((python & (dots == 0)) | (P.extname(F.col("path")) == ".java")).withColumn("want", F.when(python, tail).otherwise(F.concat(tail, F.lit("/"), F.col("exportedName")))).withColumn("stem", F.when(python, last).otherwise(F.col("exportedName")))
    ending = far.join(stems, "stem").filter(F.endswith(F.regexp_replace("file", r"\.[^.]*$", ""), F.concat(F.lit("/"), F.col("want")))).select("path", "name", F.lit(0).alias("tier"), "file", F.lit(1).alias("whole"))
    found = first_by(exact.unionByName(ending), ["path", "name"], [F.col("whole"), F.col("tier"), F.col("file")]).select("path", "name", F.col("file").alias("targetFile"))
    return keyed.join(found, ["path", "name"], "left")


def import_edges(resolved: DataFrame) -> DataFrame:
    """One IMPORTS edge for each pair of different files, with the first import's names."""
    pairs = resolved.filter("targetFile IS NOT NULL AND targetFile <> path")
    first = first_by(pairs, ["path", "targetFile"], [F.col("ord"), F.col("name")])
    return first.select(F.lit("IMPORTS").alias("type"), node_id("File", F.col("path")).alias("src"), node_id("File", F.col("targetFile")).alias("dst"), "importType", F.col("name").alias("localName"), "exportedName", "ord").withColumn("id", F.concat_ws("|", "type", "src", "dst"))


LABEL_OF = {"class": "Class", "function": "Function", "method": "Method", "variable": "Variable", "interface": "Interface", "enum": "Enum", "type": "Type"}


def definition_nodes(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, DEFINES and EXTENDS edges) of definitions; a superclass is the class of that name, in the same file
    if there is one."""
    label = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in LABEL_OF.items()], F.lit("CodeElement"))
    nodes = defs.select(
        node_id(label, F.col("path"), F.col("name"), F.col("startLine")).alias("id"), label.alias("label"), "name", F.col("path").alias("filePath"), "type", "startLine", "endLine",
        F.concat_ws(":", "path", "name").alias("qualifiedName"), "parameters", "parentClass", "decorators", F.col("extends"), "isAsync", "docstring", P.language(F.col("path")).alias("language"), (F.lit(1 << 50) + F.col("ord")).alias("ord"),
    )
    defines = nodes.select(F.lit("DEFINES").alias("type"), node_id("File", F.col("filePath")).alias("src"), F.col("id").alias("dst"), "filePath", "ord")
    classes = nodes.filter("label = 'Class'").select(F.col("name").alias("base"), F.col("id").alias("base_id"), F.col("filePath").alias("base_file"))
    children = nodes.filter("label = 'Class'").select("id", "filePath", "ord", F.explode("extends").alias("base")).withColumn("base", F.element_at(F.split("base", r"\."), -1))
    up = first_by(children.join(classes, "base").filter("id <> base_id"), ["id", "base"], [(F.col("filePath") != F.col("base_file")).cast("int"), F.col("base_file"), F.col("base_id")])
    extends = up.select(F.lit("EXTENDS").alias("type"), F.col("id").alias("src"), F.col("base_id").alias("dst"), "filePath", "ord")
    return nodes, defines.unionByName(extends).withColumn("id", F.concat_ws("|", "type", "src", "dst"))


def callers(calls: DataFrame, nodes: DataFrame, innermost: bool = False) -> DataFrame:
    """calls with caller: the first function or method whose lines hold the call, else the first class, else the file."""
    holders = nodes.filter(F.col("label").isin("Function", "Method", "Class")).select(F.col("filePath").alias("path"), F.col("id").alias("holder"), F.col("startLine").alias("s"), F.col("endLine").alias("e"), F.col("ord").alias("o"), F.when(F.col("label") == "Class", 1).otherwise(0).alias("tier"))
    held = calls.join(holders, "path").filter("s <= startLine AND e >= endLine")
    order = [F.col("tier"), F.col("e") - F.col("s"), F.col("o")] if innermost else [F.col("tier"), F.col("o")]
    found = first_by(held, ["path", "ord"], [*order, F.col("holder")]).select("path", "ord", "holder")
    return calls.join(found, ["path", "ord"], "left").withColumn("caller", F.coalesce("holder", node_id("File", F.col("path")))).drop("holder")


def resolve_calls(calls: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls (path, ord, name, callType, ...) with callee, resolutionStage (exact, same-file, heuristic) and
    confidence; null where nothing fits. Each stage takes what the ones before left."""
    calls = calls.filter(~is_builtin(F.col("path"), F.col("name")))
    defs = nodes.filter(F.col("label").isin("Function", "Method", "Class", "Interface")).select(F.col("filePath").alias("file"), F.col("name").alias("def_name"), F.col("id").alias("callee"), F.col("label").alias("def_label"), F.col("ord").alias("def_ord"))
    preferred = F.when(F.col("callType") == "constructor_call", F.col("def_label") == "Class").when(F.col("callType") == "method_call", F.col("def_label") == "Method").otherwise(F.col("def_label") == "Function")
    rank = [(~preferred).cast("int"), F.col("def_ord"), F.col("callee")]
    known = resolved.filter("targetFile IS NOT NULL").select("path", "name", "targetFile", "exportedName", "importType")
    imported = calls.join(known, ["path", "name"]).join(defs, F.col("targetFile") == F.col("file"))
    fits = F.when(F.col("importType") == "named", F.col("def_name") == F.col("exportedName")).when(F.col("importType") == "namespace", F.lit(False)).otherwise(F.col("def_name") == F.col("name"))
    exact = first_by(imported.filter(fits), ["path", "ord"], rank).select("path", "ord", "callee", F.lit("exact").alias("resolutionStage"), F.lit(1.0).alias("confidence"))
    # a member of an imported module
    by_name = calls.join(defs, F.col("name") == F.col("def_name"))
    own = first_by(by_name.filter("path = file"), ["path", "ord"], rank).select("path", "ord", "callee", F.lit("same-file").alias("resolutionStage"), F.lit(0.9).alias("confidence"))
    far = P.distance(F.col("path"), F.col("file")).cast("double")
    far = far - F.when((F.col("path") == F.col("file")) & (F.col("callType") == "method_call"), 2.0).otherwise(0.0)
    far = far - F.when((F.col("callType") == "method_call") & (F.col("def_label") == "Method"), 0.5).otherwise(0.0) - F.when((F.col("callType") == "function_call") & (F.col("def_label") == "Function"), 0.5).otherwise(0.0)
    far = far - F.when(P.siblings(F.col("path"), F.col("file")), 1.0).otherwise(0.0)
    guess = first_by(by_name.withColumn("score", far), ["path", "ord"], [F.col("score"), F.col("def_ord"), F.col("callee")]).select("path", "ord", "callee", F.lit("heuristic").alias("resolutionStage"), F.when(F.col("score") <= 1, 0.6).otherwise(0.3).alias("confidence"))
    best = first_by(exact.withColumn("k", F.lit(0)).unionByName(own.withColumn("k", F.lit(1))).unionByName(guess.withColumn("k", F.lit(2))), ["path", "ord"], [F.col("k")]).drop("k")
    return calls.join(best, ["path", "ord"], "left")


def call_edges(placed: DataFrame) -> DataFrame:
    """One CALLS edge for each (caller, callee), with the first call's properties."""
    first = first_by(placed.filter("callee IS NOT NULL"), ["caller", "callee"], [F.col("path"), F.col("ord")])
    return first.select(F.lit("CALLS").alias("type"), F.col("caller").alias("src"), F.col("callee").alias("dst"), "callType", F.col("name").alias("functionName"), "confidence", "resolutionStage", F.col("startLine").alias("line_number"), "startLine", "endLine", F.col("path").alias("filePath"), "ord").withColumn("id", F.concat_ws("|", "type", "src", "dst"))


def diagnose(resolved_calls: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, name, reason of calls without a callee."""
    names = nodes.select("name").distinct().withColumn("known", F.lit(True))
    imported = resolved.select("path", "name").distinct().withColumn("imported", F.lit(True))
    lost = resolved_calls.filter("callee IS NULL").select("path", "name").join(imported, ["path", "name"], "left").join(names, "name", "left")
    return lost.select("path", "name", F.when(F.col("imported"), "imported but not defined").when(F.col("known"), "defined in other files").otherwise("not found").alias("reason"))


def without_file(defs: DataFrame, paths: DataFrame) -> DataFrame:
    """Definitions less those of some files, which are then extracted anew."""
    return defs.join(paths.select("path").distinct(), "path", "left_anti")
