"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory and file names that hide what is below them.
IGNORED = [
    ".git", ".svn", ".hg", "node_modules", "bower_components", "jspm_packages", "vendor", "deps", "venv", "env", ".venv", ".env", "envs",
    "virtualenv", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "build", "dist", "out", "target", "bin", "obj", ".gradle", "_build",
    "public", "assets", "static", ".vs", ".vscode", ".idea", ".eclipse", ".settings", "tmp", ".tmp", "temp", "logs", "log", "coverage",
    ".coverage", "htmlcov", ".nyc_output", ".DS_Store", "Thumbs.db", "_site", ".docusaurus", ".cache", ".parcel-cache", ".next", ".nuxt",
]
#: Extensions of source files; names of files that configure a project.
SOURCE = [".js", ".ts", ".jsx", ".tsx", ".py", ".java", ".cpp", ".c", ".cc", ".cxx", ".h", ".hpp", ".hxx", ".cs", ".php", ".rb", ".go", ".rs"]
CONFIG = ["package.json", "tsconfig.json", "jsconfig.json", "webpack.config.js", "vite.config.ts", "vite.config.js", ".eslintrc.js", ".eslintrc.json", "babel.config.js", "rollup.config.js"]
#: Parts and ends of names of files that hold no code.
NOT_CODE_PARTS = ["readme", "license", "changelog", "contributing", "authors", "maintainers", ".gitignore", ".gitattributes", "dockerfile", "docker-compose"]
NOT_CODE_ENDS = [".md", ".txt", ".log", ".lock"]
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java"}


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def extname(p: Column) -> Column:
    """From the path's last dot on; '' without one."""
    return F.regexp_extract(p, r"(\.[^.]*)$", 1)


def extension(p: Column) -> Column:
    """The extension of the name; names that start with their only dot have none."""
    return F.regexp_extract(basename(p), r"^.+(\.[^.]*)$", 1)


def dirname(p: Column, none: str = ".") -> Column:
    """Up to the last slash of either kind; ``none`` where there is none."""
    return F.when(p.rlike(r"[/\\]"), F.regexp_extract(p, r"^(.*)[/\\][^/\\]*$", 1)).otherwise(none)


def parent(p: Column) -> Column:
    return F.regexp_replace(p, "/?[^/]*$", "")


def normalize(p: Column) -> Column:
    """Forward slashes, single, none at the end, no ``.`` segments."""
    p = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"(?<=^|/)\./", ""), r"/\.$", "")
    return F.regexp_replace(p, "(?<=.)/$", "")


def join(a: Column, b: Column) -> Column:
    return normalize(F.concat_ws("/", F.nullif(a, F.lit("")), b))


def resolve(folder: Column, relative: Column) -> Column:
    """A relative path from a folder: leading ``./`` and ``../`` are followed, the rest is appended."""
    ups = F.size(F.regexp_extract_all(F.regexp_extract(relative, r"^((?:\.\.?/)*)", 1), F.lit(r"\.\./"), F.lit(0)))
    rest = F.regexp_replace(relative, r"^(\.\.?/)+", "")
    parts = F.filter(F.split(F.when(folder == ".", "").otherwise(folder), "/"), lambda x: x != "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0)))
    return F.array_join(F.concat(kept, F.array(rest)), "/")


def distance(a: Column, b: Column) -> Column:
    """The longer path's segments less the shared first ones."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, s: F.struct((acc["n"] + F.when(acc["on"] & s, 1).otherwise(0)).alias("n"), (acc["on"] & s).alias("on")), lambda acc: acc["n"])
    return F.greatest(F.size(x), F.size(y)) - shared


def tree_distance(a: Column, b: Column) -> Column:
    """``distance`` without empty segments; -1 where all but the shorter path's last segment are shared."""
    x, y = (F.filter(F.split(p, "/"), lambda s: s != "") for p in (a, b))
    d = distance(F.array_join(x, "/"), F.array_join(y, "/"))
    shared = F.greatest(F.size(x), F.size(y)) - d
    return F.when(shared == F.least(F.size(x), F.size(y)) - 1, F.lit(-1)).otherwise(d)


def siblings(a: Column, b: Column) -> Column:
    return dirname(a, "") == dirname(b, "")


def language(p: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.lower(extname(p))), F.lit("generic"))


def _ends(p: Column, ends: list[str]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | p.endswith(e)
    return out


def _has(p: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | p.contains(x)
    return out


def is_source(p: Column) -> Column:
    return _ends(F.lower(p), SOURCE)


def is_config(p: Column) -> Column:
    return _ends(p, CONFIG) | F.lower(p).endswith(".json")


def hidden(p: Column) -> Column:
    """A path of which a segment is ignored or starts with a dot (.github excepted)."""
    ignored = F.array(*[F.lit(x.lower()) for x in IGNORED])
    by_segment = F.exists(F.split(p, "/"), lambda s: F.array_contains(ignored, F.lower(s)) | (s.startswith(".") & (s != ".github")))
    return by_segment | p.contains(".egg-info") | p.contains("site-packages")


def parse_eligible(p: Column, content: Column, folder: str = "", ends: list[str] | None = None, loose: bool = False) -> Column:
    """Whether a file is worth parsing. ``loose`` takes ignored names as substrings and skips the name rules."""
    out = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " ")) != ""
    if folder:
        out = out & p.contains(folder)
    if ends:
        out = out & _ends(p, ends)
    if loose:
        return out & ~_has(p, IGNORED)
    ignored = F.array(*[F.lit(x) for x in IGNORED])
    name = F.lower(basename(p))
    return out & ~F.arrays_overlap(F.split(p, "/"), ignored) & ~_has(name, NOT_CODE_PARTS) & ~name.startswith(".git") & ~_ends(name, NOT_CODE_ENDS)


def minified(p: Column, content: Column) -> Column:
    """Compiled or minified, by name, by a first line over 500 characters, or by a bundler's marks."""
    name, first = F.lower(basename(p)), F.get(F.split(content, "\n"), 0)
    marks = ["__webpack_require__", "!function(", "var Module=void 0!==Module?Module:{}"]
    return _has(name, [".min.", ".bundle."]) | (F.length(first) > 500) | _has(first, marks) | content.contains("/*! ") | content.rlike(r"^\s*!function\s*\(")


def archive_path(p: Column) -> Column:
    """Without the first component."""
    return F.regexp_replace(p, "^[^/]+/", "")


def valid_path(p: Column) -> Column:
    return F.length(p).between(1, 500) & ~p.contains("..") & ~p.contains("~")


def sanitise(x: Column) -> Column:
    """Trimmed, without angle brackets, the first thousand characters."""
    return F.substring(F.translate(F.trim(x), "<>", ""), 1, 1000)


def ancestors(p: Column) -> Column:
    """All proper ancestors of a path."""
    parts = F.split(p, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
