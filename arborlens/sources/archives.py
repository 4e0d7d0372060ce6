"""ZIP archives and directories as (path, content) tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P

MAX_FILE, MAX_TOTAL = 10 << 20, 100 << 20
#: Extensions of files that hold text.
TEXT = [".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".c", ".cpp", ".h", ".cs", ".go", ".rs", ".rb", ".php", ".json", ".yml", ".yaml", ".xml", ".html", ".css", ".md", ".txt", ".sql", ".sh", ".toml"]
#: Directories and binary extensions left out of a remote listing.
SKIP_DIRECTORIES = ["node_modules", ".git", "dist", "build", "coverage", "__pycache__", "venv", ".venv", "target", "vendor"]
BINARY = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".pdf", ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib", ".woff", ".woff2", ".ttf", ".mp3", ".mp4", ".bin", ".class", ".jar", ".pyc"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, is_directory, size, mtime, content (bytes) of every entry of the ZIP files under a path.
    Paths come without a trailing slash; a damaged archive gives no entry but a row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, data in zip(part["path"], part["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for i in z.infolist():
                            at = "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*i.date_time)
                            rows.append((archive, i.filename.rstrip("/"), i.is_dir(), i.file_size, at, None if i.is_dir() else z.read(i), None))
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                    rows = [(archive, None, False, 0, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "path", "is_directory", "size", "mtime", "content", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, path string, is_directory boolean, size long, mtime string, content binary, error string")


def listing(entries: DataFrame) -> DataFrame:
    return entries.filter("error IS NULL").select("path", "is_directory", "size", "mtime").orderBy("path")


def complete(entries: DataFrame, max_file: int = MAX_FILE, max_total: int = MAX_TOTAL) -> tuple[DataFrame, DataFrame]:
    """(paths with their parents, sorted and each once; path and text of files within the limits)."""
    good = entries.filter("error IS NULL")
    own = good.select("path").unionByName(good.select(F.explode(P.ancestors(F.col("path"))).alias("path")))
    return own.distinct().orderBy("path"), texts(entries, max_file, max_total)


def texts(entries: DataFrame, max_file: int = MAX_FILE, max_total: int = MAX_TOTAL, extensions: Sequence[str] | None = None) -> DataFrame:
    """path, content of non-empty files, in archive order until the total is reached."""
    files = entries.filter("error IS NULL AND NOT is_directory AND size > 0").filter(F.col("size") <= max_file)
    if extensions is not None:
        files = files.filter(F.lower(P.extname(F.col("path"))).isin(*extensions))
    upto = Window.partitionBy("archive").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("_sum", F.sum("size").over(upto)).filter(F.col("_sum") <= max_total).select("path", F.decode("content", "UTF-8").alias("content"))


def pick(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """The named files; names that aren't there are left out."""
    return texts(entries).join(paths.select("path").distinct(), "path", "left_semi")


def clean_archive_paths(paths: DataFrame, extensions: Sequence[str] | None = None, reference_quirk: bool = False) -> DataFrame:
    """Paths without their first component, without those in skipped directories. With ``reference_quirk`` a
    directory's name anywhere in the path hides it."""
    out = paths.withColumn("path", P.archive_path(F.col("path"))).filter("path <> ''")
    for d in [*SKIP_DIRECTORIES, *(["test"] if reference_quirk else [])]:
        out = out.filter(~(F.col("path").contains(d) if reference_quirk else F.array_contains(F.split("path", "/"), d)))
    return out if extensions is None else out.filter(F.lower(P.extname(F.col("path"))).isin(*extensions))


def strip_top_folder(paths: DataFrame, share: float = 0.8, reference_quirk: bool = False) -> DataFrame:
    """Paths without a top folder that over ``share`` of them have. The quirk: only the first path's folder counts."""
    top = F.get(F.split("path", "/"), 0)
    deep = F.size(F.split("path", "/")) > 1
    if reference_quirk:
        best = paths.agg(F.min(F.struct("path")).alias("f")).select(F.when(F.col("f.path").contains("/"), F.get(F.split("f.path", "/"), 0)).alias("folder"))
    else:
        counts = paths.groupBy(top.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.max(deep).alias("deep")).filter("deep")
        best = counts.agg(F.max(F.struct("n", "folder")).alias("m")).crossJoin(paths.agg(F.count(F.lit(1)).alias("all"))).select(F.when(F.col("m.n") > F.col("all") * share, F.col("m.folder")).alias("folder"))
    out = paths.crossJoin(F.broadcast(best))  # one row
    start = F.concat(F.col("folder"), F.lit("/"))
    stripped = F.when(F.col("folder").isNull(), F.col("path")).when(F.col("path") == F.col("folder"), "").when(F.startswith("path", start), F.substr("path", F.length(start) + 1)).otherwise(F.col("path"))
    return out.withColumn("path", stripped).filter("path <> ''").drop("folder")


def wanted_remote(path: str = "path"):
    """Whether a listed file is worth fetching: not in a skipped directory, not binary, not minified."""
    p = F.col(path)
    return ~F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(d) for d in SKIP_DIRECTORIES])) & ~F.lower(P.extname(p)).isin(*BINARY) & ~p.rlike(r"\.min\.(js|css)$|\.map$|package-lock\.json$|yarn\.lock$")


def decode_content(content, encoding: str = "base64"):
    """A fetched file's text."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8") if encoding == "base64" else content


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), content, size of the files of a directory, whatever store it is in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    return files.select(F.element_at(F.split(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), F.concat(F.lit(r"\Q"), F.lit(base), F.lit(r"\E"))), -1).alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))
