"""Paths to Project, Folder and File nodes with CONTAINS edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def node_id(kind: str | Column, *parts) -> Column:
    """An id that depends on what a node is alone."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", F.lower(kind), F.substring(F.sha2(F.concat_ws("|", kind, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32))


def all_paths(paths: DataFrame) -> DataFrame:
    """path, is_folder of the given paths and their ancestors; a folder is what lies above another path."""
    own = paths.select(P.normalize(F.col("path")).alias("path")).filter("path <> ''")
    above = own.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    marked = own.withColumn("above", F.lit(False)).unionByName(above.withColumn("above", F.lit(True)))
    return marked.groupBy("path").agg(F.max("above").alias("is_folder"))


def visible(paths: DataFrame) -> DataFrame:
    return paths.filter(~P.hidden(F.col("path")))


def build(paths: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what is visible; ``ord`` follows the depth, then the path."""
    shown = visible(all_paths(paths))
    label = F.when(F.col("is_folder"), "Folder").otherwise("File")
    depth = F.size(F.split("path", "/"))
    nodes = shown.select(
        node_id(label, F.col("path")).alias("id"), label.alias("label"), P.basename(F.col("path")).alias("name"), "path",
        F.when(~F.col("is_folder"), F.col("path")).alias("filePath"), F.when(~F.col("is_folder"), P.extension(F.col("path"))).alias("extension"),
        F.when(~F.col("is_folder"), P.language(F.col("path"))).alias("language"), depth.cast("int").alias("depth"), (depth.cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("path"), F.lit(1 << 40))).alias("ord"),
    )
    root = paths.sparkSession.range(1).select(node_id("Project", F.lit(project)).alias("id"), F.lit("Project").alias("label"), F.lit(project).alias("name"), F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord"))
    above = F.when(F.col("path").contains("/"), node_id("Folder", P.parent(F.col("path")))).otherwise(node_id("Project", F.lit(project)))
    edges = nodes.select(F.lit("CONTAINS").alias("type"), above.alias("src"), F.col("id").alias("dst"), "ord").withColumn("id", F.concat_ws("|", "type", "src", "dst"))
    return root.unionByName(nodes, allowMissingColumns=True), edges


def validate_repository(paths: DataFrame, files: DataFrame) -> DataFrame:
    """problem rows: nothing there, no source files, files without content (folders don't count)."""
    known = all_paths(paths).filter("NOT is_folder")
    source = known.filter(P.is_source(F.col("path")))
    row = lambda text: F.lit(text).alias("problem")
    none = known.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(row("no files"), F.lit(None).cast("string").alias("path"))
    plain = source.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(row("no source files"), F.lit(None).cast("string").alias("path"))
    lost = known.join(files.select("path").distinct(), "path", "left_anti").select(row("no content"), "path")
    return none.unionByName(plain).unionByName(lost)
