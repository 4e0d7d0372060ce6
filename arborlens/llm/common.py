"""Helpers shared by the corpus operators: inputs, shared tables, Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id, where ids are compared: last.
NULL_ID = (1 << 63) - 1
#: What words are made of, for every operator that counts words: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, whole."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that Spark hands to Python at a time, where the session has no setting of its own: texts are long.
ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Keep the batches between Spark and its Python workers small: both sides hold one for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own
        spark.conf.set(name, str(ROWS))


def columns_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no further column of the input can clash with a working name."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def carried(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, text, and the columns of the input in one struct ``rest``, where no name can clash; the text itself
    is among them only on request."""
    small_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "text" or with_text]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*columns).alias("rest"))


def restored(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with the new text, and n_chars in step with it if there is one."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one is made only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what write_table wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few dozen bytes each that a join may carry to every executor (some 10 MB).
BROADCAST_ROWS = 250_000


def small_or_shuffled(side: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint for the smaller side of a join, after its rows were counted: a broadcast up to ``most``, beyond
    that a hash join of shuffled sides."""
    return F.broadcast(side) if rows <= most else side.hint("shuffle_hash")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more, before the next
    step fills the disk. Files of plans still in use stay."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


#: Bytes of texts that a batch holds at most, but for a single longer text.
BYTES = 4 << 20


def batches(parts: Iterable[pa.RecordBatch], rows: int = 512, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of so many rows and ``most`` bytes of strings, so that what one batch holds and gives stays
    bounded; idle workers keep little."""
    trim()
    for part in parts:
        ends = np.zeros(part.num_rows, np.int64)
        for column in part.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        at = 0
        while at < part.num_rows:
            held = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, held + most, "right"))))
            yield part.slice(at, to - at)
            at = to
        del part
    trim()


def salt(by: Column, count: Column, each: int) -> Column:
    """A number below ceil(count / each) for a row: splits a group of ``count`` rows."""
    return F.pmod(F.xxhash64(by), F.greatest(F.ceil(count / F.lit(each)), F.lit(1)).cast("long"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links -> (node, label): label is the smallest node that can be reached.

    Alternates large-star and small-star steps on the links until they stay as they are. Every step is a
    ``min`` by node, which is combined before the shuffle, and a join that Spark may split, so no node's
    neighbours are gathered. The driver sees one count and one checksum a round.
    """
    edges = write_table(links.select("a", "b").filter("a <> b").distinct(), name)
    seen = None
    while True:
        # large star: link every larger neighbour to the smallest of the neighbourhood
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: link every smaller neighbour, and the node, to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        after = write_table(small, name)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges = after
        if tuple(mark) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = tuple(mark)
