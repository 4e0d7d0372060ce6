"""Lines and files mapped by user functions, with errors kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def map_lines(lines: DataFrame, process: Callable[[str, int], str | None]) -> DataFrame:
    """(line, text) -> line, result, error: null results are dropped; an error keeps the line's first 100 characters.
    Works on batches and streams alike."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for n, text in zip(part["line"], part["text"], strict=True):
                try:
                    out = process(text, int(n))
                    if out is not None:
                        rows.append((n, out, None))
                except Exception as e:  # noqa: BLE001  a user's function may raise anything; it becomes a row
                    rows.append((n, None, f"{e}: {(text or '')[:100]}"))
            yield pd.DataFrame(rows, columns=["line", "result", "error"]).astype({"line": "int64"})

    return lines.select(F.col("line").cast("long").alias("line"), "text").mapInPandas(run, "line long, result string, error string")


def read_lines(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """path, line, text of text files up to a size."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes)
    return files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they appear in a folder."""
    return spark.readStream.text(path).select(F.col("value").alias("text"), F.lit(0).cast("long").alias("line"))


def map_files(files: DataFrame, process: Callable[[str, str], str]) -> DataFrame:
    """(path, content) -> path, result, error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows.append((path, process(path, content), None))
                except Exception as e:  # noqa: BLE001  as above
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "result", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, result string, error string")


def map_batches(items: DataFrame, process: Callable[[list], list], each: int = 100, value: str = "value", schema: str = "value string") -> DataFrame:
    """A column's values, in batches; a batch that fails is left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), each):
                try:
                    out = process(part[value].iloc[at : at + each].tolist())
                except Exception:  # noqa: BLE001, S112  the contract: a failed batch is skipped
                    continue
                yield pd.DataFrame({schema.split()[0]: out})

    return items.select(value).mapInPandas(run, schema)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return it as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
