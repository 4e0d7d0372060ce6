"""A repository as a Spark data source: listed once, fetched in batches by the executors.

``RepositorySource`` is the seam for code hosts: subclass it and give ``listing`` and ``fetch``. The one here
reads a directory that all executors see. A fetch that fails is tried again after growing pauses; one that
fails to the end becomes a row with its error. Register with ``spark.dataSource.register(RepositorySource)``.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH, TRIES, PAUSE = 20, 4, 0.1


class Batch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RepositorySource(DataSource):
    """path, content, size, error of each file. Options: root, batch."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, content string, size long, error string"

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options)


class RepositoryReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.batch = options["root"], int(options.get("batch", BATCH))

    def listing(self) -> list[str]:
        found = [os.path.relpath(os.path.join(d, f), self.root) for d, _, files in os.walk(self.root) for f in files]
        return sorted(p.replace(os.sep, "/") for p in found)

    def fetch(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as file:
            return file.read()

    def partitions(self) -> list[InputPartition]:
        paths = self.listing()
        return [Batch(paths[k : k + self.batch]) for k in range(0, len(paths), self.batch)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path in partition.paths:
            for attempt in range(TRIES):
                try:
                    data = self.fetch(path)
                except OSError as e:
                    if attempt == TRIES - 1:
                        yield path, None, None, str(e)
                    else:
                        time.sleep(PAUSE * 2**attempt)
                    continue
                yield path, data.decode("utf-8", "replace"), len(data), None
                break
