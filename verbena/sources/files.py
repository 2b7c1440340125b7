"""Files of a folder tree as candidates, without reading contents unless asked for."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that scans leave out, besides those with a dot in front.
EXCLUDED = ("node_modules", "__pycache__", "venv", "site-packages")


def read_tree(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """path, name, folder, size, modified and content of the files under a root that Spark's file systems reach.

    Spark leaves out empty files and names with a dot or underscore in front; TreeSource lists all.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.select(F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_replace("path", r"/[^/]+$", "").alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return f if contents else f.drop("content")


def scannable(files: DataFrame, root: str, excluded: tuple[str, ...] = EXCLUDED, hidden: bool = False) -> DataFrame:
    """Files under root in no excluded folder, and, unless hidden ones are wanted, in none with a dot in front."""
    below = F.split(F.replace("folder", F.lit(root.rstrip("/")), F.lit("")), "/")
    out = F.lower
    bad = lambda d: out(d).isin(*excluded) if hidden else out(d).isin(*excluded) | d.startswith(".")
    return files.where(~F.exists(below, bad))


class TreeSource(DataSource):
    """A tree on the machine that runs the task, hidden and empty files included, for importing from a user's disk: option root."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, name string, folder string, size long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TreeReader(self.options["root"], tuple(self.options.get("excluded", ",".join(EXCLUDED)).split(",")), self.options.get("hidden", "false") == "true")


class TreeReader(DataSourceReader):
    def __init__(self, root: str, excluded: tuple[str, ...], hidden: bool):
        self.root, self.excluded, self.hidden = root, {e.lower() for e in excluded}, hidden

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.root):
            return [InputPartition(None)]
        return [InputPartition(None), *(InputPartition(d) for d in sorted(os.listdir(self.root)) if self._enter(self.root, d))]

    def _enter(self, folder: str, name: str) -> bool:
        full = os.path.join(folder, name)
        return os.path.isdir(full) and not os.path.islink(full) and name.lower() not in self.excluded and (self.hidden or not name.startswith("."))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if os.path.isfile(self.root):
            yield self.root, os.path.basename(self.root), os.path.dirname(self.root), os.path.getsize(self.root)
            return
        top = self.root if partition.value is None else os.path.join(self.root, partition.value)
        for folder, below, names in os.walk(top):
            below[:] = [] if partition.value is None else sorted(d for d in below if self._enter(folder, d))
            for n in sorted(names):
                full = os.path.join(folder, n)
                if os.path.isfile(full):
                    yield full, n, folder, os.path.getsize(full)
