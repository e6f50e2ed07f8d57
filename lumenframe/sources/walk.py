"""Finding files: a data source that walks a folder, and a listing for stores that only Spark reads."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import EXTENSIONS, has_extension, hidden_below


def found_below(root: str, extensions: tuple[str, ...] = EXTENSIONS, deep: bool = True) -> Iterator[tuple[str, int, int] | None]:
    """(path, size, mtime) of each file below root, or only in it, or None for an entry that can't be read.

    Links aren't followed, entries whose name starts with a dot are skipped, extensions are taken in any case.
    """
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        yield None
        return
    for e in entries:
        try:
            if e.name.startswith(".") or e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if deep:
                    yield from found_below(e.path, extensions)
            elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1][1:].lower() in extensions:
                stat = e.stat(follow_symlinks=False)
                yield e.path, stat.st_size, max(0, int(stat.st_mtime))
        except OSError:
            yield None


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class WalkReader(DataSourceReader):
    def __init__(self, root: str, extensions: tuple[str, ...]):
        self.root, self.extensions = root, extensions

    def partitions(self):
        """The root's own files, and each folder in it."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        folders = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not e.name.startswith("."))
        return [Part(self.root, False), *(Part(f, True) for f in folders)]

    def read(self, partition):
        for x in found_below(partition.folder, self.extensions, partition.deep):
            if x is None:
                yield (None, None, None)
            else:
                yield x


class WalkSource(DataSource):
    """``spark.read.format("lumen_walk").load(root)``: path, size, mtime; a row of nulls for an unreadable entry."""

    @classmethod
    def name(cls):
        return "lumen_walk"

    def schema(self):
        return "path string, size long, mtime long"

    def reader(self, schema):
        listed = self.options.get("extensions")
        return WalkReader(self.options["path"].rstrip("/") or "/", tuple(listed.split(",")) if listed else EXTENSIONS)


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files below a folder that every executor sees."""
    spark.dataSource.register(WalkSource)
    return spark.read.format("lumen_walk").option("extensions", ",".join(extensions)).load(root)


def listed(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files below a folder of any store that Spark reads; contents aren't read.

    Spark's listing skips names that start with an underscore, and follows links.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return rows.where(has_extension(F.col("path"), extensions) & ~hidden_below(F.col("path"), root))
