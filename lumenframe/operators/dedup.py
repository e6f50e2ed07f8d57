"""Exact duplicates of files: size, then a hash of the first bytes, then the whole content's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ranked

PREFIX_BYTES = 4096


def live(files: DataFrame) -> DataFrame:
    """Files that aren't missing."""
    return files.where(F.col("status") != "missing")


def size_candidates(files: DataFrame) -> DataFrame:
    """Live files that share their size with another."""
    sizes = live(files).groupBy("size").agg(F.count("*").alias("n")).where("n >= 2").select("size")
    return live(files).join(sizes, "size", "left_semi")


def prefix_candidates(files: DataFrame) -> DataFrame:
    """Unhashed live files whose size and prefix hash (column ``prehash``) another file shares.

    Files of a size all of which have a content hash are left out; hashed files count as partners.
    """
    rows = live(files).where("prehash is not null")
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.bool_and(F.col("content_hash").isNotNull()).alias("done")).where("n >= 2 and not done").select("size")
    groups = rows.groupBy("size", "prehash").agg(F.count("*").alias("n")).where("n >= 2").select("size", "prehash")
    return rows.where("content_hash is null").join(sizes, "size", "left_semi").join(groups, ["size", "prehash"], "left_semi")


_ORDER = ("mtime", "path_bytes", "path")


def _hashed(files: DataFrame) -> DataFrame:
    return live(files).where("content_hash is not null").withColumn("path_bytes", F.octet_length("path"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """A row per content of two or more live files: (content_hash, size, n, reclaimable, keeper_path).

    The keeper is the oldest file, then the one of the shortest path in bytes, then the first path. Empty files
    count, with nothing to reclaim. One aggregation with map-side combine, whatever a group's size.
    """
    first = F.min(F.struct(*_ORDER, "size"))
    groups = _hashed(files).groupBy("content_hash").agg(F.count("*").alias("n"), first.alias("k")).where("n >= 2")
    return groups.select("content_hash", F.col("k.size").alias("size"), "n", (F.col("k.size") * (F.col("n") - 1)).alias("reclaimable"), F.col("k.path").alias("keeper_path"))


def ordered_groups(files: DataFrame) -> DataFrame:
    """Groups by what they would free, largest first, then by the keeper's path."""
    return duplicate_groups(files).orderBy(F.desc("reclaimable"), "keeper_path")


def duplicate_members(files: DataFrame) -> DataFrame:
    """The files of each group with their rank in it: (content_hash, path, mtime, rank)."""
    groups = duplicate_groups(files).select("content_hash")
    rows = _hashed(files).join(groups, "content_hash", "left_semi")
    out = ranked(rows.select("content_hash", *_ORDER), "content_hash", [F.col(c) for c in _ORDER])
    return out.select("content_hash", "path", "mtime", "rank")


def nested_groups(files: DataFrame) -> DataFrame:
    """The groups with their files as an ordered array of (mtime, path); for groups that fit a row."""
    files_of = F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER))), lambda f: F.struct(f["mtime"].alias("mtime"), f["path"].alias("path")))
    rows = _hashed(files).groupBy("content_hash").agg(F.first("size").alias("size"), F.count("*").alias("n"), files_of.alias("files")).where("n >= 2")
    return rows.withColumn("reclaimable", F.col("size") * (F.col("n") - 1))


def duplicate_totals(files: DataFrame) -> DataFrame:
    """One row: groups, redundant files and reclaimable bytes."""
    return duplicate_groups(files).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))
