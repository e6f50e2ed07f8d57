"""Exact duplicates by content-defined chunk recipes.

A text is cut where a hash of the last bytes meets a condition, so equal passages give equal chunks wherever they
stand. Each chunk is replaced by a verified identifier: its fingerprint, numbered where a dictionary of all chunks
shows that one fingerprint has several digests. Documents are equal if their ordered identifier lists are; only
identifiers move between machines, never text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _powers, arrow_map, join_checked, materialise

WINDOW, LEAST, MOST, MEAN_BITS = 48, 256, 16384, 11


def cut_points(data: bytes, window: int = WINDOW, least: int = LEAST, most: int = MOST, mean_bits: int = MEAN_BITS) -> list[int]:
    """The ends of the chunks of data. A chunk has least to most bytes, but for the last one."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    buf = np.frombuffer(data, np.uint8)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    rolled = (sums[window:] - sums[:-window]) * inverse[: n + 1 - window] * np.uint64(0xD6E8FEB86659FD93)
    marks = (np.flatnonzero(rolled >> np.uint64(64 - mean_bits) == 0) + window).tolist()
    out, start = [], 0
    for mark in [*marks, n]:
        while mark - start > most:
            start += most
            out.append(start)
        if mark - start >= least and mark < n:
            start = mark
            out.append(mark)
    if start < n:
        out.append(n)
    return out


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """(uid, id, text_sha256, chunks array<struct<fp, digest, bytes>>) of each row, text lower-cased in A-Z only."""
    chunk = pa.list_(pa.struct([("fp", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int32())]))
    schema = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("text_sha256", pa.string()), ("chunks", chunk)])
    shift = 64 - fingerprint_bits

    def cut(batch: pa.RecordBatch) -> dict:
        shas, chunks = [], []
        for text in batch.column("text"):
            data = (text.as_py() or "").encode("utf-8", "replace").lower()
            shas.append(hashlib.sha256(data).hexdigest())
            own, start = [], 0
            for end in cut_points(data):
                digest = hashlib.sha256(data[start:end]).digest()
                own.append({"fp": int.from_bytes(digest[:8], "big", signed=True) >> shift, "digest": digest, "bytes": end - start})
                start = end
            chunks.append(own)
        return {"uid": batch.column("uid"), "id": batch.column("id"), "text_sha256": shas, "chunks": chunks}

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(arrow_map(cut, schema), "uid long, id long, text_sha256 string, chunks array<struct<fp:long,digest:binary,bytes:int>>")


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """The distinct chunks: fp, digest, bytes, number (0 unless other digests share the fingerprint), uses."""
    each = recipes.select(F.explode("chunks").alias("c")).groupBy("c.fp", "c.digest").agg(F.first("c.bytes").alias("bytes"), F.count("*").alias("uses"))
    clash = each.groupBy("fp").agg(F.count("*").alias("n"), F.collect_set("digest").alias("all")).where("n > 1").select("fp", F.array_sort("all").alias("all"))
    return each.join(clash, "fp", "left").select("fp", "digest", "bytes", F.coalesce(F.array_position("all", F.col("digest")) - 1, F.lit(0)).cast("int").alias("number"), "uses")


def _identified(recipes: DataFrame) -> DataFrame:
    """(uid, id, text_sha256, recipe array<struct<fp, number>>)."""
    each = recipes.select(F.explode("chunks").alias("c")).select("c.fp", "c.digest")
    clash = each.groupBy("fp").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("fp")
    clash = materialise(clash, "clashes")
    plain = recipes.select("uid", "id", "text_sha256", F.transform("chunks", lambda c: F.struct(c["fp"].alias("fp"), F.lit(0).alias("number"))).alias("recipe"))
    if not clash.take(1):
        return plain
    digests = each.join(clash, "fp").distinct()
    ranks = materialise(digests.groupBy("fp").agg(F.array_sort(F.collect_set("digest")).alias("all")), "ranks")
    spread = recipes.select("uid", F.posexplode("chunks").alias("pos", "c")).select("uid", "pos", F.col("c.fp").alias("fp"), F.col("c.digest").alias("digest"))
    numbered = spread.join(ranks, "fp", "left").select("uid", "pos", F.struct("fp", F.coalesce(F.array_position("all", F.col("digest")) - 1, F.lit(0)).cast("int").alias("number")).alias("item"))
    lists = numbered.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("own"))
    return plain.join(lists, "uid", "left").select("uid", "id", "text_sha256", F.coalesce("own", "recipe").alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """The group of every row: (id_col, keep_id, group_size, kept, text_sha256, n_chunks).

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of a group, the row with the largest
    id stays and keep_id is its id; a null id is the smallest, and of rows repeated under the largest id one stays.
    Other columns are not read; an empty table gives an empty result. ``fingerprint_bits`` narrows the
    fingerprint, to test that clashing ones are told apart.
    """
    raw = materialise(chunk_recipes(docs, id_col, text_col, fingerprint_bits), "chunks")
    recipes = _identified(raw)
    best = F.max(F.struct("id", "uid"))
    groups = recipes.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("size")).where("size > 1")
    groups = materialise(groups.select("recipe", F.col("best.id").alias("top_id"), F.col("best.uid").alias("top_uid"), "size"), "groups")
    out = join_checked(recipes, groups, "recipe", "left", 64 + 32 * F.size("recipe"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("top_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("top_uid", "uid") == F.col("uid")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )
