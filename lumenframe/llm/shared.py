"""What the operators of this subpackage share: process-wide caches, row filters, Arrow helpers and word hashing."""

from __future__ import annotations

import string
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import forget, join_checked, materialise, scratch_path

__all__ = ["arrow_map", "forget", "join_checked", "materialise", "mix", "normal_words", "process_cache", "scratch_path", "survivors", "text_digest", "windows", "word_hashes"]


def process_cache(key: tuple, build: Callable):
    """``build()``, kept for the life of this Python process (workers are used for many tasks)."""
    store = sys.modules.setdefault("_lumenframe_process_cache", types.ModuleType("_lumenframe_process_cache"))
    if key not in store.__dict__.setdefault("items", {}):
        store.items[key] = build()
    return store.items[key]


def text_digest(text: Column) -> Column:
    """The MD5 of a text as it is; null is empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def folded_digest(text: Column) -> Column:
    """The SHA-256 of a text with A-Z lower-cased; null is empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)


def survivors(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The rows of docs that decisions (id_col, kept boolean, text_digest or text_sha256; a row for each of docs) keep.

    A row is known by its id, null included, and its text, so of texts repeated under one id each is decided by
    itself. Of rows alike in both, of which one is kept, one stays. Decisions without a digest know a row by its id
    alone; a null id then names no row, and such rows stay.
    """
    digests = {"text_digest": text_digest, "text_sha256": folded_digest}
    key = next((c for c in digests if c in decisions.columns), None)
    digest = digests[key] if key else lambda text: F.lit("")
    if not key:
        decisions = decisions.where(F.col(id_col).isNotNull())
    by_row = decisions.groupBy(F.col(id_col).alias("__id"), (F.col(key) if key else F.lit("")).alias("__key")).agg(F.max("kept").alias("__some"), F.min("kept").alias("__all"))
    partly = materialise(by_row.where("not __all"), "dropped")
    gone, twice = partly.where("not __some").select("__id", "__key"), partly.where("__some").select("__id", "__key")

    def same(left: DataFrame) -> Column:
        return left[id_col].cast("long").eqNullSafe(F.col("__id")) & (digest(left[text_col]) == F.col("__key"))

    out = join_checked(docs, gone, same(docs), "left_anti", 80)
    if not twice.take(1):
        return out
    again = join_checked(out, twice, same(out), "left_semi", 80)
    again = again.withColumn("__key", digest(again[text_col])).dropDuplicates([id_col, "__key"]).drop("__key")
    return join_checked(out, twice, same(out), "left_anti", 80).unionByName(again)


def arrow_map(fn: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema):
    """A mapInArrow function that turns each batch into the columns that fn returns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


# --- word hashing -------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""

    def build(size: int):
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return tuple(out)

    size = 1 << max(16, (n - 1).bit_length())
    return process_cache(("powers", size), lambda: build(size))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of data, which holds words with one space between them."""
    if not data:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(buf)]))
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words; of all words where there are fewer (none for no words)."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    w = words.astype(np.uint64)
    out = np.full(n, k, np.uint64)
    for t in range(k):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + w[t : t + n]
    return mix(out)


def normal_words(text: str | None) -> bytes:
    """Lower-cased words of text, one space between them, in UTF-8; null is empty."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")
