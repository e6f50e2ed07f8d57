"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most e word edits leaves one of e + 1 pieces of it untouched. So each item is
split into e + 1 pieces, exact hits of pieces are found by hashes of runs of words, and the stretch of text around
a hit is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import find, search
from .shared import arrow_map, process_cache, windows, word_hashes

SIMILARITY = 0.8
#: Benchmark text that is sent to executors at once; more of it takes more passes over the documents.
BLOCK_BYTES = 4 << 20
_MARKS = b""".,;:!?"'`()[]{}<>"""


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of text without punctuation."""
    data = " ".join((text or "").lower().split()).encode("utf-8", "replace").translate(None, _MARKS)
    return word_hashes(b" ".join(data.split()))


class Pieces:
    """The pieces of a block of items, by their number of words and hash."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.items = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for number, text in items:
            words = plain_words(text)
            if not len(words):
                continue
            budget = int((1 - similarity) * len(words) + 1e-9)
            at = len(self.items)
            self.items.append((number, words.tolist(), budget))
            ends = [len(words) * i // (budget + 1) for i in range(budget + 2)]
            for start, end in zip(ends, ends[1:]):
                piece = int(windows(words[start:end], end - start)[0])
                found.setdefault(end - start, []).append((piece, at, start))
        self.by_size = []
        for size, pieces in sorted(found.items()):
            pieces.sort()
            hashes = np.array([p[0] for p in pieces], np.uint64)
            marks = np.zeros(1 << 20, bool)
            marks[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_size.append((size, hashes, pieces, marks))

    def hits(self, words: np.ndarray) -> dict[int, list[int]]:
        """For each item, where it would start in the text going by the pieces that were hit."""
        out: dict[int, list[int]] = {}
        for size, hashes, pieces, marks in self.by_size:
            if len(words) < size:
                continue
            runs = windows(words, size)
            for at in np.flatnonzero(marks[(runs >> np.uint64(44)).astype(np.int64)]).tolist():
                x = runs[at]
                for i in range(int(np.searchsorted(hashes, x)), len(hashes)):
                    if hashes[i] != x:
                        break
                    out.setdefault(pieces[i][1], []).append(at - pieces[i][2])
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, words of the item, start, end) of each item in text: its closest run of words."""
        words = plain_words(text)
        out = []
        listed: list[int] | None = None
        for at, starts in self.hits(words).items():
            number, item, budget = self.items[at]
            listed = words.tolist() if listed is None else listed
            best = None
            starts = sorted(set(starts))
            i = 0
            while i < len(starts):
                j = i
                while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * budget + 1 and starts[j + 1] - starts[i] <= len(item):
                    j += 1
                lo, hi = max(0, starts[i] - budget), starts[j] + len(item) + budget
                part = listed[lo:hi]
                if search(item, part)[0] <= budget:
                    distance, start, end = find(item, part)
                    if best is None or distance < best[0]:
                        best = (distance, lo + start, lo + end)
                i = j + 1
            if best:
                out.append((number, best[0], len(item), best[1], best[2]))
        return sorted(out)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in runs of bounded size, read through the driver a run at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t")
    some, size = [], 0
    for row in rows.toLocalIterator():
        some.append((row.i, row.t))
        size += 64 + len(row.t)
        if size >= block_bytes:
            yield some
            some, size = [], 0
    yield some


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that occurs in it: (id_col, item_col, distance, item_words, start, end).

    An item of m words occurs where a run of words is within ``(1 - similarity) * m`` word edits; case, white space
    and punctuation don't count. start and end are word positions of the closest run, the first of equals. Null and
    empty texts match nothing, nor do items without words; items of fewer than five words must occur exactly.
    Repeated documents and items give repeated rows; other columns are not read; empty tables give an empty result.
    """
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), *((n, pa.int32()) for n in ("distance", "item_words", "start", "end"))])
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(items)
        part = rows.mapInArrow(arrow_map(_matcher(sent, similarity, schema), schema), "id long, item long, distance int, item_words int, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _matcher(sent, similarity: float, schema: pa.Schema):
    name = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        pieces = process_cache(("pieces", name), lambda: Pieces(sent.value, similarity))
        ids = batch.column("id").to_pylist()
        found = [(ids[i], *m) for i, text in enumerate(batch.column("text")) for m in pieces.matches(text.as_py())]
        return {f.name: [x[k] for x in found] for k, f in enumerate(schema)}

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no item occurs."""
    schema = docs.schema
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(_filter(sent, similarity, text_col), schema)
    return docs


def _filter(sent, similarity: float, text_col: str):
    name = uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            pieces = process_cache(("pieces", name), lambda: Pieces(sent.value, similarity))
            column = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([not pieces.matches(t.as_py()) for t in column], pa.bool_()))

    return run
