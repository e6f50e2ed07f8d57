"""Document quality by Bradley-Terry ranking.

A document's worth is a weighted sum of features of its text; the chance that one document is preferred to another
is the logistic function of the difference of their worths. The weights are learned from preference pairs (one
document labelled good, one labelled bad). Documents are then judged by where their worth stands among the worths
of the labelled ones: the threshold is a quantile of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, materialise

#: Bounds of what is collected to fit: labelled rows, and preference pairs drawn from them.
SAMPLE_ROWS, PAIRS = 12_000, 40_000
THRESHOLD = 0.7

FEATURES = (
    "log_words", "mean_word", "long_words", "upper", "digits", "symbols", "pipes", "marks", "stops", "distinct",
    "top_word", "line_words", "repeat_lines", "repeat_runs", "non_ascii", "one_letter",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[46, 44]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[35, 36, 37, 38, 42, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = True


def features(text: str | None) -> list[float]:
    """The features of one text; an empty one has zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total = max(1, int(bytes_.sum()) - int(bytes_[[32, 10, 9, 13]].sum()))
    upper, lower = int(bytes_[_UPPER].sum()), int(bytes_[_LOWER].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    runs = sum(map(str.__eq__, words, words[1:]))
    lengths = list(map(len, words))
    return [
        min(math.log1p(n), 6.0),
        min(sum(lengths) / n, 20.0),
        sum(x > 14 for x in counts.values()) / n,
        upper / max(1, upper + lower),
        int(bytes_[_DIGIT].sum()) / total,
        math.sqrt(int(bytes_[_SYMBOL].sum()) / total),
        math.sqrt(int(bytes_[124]) / total),
        math.sqrt((int(bytes_[33]) + int(bytes_[63])) / total),
        int(bytes_[_STOP].sum()) / total,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        runs / n,
        int(bytes_[128:].sum()) / total,
        lengths.count(1) / n,
    ]


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features, and how worth becomes a score."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float  # the quantile of worth that separates accepted from rejected
    width: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.mean)) / np.array(self.scale)).clip(-8, 8) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Increasing in worth, from 0 to 1, and THRESHOLD at the cut."""
        z = (self.worth(x) - self.cut) / self.width + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Bradley-Terry weights from rows x labelled y (1 good, 0 bad); all zero where a label is missing."""
    mean, scale = x.mean(0) if len(x) else np.zeros(len(FEATURES)), x.std(0) + 1e-6 if len(x) else np.ones(len(FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(tuple(mean), tuple(scale), (0.0,) * len(FEATURES), -1.0 if len(good) or not len(bad) else 1.0, 1.0)
    z = ((x - mean) / scale).clip(-8, 8)
    draw = np.random.default_rng(seed)
    diff = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps on the mean of log(1 + exp(-w . diff))
        p = 1 / (1 + np.exp((diff @ w).clip(-30, 30)))
        gradient = ridge * w - diff.T @ p / pairs
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    share = len(bad) / len(y)
    # The share of bad labels is the quantile; the middle of the gap around it keeps clear cases clear.
    low, high = np.quantile(s, max(0.0, share - 0.005)), np.quantile(s, min(1.0, share + 0.005))
    return Ranker(tuple(mean), tuple(scale), tuple(w), float(low + high) / 2, float(max(s.std() / 3, 1e-6)))


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, folds: int = 4, held_out: int = 2) -> Ranker:
    """Fit on at most ``rows`` labelled documents, those of the least hash whose fold isn't held out.

    An id that repeats in docs counts once, by the least features of its texts.
    """
    train = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, folds) != held_out)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    some = materialise(train.orderBy(F.xxhash64("__id"), "__id").limit(rows), "labels")
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(some), "__id")
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])
    measured = found.select(F.col("__text").alias("text"), F.col("__y").cast("int").alias("y"), F.xxhash64("__id").alias("id")).mapInArrow(
        arrow_map(lambda b: {"id": b.column("id"), "y": b.column("y"), "x": [features(t.as_py()) for t in b.column("text")]}, schema), "id long, y int, x array<double>"
    )
    got = measured.groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("y", "x").collect()  # a row an id
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got]))


def fold(id_col: str, folds: int = 4):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def scored(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of each row. Only the text enters the score.

    Null counts as empty, and an empty text has the score of a text whose features are zero; a null id is in no
    fold, so not held out. Repeated rows are scored each; other columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batch: pa.RecordBatch) -> dict:
        score = model.score(np.array([features(t.as_py()) for t in batch.column("text")]))
        return {"id": batch.column("id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(arrow_map(run, schema), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            score = model.score(np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, schema)
