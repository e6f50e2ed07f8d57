"""Vector search: exact top-k by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .dedup import live


def top_k(embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """(file_id, score) of the k vectors most alike to query, of equals the least id.

    A scan that keeps k rows a task; the query is a literal.
    """
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    return embeddings.select("file_id", score.alias("score")).orderBy(F.desc("score"), "file_id").limit(max(k, 1))


def search(files: DataFrame, images: DataFrame, embeddings: DataFrame, query: list[float], k: int, since: int | None = None, until: int | None = None, camera: str | None = None) -> DataFrame:
    """(file_id, path, score): top_k among live files that have an images row, of a time span and camera if named.

    Filters come before the search, so it never returns fewer than there are.
    """
    own = images
    for test in ([F.col("captured_at") >= since] if since is not None else []) + ([F.col("captured_at") < until] if until is not None else []) + ([F.col("camera") == camera] if camera is not None else []):
        own = own.where(test)
    allowed = live(files).select(F.col("id").alias("file_id"), "path").join(own.select("file_id"), "file_id", "left_semi")
    found = top_k(embeddings.join(allowed.select("file_id"), "file_id", "left_semi"), query, k)
    return allowed.join(F.broadcast(found), "file_id").select("file_id", "path", "score").orderBy(F.desc("score"), "file_id")  # found has k rows
