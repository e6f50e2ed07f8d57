"""Events by gaps in time, bursts by gap and likeness, and the best image of each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..scratch import materialise
from .ordered import DAY, runs

EVENT_GAP, BURST_GAP, BURST_COSINE = 7200, 3, 0.92


def event_of_times(times: DataFrame, gap: int = EVENT_GAP) -> DataFrame:
    """(at, event): the event number of each distinct time of times (at), from 1 on.

    An event goes on while the next time is at most gap later.
    """
    distinct = times.where("at is not null").select("at").distinct().withColumn("id", F.lit(0))
    return runs(distinct, [], "at", "id", [], lambda p, c: c["at"] - p["at"] > gap, max(DAY, gap)).select("at", F.col("run").alias("event"))


def events(rows: DataFrame, gap: int = EVENT_GAP) -> DataFrame:
    """rows (at, ...) with their event number; rows without a time are left out."""
    return rows.join(event_of_times(rows, gap), "at")


def event_summary(rows: DataFrame, gap: int = EVENT_GAP) -> DataFrame:
    """(event, start, end, count), in order of time."""
    return events(rows, gap).groupBy("event").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("count"))


def best_of(rows: DataFrame, gap: int = EVENT_GAP) -> DataFrame:
    """The best row of each event: (event, start, end, count, id).

    rows (id, at, quality, aesthetic, sharpness) are compared by quality, then aesthetic, then sharpness, a missing
    one below all; of equals the last in (at, id) is taken.
    """
    low = F.lit(float("-inf"))
    worth = F.struct(*[F.coalesce(F.col(c), low) for c in ("quality", "aesthetic", "sharpness")], "at", "id")
    out = events(rows, gap).groupBy("event").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("count"), F.max_by("id", worth).alias("id"))
    return out


def bursts(frames: DataFrame, gap: int = BURST_GAP, least_cosine: float | None = BURST_COSINE) -> DataFrame:
    """(camera, burst, id, members) of frames (id, camera, at, vector) taken in bursts of two or more.

    Per camera a burst goes on while the next frame is at most gap later and its vector at least so alike to the one
    just before. Frames that lack camera, time or vector are left out. Without least_cosine vectors aren't read.
    burst is the least id of the burst.
    """
    used = frames.where("camera is not null and at is not null")
    carry = []
    if least_cosine is not None:
        used, carry = used.where("vector is not null"), ["vector"]

    def breaks(p, c):
        late = c["at"] - p["at"] > gap
        return late if least_cosine is None else late | (cosine(p["vector"], c["vector"]) < least_cosine)

    numbered = runs(used.select("id", "camera", "at", *carry), ["camera"], "at", "id", carry, breaks, max(DAY, gap)).select("id", "camera", "run")
    numbered = materialise(numbered, "numbered")
    sizes = numbered.groupBy("camera", "run").agg(F.count("*").alias("members"), F.min("id").alias("burst")).where("members >= 2")
    return numbered.join(sizes, ["camera", "run"]).select("camera", "burst", "id", "members")
