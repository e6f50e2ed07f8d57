"""Streaming forms: events and bursts as frames arrive, and a catalog kept up with found files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog
from ..sources.store import Store


def event_stream(rows: DataFrame, gap: int, late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """(start, end, count) of each event of a stream (ts, ...): session windows that close after a gap.

    Rows later than the watermark are dropped by Spark. end is the last time of the event. Without a key the whole
    stream is one session; with one, events are per key.
    """
    window = F.session_window("ts", f"{gap} seconds")
    # Spark wants a key beside a session window; without one all rows have the same.
    keys = [window, (F.year("ts") * 0).alias("all") if key is None else F.col(key)]
    out = rows.withWatermark("ts", late).groupBy(*keys).agg(F.count("*").alias("count"), F.max("ts").alias("end"))
    return out.select(*([key] if key else []), F.col("session_window.start").alias("start"), "end", "count")


def burst_stream(frames: DataFrame, gap: int, late: str = "1 minute") -> DataFrame:
    """(camera, start, end, members) of each burst of two or more of a stream (camera, ts), when it is over.

    A camera's state is the burst under way. It ends with the first frame more than gap later, or when the
    watermark has passed it by the gap.
    """
    out = "camera string, start timestamp, end timestamp, members long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        done = []
        if state.hasTimedOut:
            if n >= 2:
                done.append((first, last, n))
            state.remove()
        else:
            times = sorted(int(t.value // 1000) for b in batches for t in b["ts"])
            for t in times:
                if last is not None and t - last > gap * 1_000_000:
                    if n >= 2:
                        done.append((first, last, n))
                    first, n = None, 0
                first = t if first is None else min(first, t)
                last = t if last is None or n == 0 else max(last, t)
                n += 1
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(last // 1000 + gap * 1000, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame({"camera": [key[0]] * len(done), "start": [pd.Timestamp(d[0], unit="us") for d in done], "end": [pd.Timestamp(d[1], unit="us") for d in done], "members": [d[2] for d in done]})

    used = frames.where("camera is not null and ts is not null").withWatermark("ts", late)
    return used.groupBy("camera").applyInPandasWithState(step, out, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_up(store: Store, root: str):
    """A foreachBatch function that reconciles each micro-batch of found files (path, size, mtime) with the catalog.

    A batch holds files that were seen, not the whole folder, so none is taken to be missing.
    """

    def reconcile(batch: DataFrame, epoch: int) -> None:
        both = catalog.compared(store.table("files"), batch, root).withColumn("outcome", F.when(F.col("outcome") == "missing", "kept").otherwise(F.col("outcome")))
        store.put(
            files=catalog.reconciled(both, next_id(store)),
            images=catalog.without_changed(store.table("images"), both),
            embeddings=catalog.without_changed(store.table("embeddings"), both),
        )

    return reconcile


def next_id(store: Store) -> int:
    """A number above every file id."""
    return (store.table("files").agg(F.max("id")).first()[0] or 0) + 1
