import math
import random

import pytest

from lumenframe.operators import ordered, sessions
from pyspark.sql import functions as F


def test_gap_is_inclusive_and_single_rows_stay(spark):
    df = spark.createDataFrame([(3, 11000), (1, 10000), (2, 10500), (4, 25000), (5, 25400), (6, 60000), (7, None)], "id long, at long")
    got = {}
    for r in sessions.events(df, 7200).collect():
        got.setdefault(r.event, set()).add(r.id)
    assert got == {1: {1, 2, 3}, 2: {4, 5}, 3: {6}}
    edge = spark.createDataFrame([(1, 0), (2, 7200), (3, 14401)], "id long, at long")
    assert [r["count"] for r in sessions.event_summary(edge, 7200).orderBy("event").collect()] == [2, 1]


@pytest.mark.parametrize("width", [1, 7, 50, 10**6])
def test_runs_don_t_depend_on_slices(spark, width):
    r = random.Random(width)
    rows = [(i, r.choice(["a", "b", None]), r.randrange(300)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, at long")
    out = ordered.runs(df, ["k"], "at", "id", [], lambda p, c: c["at"] - p["at"] > 4, width)
    got = {x.id: x.run for x in out.collect()}
    for key in ("a", "b", None):
        own = sorted((at, i) for i, k, at in rows if k == key)
        run, last = 0, None
        for at, i in own:
            run += last is None or at - last > 4
            last = at
            assert got[i] == run


def test_ranked_within_a_frequent_key(spark):
    rows = [(i, "hot" if i % 10 else "rare", (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v long").repartition(8)
    out = ordered.ranked(df, "k", [F.desc("v"), F.col("id")])
    for key in ("hot", "rare"):
        want = [i for i, k, v in sorted(rows, key=lambda x: (-x[2], x[0])) if k == key]
        assert [r.id for r in out.where(F.col("k") == key).orderBy("rank").collect()] == want


def test_best_of_takes_the_last_of_equals_and_puts_missing_last(spark):
    rows = [(1, 0, 0.5, None, None), (2, 10, 0.5, None, None), (3, 10, 0.5, None, None), (4, 20, None, 9.0, 9.0), (5, 90000, None, None, None)]
    df = spark.createDataFrame(rows, "id long, at long, quality double, aesthetic double, sharpness double")
    got = sessions.best_of(df, 7200).orderBy("event").collect()
    assert [(r.start, r.end, r["count"], r.id) for r in got] == [(0, 20, 4, 3), (90000, 90000, 1, 5)]


def lean(x):
    return [math.cos(x), math.sin(x)]


def burst(spark, rows, gap=3, cos=0.92):
    df = spark.createDataFrame(rows, "id long, camera string, at long, vector array<double>")
    out = {}
    for r in sessions.bursts(df, gap, cos).collect():
        out.setdefault((r.camera, r.burst), set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_bursts(spark):
    chain = [(i, "c", 2 * i, lean(0.1 * i)) for i in range(1, 5)]
    assert burst(spark, chain) == [[1, 2, 3, 4]]
    assert burst(spark, [(1, "c", 0, lean(0)), (2, "c", 2, lean(0)), (3, "c", 10, lean(0)), (4, "c", 12, lean(0))]) == [[1, 2], [3, 4]]
    assert burst(spark, [(1, "a", 0, lean(0)), (2, "b", 1, lean(0)), (3, "a", 2, lean(0)), (4, "b", 3, lean(0))]) == [[1, 3], [2, 4]]
    orthogonal = [(1, "c", 0, [1.0, 0.0]), (2, "c", 1, [0.0, 1.0])]
    assert burst(spark, orthogonal) == [] and burst(spark, orthogonal, cos=-1.0) == [[1, 2]]
    assert burst(spark, [(1, None, 0, lean(0)), (2, "c", None, lean(0)), (3, "c", 1, None), (4, "c", 2, lean(0))]) == []
    # One unlike frame between two alike ones splits the run.
    assert burst(spark, [(1, "c", 0, [1.0, 0.0]), (2, "c", 1, [0.0, 1.0]), (3, "c", 2, [1.0, 0.0])]) == []
