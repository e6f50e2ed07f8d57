from lumenframe.operators import dedup

SCHEMA = "id long, path string, size long, mtime long, content_hash string, prehash string, status string"


def files(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_groups_and_order(spark):
    rows = [(i, f"/a/{i}.jpg", 8192, 5, "h1", None, "hashed") for i in range(3)] + [(3, "/b/x.jpg", 1024, 5, "h2", None, "hashed"), (4, "/b/y.jpg", 1024, 5, "h2", None, "hashed"), (5, "/u.jpg", 500, 5, "h3", None, "hashed")]
    got = dedup.ordered_groups(files(spark, rows)).collect()
    assert [(r.content_hash, r.n, r.reclaimable, r.keeper_path) for r in got] == [("h1", 3, 16384, "/a/0.jpg"), ("h2", 2, 1024, "/b/x.jpg")]
    total = dedup.duplicate_totals(files(spark, rows)).first()
    assert (total.groups, total.redundant, total.reclaimable) == (2, 3, 17408)


def test_keeper_is_oldest_then_shortest_in_bytes_then_first(spark):
    rows = [(1, "/é.jpg", 1, 5, "h", None, "hashed"), (2, "/zz.jpg", 1, 5, "h", None, "hashed"), (3, "/zzz.jpg", 1, 5, "h", None, "hashed"), (4, "/long-but-old.jpg", 1, 4, "g", None, "hashed"), (5, "/a.jpg", 1, 5, "g", None, "hashed")]
    keep = {r.content_hash: r.keeper_path for r in dedup.duplicate_groups(files(spark, rows)).collect()}
    assert keep["g"] == "/long-but-old.jpg"
    assert keep["h"] == min(["/é.jpg", "/zz.jpg"], key=lambda p: (len(p.encode()), p.encode()))
    ranks = {r.path: r["rank"] for r in dedup.duplicate_members(files(spark, rows)).where("content_hash = 'h'").collect()}
    assert sorted(ranks.values()) == [1, 2, 3] and ranks["/zzz.jpg"] == 3


def test_empty_files_are_a_group_and_missing_ones_are_not(spark):
    rows = [(1, "/a", 0, 1, "e", None, "hashed"), (2, "/b", 0, 1, "e", None, "hashed"), (3, "/c", 9, 1, "m", None, "missing"), (4, "/d", 9, 1, "m", None, "hashed"), (5, "/n", 9, 1, None, None, "pending")]
    got = dedup.duplicate_groups(files(spark, rows)).collect()
    assert [(r.content_hash, r.reclaimable) for r in got] == [("e", 0)]
    assert {r.id for r in dedup.size_candidates(files(spark, rows)).collect()} == {1, 2, 4, 5}
    assert dedup.duplicate_groups(files(spark, [])).collect() == []


def test_prefix_candidates(spark):
    rows = [
        (1, "/a", 10, 1, None, "p", "pending"), (2, "/b", 10, 1, "h", "p", "hashed"), (3, "/c", 10, 1, None, "q", "pending"),
        (4, "/d", 20, 1, "x", "r", "hashed"), (5, "/e", 20, 1, "x", "r", "hashed"), (6, "/f", 30, 1, None, "s", "pending"),
    ]
    assert {r.id for r in dedup.prefix_candidates(files(spark, rows)).collect()} == {1}


def test_nested(spark):
    rows = [(1, "/bb", 3, 2, "h", None, "hashed"), (2, "/a", 3, 2, "h", None, "hashed")]
    assert [f.path for f in dedup.nested_groups(files(spark, rows)).first().files] == ["/a", "/bb"]
