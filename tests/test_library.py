import os
import shutil
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from test_functions import jpeg_with_exif, picture

from lumenframe.functions.pixels import png
from lumenframe.library import Library
from lumenframe.sources import images as pictures
from lumenframe.sources import store as stores
from lumenframe.sources.walk import found_below, listed, walk


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class MeanColour:
    """Images and words as the mean of three channels on the first axes."""

    def image(self, rgb):
        return [*rgb.reshape(-1, 3).mean(0).tolist(), 0.0]

    def text(self, text):
        return [float(text == c) for c in ("red", "green", "blue")] + [float(text not in ("red", "green", "blue"))]


def solid(r, g, b):
    return np.full((64, 64, 3), (r, g, b), np.uint8)


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "lib"
    (d / "sub" / ".cache").mkdir(parents=True)
    (d / "_odd").mkdir()
    for name, data in {"a.png": png(picture(320, 200)), "sub/b.PNG": png(picture(320, 200)), "small.png": png(picture(160, 100)), "red.png": png(solid(220, 20, 20)), "blue.png": png(solid(20, 20, 220)), "_odd/blue.png": png(solid(20, 20, 220)),
                       "exif.jpg": jpeg_with_exif(), "broken.jpg": b"\xab" * 15000, "notes.txt": b"x", ".hidden.jpg": b"x", "sub/.cache/t.jpg": b"x"}.items():
        (d / name).write_bytes(data)
        os.utime(d / name, (1_000_000_000, 1_000_000_000))
    os.symlink(d / "a.png", d / "link.png")
    return str(d)


def test_walk(spark, root):
    want = sorted(os.path.join(root, n) for n in ("a.png", "sub/b.PNG", "small.png", "red.png", "blue.png", "_odd/blue.png", "exif.jpg", "broken.jpg"))
    assert sorted(p for p, *_ in found_below(root)) == want
    rows = walk(spark, root).collect()
    assert sorted(r.path for r in rows) == want and {r.mtime for r in rows} == {1_000_000_000}
    assert [r.path for r in walk(spark, root, ("txt",)).collect()] == [os.path.join(root, "notes.txt")]
    with pytest.raises(Exception):
        walk(spark, root + "/none").collect()
    assert {r.path.removeprefix("file:") for r in listed(spark, root).collect()} >= {os.path.join(root, n) for n in ("a.png", "sub/b.PNG", "exif.jpg")}


def test_prehash_sees_the_first_bytes_only(spark, tmp_path):
    for name, data in {"a": b"\1" * 8192, "b": b"\1" * 8191 + b"\2", "c": b"\2" + b"\1" * 8191}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path[-1]: r for r in pictures.hashed(pictures.contents(spark, str(tmp_path))).collect()}
    assert rows["a"].prehash == rows["b"].prehash != rows["c"].prehash
    assert len({r.content_hash for r in rows.values()}) == 3


def test_whole_engine(spark, root, tmp_path):
    lib = Library(spark, str(tmp_path / "db"))
    assert not lib.has_models()
    with pytest.raises(RuntimeError):
        lib.search("red")
    lib.attach_models(MeanColour())
    got = lib.scan(root)
    assert (got["added"], got["found"], got["errors"], got["hashed"], got["analyzed"]) == (8, 8, 0, 4, 8)
    assert [r.n for r in lib.dupes().collect()] == [2, 2]
    facts = {os.path.basename(r.path): r for r in lib.grid_items().collect()}
    assert facts["exif.jpg"].captured_at == 1563201005 and facts["broken.jpg"].width is None and facts["a.png"].width == 320
    assert os.path.basename(lib.search("red", 1).first().path) == "red.png" and os.path.basename(lib.search("blue", 1).first().path) == "blue.png"

    clusters = lib.cluster_near().collect()
    assert {frozenset(os.path.basename(f.path) for f in c.files) for c in clusters} >= {frozenset({"a.png", "small.png"})} or any({"a.png", "small.png"} <= {os.path.basename(f.path) for f in c.files} for c in clusters)
    assert all(c.keeper_file_id is not None for c in clusters)
    assert lib.cluster_bursts().count() == 0 and lib.clusters("near").count() == len(clusters)
    assert lib.best_of().count() == 1
    assert lib.images_needing_faces().count() == 5
    lib.store_face_facts(lib._t("images").selectExpr("file_id", "0 as face_count", "0.0D as eyes_open_ratio"))
    assert lib.images_needing_faces().count() == 0

    again = lib.scan(root)
    assert (again["unchanged"], again["added"], again["analyzed"]) == (8, 0, 0)
    os.remove(os.path.join(root, "red.png"))
    with open(os.path.join(root, "exif.jpg"), "ab") as f:
        f.write(b"1")
    third = lib.scan(root)
    assert (third["missing"], third["updated"]) == (1, 1)
    assert "red.png" not in {os.path.basename(r.path) for r in lib.search("red", 9).collect()}
    assert lib.scan(root)["missing"] == 0

    groups = lib.dupes().collect()
    lib.accept_defaults()
    copies = lib.files_for_hashes([g.content_hash for g in groups]).collect()
    assert [r.path for r in lib.rejects().collect()] == sorted({f.path for r in copies for f in r.files} - {g.keeper_path for g in groups})
    lib.decide(groups[0].content_hash, "reject", 1)
    assert lib.rejects().count() == 3
    lib.undo(groups[0].content_hash)
    assert lib.rejects().count() == 2 and '"original"' in lib.staging_manifest("/staged")
    assert lib.stats().first().missing == 1
    reopened = Library(spark, str(tmp_path / "db"))
    assert reopened.dupes().count() == 2


def test_store_migrates_once_and_refuses_the_future(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    s = stores.Store(spark, at)
    s.put(keepers=spark.createDataFrame([(1, 2)], "cluster_id long, keeper_file_id long"))
    other = stores.Store(spark, at)
    s.put(keepers=spark.createDataFrame([(1, 2)], "cluster_id long, keeper_file_id long"))
    with pytest.raises(OSError):
        other.put(keepers=spark.createDataFrame([(9, 9)], "cluster_id long, keeper_file_id long"))
    monkeypatch.setattr(stores, "MIGRATIONS", [lambda t: {"keepers": t["keepers"].selectExpr("cluster_id + 1 as cluster_id", "keeper_file_id")}])
    for _ in range(2):
        newer = stores.Store(spark, at)
        assert newer.state["schema"] == 2 and newer.table("keepers").first().cluster_id == 2
    monkeypatch.setattr(stores, "MIGRATIONS", [])
    with pytest.raises(ValueError):
        stores.Store(spark, at)
    shutil.rmtree(at)


def test_command_line(spark, root, tmp_path, capsys):
    from lumenframe.__main__ import main, parser

    main(["--db", str(tmp_path / "db"), "scan", root])
    main(["--db", str(tmp_path / "db"), "dupes"])
    assert "added: 8" in capsys.readouterr().out
    assert parser().parse_args(["--db", "x", "clusters", "--dhash", "99"]).dhash == 64
