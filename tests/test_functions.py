import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import bits, names, pixels, vectors
from lumenframe.operators.decisions import manifest, staged_names
from lumenframe.sources import exif


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_hamming(spark):
    pairs = [(0, 0, 0), (0, -1, 64), (0b1011, 0b0010, 2), (-(1 << 63), 0, 1)]
    got = one(spark, *[bits.hamming(F.lit(a).cast("long"), F.lit(b).cast("long")).alias(str(i)) for i, (a, b, _) in enumerate(pairs)])
    assert got == tuple(d for *_, d in pairs)


def test_bands_cover_all_bits(spark):
    for n in (1, 5, 9, 64):
        value = 0x8123_4567_89AB_CDEF
        got = one(spark, *[bits.band(F.lit(value - (1 << 64)).cast("long"), *b).alias(str(i)) for i, b in enumerate(bits.band_bounds(n))])
        whole = sum((v % (1 << 64)) << lo for v, (lo, _) in zip(got, bits.band_bounds(n)))
        assert whole == value


def test_exif_seconds(spark):
    cases = {"1970:01:01 00:00:00": 0, "1969:12:31 23:59:59": -1, "2024:02:29 12:00:00": 1709208000, "2019:07:15 14:30:05": 1563201005, "": None, "0000:00:00 00:00:00": None, "2019:13:40 99:99:99": None, "2019:02:31 00:00:60": 1551571260, "2019:01:01 -1:00:00": 1546297200, "2019-01-01 00:00:00": None}
    df = spark.createDataFrame(list(cases.items()), "s string, want long")
    for r in df.select("s", "want", names.exif_seconds(F.col("s")).alias("got")).collect():
        assert r.got == r.want, r.s


def test_camera_and_paths(spark):
    cam = lambda a, b: one(spark, names.camera_label(F.lit(a).cast("string"), F.lit(b).cast("string")))[0]
    assert cam("Canon", "Canon EOS R5") == "Canon EOS R5" and cam("Apple\0", " iPhone ") == "Apple iPhone"
    assert cam(None, "X") == "X" and cam("Nikon", "") == "Nikon" and cam(" ", None) is None
    ext = lambda p: one(spark, names.has_extension(F.lit(p)))[0]
    assert ext("/a/b.JPG") and not ext("/a/.jpg") and not ext("/a.jpg/b") and not ext("/a/b.txt")
    assert one(spark, names.under(F.lit("/a/b/c"), "/a/b/"), names.under(F.lit("/a/bc"), "/a/b")) == (True, False)
    human = lambda n: one(spark, names.human_bytes(F.lit(n).cast("long")))[0]
    assert [human(n) for n in (999, 1000, 1_500_000, 2 * 10**9, 3 * 10**15)] == ["999 B", "1.0 KB", "1.5 MB", "2.0 GB", "3000.0 TB"]
    h = lambda t: one(spark, bits.valid_hash(F.lit(t)))[0]
    assert [h(t) for t in ("C4" * 32, "zz" * 32, "c4", "c4" * 32 + "\n", "c4" * 32 + "\n\n", "zz" + "c4" * 32, "z" + "c4" * 32, "+4" + "c4" * 31)] == ["c4" * 32, None, None, "c4" * 32, "c4" * 32, "c4" * 32, None, "04" + "c4" * 31]


def test_bytes_are_rounded_by_their_exact_value(spark):
    sizes = [1250, 1350, 1450, 1750, 9950, 9_949, 999_949, 999_950, 1_250_000, 2_450_000_000, 8 * 899_999**2 + 3, 8 * 9_000_000**2 + 3, 2**62]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", names.human_bytes(F.col("n")).alias("t"), names.human_bytes(F.col("n"), names.UNITS[:4]).alias("g")).collect()
    for r in rows:
        for text, units in ((r.t, names.UNITS), (r.g, names.UNITS[:4])):
            power = max(i for i in range(len(units)) if r.n >= 1000**i)
            assert text == f"{r.n / 1000.0**power:.1f} {units[power]}"
    assert rows[10].g == "6480.0 GB"


def test_human_bytes_equals_sql_on_large_keys(spark, tmp_path):
    from oracle import same

    from lumenframe.plans.queries import ORACLE_SQL, QUERIES

    keys = [0, 11, 12, 353, 354, 353_553, 353_554, 899_999, 9_000_000, 1_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    same(QUERIES["human_bytes"](spark, str(tmp_path)), con, ORACLE_SQL["human_bytes"])


def test_verdicts(spark):
    v = lambda s, n=3: one(spark, names.verdict(F.lit(s), F.lit(n)).alias("v"))[0]
    assert v('{"keeper_index": 2, "reason": "in focus", "more": 1}').keeper_index == 2
    assert v(' \n```json\n{"keeper_index": 0, "reason": "eyes"}\n```\n').keeper_index == 0 and v('```{"keeper_index": 1, "reason": ""}```').reason == ""
    for bad in ('Sure: {"keeper_index": 2, "reason": "y"}', '{"keeper_index": 2}', '{"keeper_index": 3, "reason": "y"}', '{"keeper_index": -1, "reason": "y"}', "no", "", '{"keeper_index": 1, "reason": null}', '{"keeper_index": "1", "reason": "y"}', '{"keeper_index": 1, "reason": 4}', '{"keeper_index": 1, "reason": "y"} ok', '[{"keeper_index": 1, "reason": "y"}]'):
        assert v(bad) is None, bad


def test_staged_names():
    assert staged_names(["/r/sea.png", "/s/sea.png", "/t/u/sea.png"]) == ["sea.png", "sea (2).png", "sea (3).png"]
    assert staged_names(["/a/x (2).jpg", "/a/x.jpg", "/b/x.jpg", "/c/noext", "/d/noext"]) == ["x (2).jpg", "x.jpg", "x (3).jpg", "noext", "noext (2)"]
    assert '"staged": "/s/a.jpg"' in manifest(["/q/a.jpg"], "/s/")


def test_vectors(spark):
    a, b = (F.array(*map(F.lit, v)) for v in ([3.0, 4.0], [4.0, -3.0]))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.dot(a, b), vectors.cosine(a, a), vectors.cosine(a, zero)) == (0.0, pytest.approx(1.0), 0.0)
    assert one(spark, vectors.normalised(a).alias("n"), vectors.normalised(zero).alias("z")) == ([0.6, 0.8], [0.0, 0.0])
    weights, bias = vectors.read_head(struct.pack("<513f", 0.5, -1.0, *[0.0] * 510, 2.0))
    score = lambda v: one(spark, vectors.aesthetic_score(F.array(*map(F.lit, v)), weights, bias))[0]
    assert score([1.0, 0.0]) == pytest.approx(1.5 / 9) and score([0.0, 5.0]) == 0.0
    with pytest.raises(ValueError):
        vectors.read_head(b"123")


def picture(w, h, vertical=False, shift=0):
    y, x = np.mgrid[0:h, 0:w]
    g = (y if vertical else x) * 255.0 / ((h if vertical else w) - 1)
    disc = (x - 0.37 * w) ** 2 + (y - 0.41 * h) ** 2 < (0.25 * min(w, h)) ** 2
    g = g + 40 * np.sin(5.1 * x / w + 2.3 * y / h) * np.cos(7.7 * y / h)
    rgb = np.stack([np.where(disc, 255 - g, g)] * 3, -1).clip(0, 255) * 0.8 + shift
    return rgb.clip(0, 255).astype(np.uint8)


def test_hashes_survive_scaling_and_tell_pictures_apart():
    a, small, bright, other = picture(320, 200), picture(160, 100), picture(320, 200, shift=15), picture(320, 200, True)
    far = lambda f, x, y: ((f(x) ^ f(y)) & ((1 << 64) - 1)).bit_count()
    for f in (pixels.dhash, pixels.phash):
        assert far(f, a, a) == 0 and far(f, a, small) <= 8 and far(f, a, bright) <= 8 and far(f, a, other) > 10


def test_sharpness_exposure_thumbnails():
    noise = np.random.default_rng(0).integers(0, 255, (120, 160, 3)).astype(np.uint8)
    blurred = pixels.scaled(pixels.scaled(noise, 30, 40), 120, 160).astype(np.uint8)
    assert pixels.sharpness(noise) > 4 * pixels.sharpness(blurred) and pixels.sharpness(noise[:2]) == 0.0
    assert pixels.exposure(np.zeros((9, 9, 3), np.uint8)) == 0.0 and pixels.exposure(np.full((9, 9, 3), 128, np.uint8)) == 1.0
    assert pixels.thumbnail(np.zeros((768, 1024, 3), np.uint8)).shape == (192, 256, 3)
    assert pixels.thumbnail(np.zeros((80, 100, 3), np.uint8)).shape == (80, 100, 3)
    assert pixels.model_input(picture(300, 260)).shape == (3, 224, 224)


def jpeg_with_exif():
    make, model, taken = b"Apple\0", b"iPhone 15 Pro\0", b"2019:07:15 14:30:05\0"
    head = b"II*\0" + struct.pack("<I", 8)
    at = 8 + 2 + 4 * 12 + 4
    sub = at + len(make) + len(model)
    entries = struct.pack("<H", 4) + struct.pack("<HHII", 0x010F, 2, len(make), at) + struct.pack("<HHII", 0x0110, 2, len(model), at + len(make)) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8769, 4, 1, sub) + struct.pack("<I", 0)
    tail = make + model + struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(taken), sub + 18) + struct.pack("<I", 0) + taken
    block = b"Exif\0\0" + head + entries + tail
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"


def test_exif_reader():
    assert exif.read(jpeg_with_exif()) == {"make": "Apple", "model": "iPhone 15 Pro", "taken": "2019:07:15 14:30:05", "orientation": 6}
    for bad in (b"", b"\xab" * 100, jpeg_with_exif()[:40], b"II*\0\xff\xff\xff\xff"):
        assert set(exif.read(bad).values()) == {None}
