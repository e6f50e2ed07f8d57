"""Contents of files: hashes, decoded images and what is measured on them, thumbnails, embeddings."""

from __future__ import annotations

import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch  # noqa: F401  (ships the package to workers)
from ..functions import pixels
from ..functions.names import camera_label, exif_seconds, thumb_path
from ..operators.dedup import PREFIX_BYTES
from . import exif


#: So many files at most are named to the image reader one by one.
MOST_NAMED = 10_000


class Embedder(Protocol):
    """What turns images and texts into vectors of one space; it travels to executors."""

    def image(self, rgb: np.ndarray) -> list[float]: ...

    def text(self, text: str) -> list[float]: ...


def contents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, content) of files; paths have no scheme."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def local_contents(files: DataFrame, most: int = -1) -> DataFrame:
    """(path, content) of files (path, ...) that every executor sees, also of names that Spark's listing hides.

    Of each file the first ``most`` bytes are read, all by default. A file that can't be read has no row.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open(path, "rb") as f:
                        data = f.read(most)
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(read, "path string, content binary")


def hashed(files: DataFrame) -> DataFrame:
    """(path, content_hash, prehash) of (path, content): SHA-256 of all, and of the first 4096 bytes."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.sha2(F.substring("content", 1, PREFIX_BYTES), 256).alias("prehash"))


def file_facts(files: DataFrame) -> DataFrame:
    """(path, content_hash, captured_at, camera, orientation) of (path, content); nulls where a file says nothing."""

    def read(batches):
        for batch in batches:
            got = [exif.read(c.as_py() or b"") for c in batch.column("content")]
            columns = [pa.array([g[n] for g in got], t) for n, t in (("make", pa.string()), ("model", pa.string()), ("taken", pa.string()), ("orientation", pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("content_hash"), *columns], names=["path", "content_hash", "make", "model", "taken", "orientation"])

    raw = files.select("path", F.sha2("content", 256).alias("content_hash"), "content").mapInArrow(read, "path string, content_hash string, make string, model string, taken string, orientation int")
    return raw.select("path", "content_hash", exif_seconds(F.col("taken")).alias("captured_at"), camera_label(F.col("make"), F.col("model")).alias("camera"), "orientation")


def decoded(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, width, height, channels, data) of the wanted images (path) below root, by Spark's decoder; nulls if it can't.

    Up to MOST_NAMED files are named to the reader; of more, all below root are listed and the others left out.
    Spark's listing passes over names that start with an underscore, so these count as undecodable.
    """
    named = [r.path for r in wanted.select("path").limit(MOST_NAMED + 1).collect()]
    hidden = re.escape(root.rstrip("/")) + r"/(?:.*/)?_"
    named = [p for p in named if not re.match(hidden, p)] if len(named) <= MOST_NAMED else None
    source = root if named is None else [re.sub(r"([\\*?{}\[\]])", r"\\\1", p) for p in named]
    if named == []:
        return spark.createDataFrame([], "path string, width int, height int, channels int, data binary")
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(source).select("image.*")
    good = F.col("height") > 0
    rows = rows.select(F.regexp_replace("origin", "^file:/+", "/").alias("path"), *[F.when(good, F.col(c)).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))])
    return rows if named is not None else rows.join(wanted.select("path"), "path", "left_semi")


def raster(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """The decoder's bytes, blue first, as RGB."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[..., 2::-1]


def _mapped(images: DataFrame, fields: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    """A row per image with the values that make returns for its raster, nulls where there is none."""

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in ("width", "height", "channels", "data")}
            got = []
            for i in range(batch.num_rows):
                data = columns["data"][i].as_py()
                got.append(make(raster(*(columns[c][i].as_py() for c in ("width", "height", "channels")), data)) if data else [None] * len(fields))
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([g[k] for g in got], t) for k, (_, t, _) in enumerate(fields)]], names=["path", *[f[0] for f in fields]])

    return images.select("path", "width", "height", "channels", "data").mapInArrow(run, "path string, " + ", ".join(f"{n} {s}" for n, _, s in fields))


def picture_facts(images: DataFrame) -> DataFrame:
    """(path, width, height, dhash, phash, sharpness, exposure_score, picture) of decoded images, each gone through once.

    picture is a PNG of at most 256 pixels a side.
    """
    fields = [("w", pa.int32(), "int"), ("h", pa.int32(), "int"), ("dhash", pa.int64(), "long"), ("phash", pa.int64(), "long"), ("sharpness", pa.float64(), "double"), ("exposure_score", pa.float64(), "double"), ("picture", pa.binary(), "binary")]
    found = _mapped(images, fields, lambda a: [a.shape[1], a.shape[0], pixels.dhash(a), pixels.phash(a), pixels.sharpness(a), pixels.exposure(a), pixels.png(pixels.thumbnail(a))])
    return found.withColumnsRenamed({"w": "width", "h": "height"})


def thumbnails(pictures: DataFrame, hashes: DataFrame, folder: str) -> DataFrame:
    """(content_hash, thumb_path, picture) once per content, of (path, picture) and hashes (path, content_hash)."""
    first = hashes.groupBy("content_hash").agg(F.min("path").alias("path"))
    return pictures.where("picture is not null").join(first, "path").select("content_hash", thumb_path(folder, F.col("content_hash")).alias("thumb_path"), "picture")


def write_thumbnails(thumbs: DataFrame, folder: str) -> None:
    """The thumbnails as a table below folder, by the first two digits of the hash; contents that are there already stay.

    A table instead of a file each: it goes to any store and doesn't burden it with small files.
    """
    spark = thumbs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        thumbs = thumbs.join(spark.read.schema("content_hash string").parquet(folder), "content_hash", "left_anti")
    thumbs.withColumn("shard", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(folder)


def embedded(images: DataFrame, embedder: Embedder) -> DataFrame:
    """(path, vector) of decoded images, vectors of length 1."""

    def make(a: np.ndarray) -> list:
        v = np.asarray(embedder.image(a), float)
        n = float(np.sqrt((v * v).sum()))
        return [(v / n if n > 0 else v).tolist()]

    return _mapped(images, [("vector", pa.list_(pa.float32()), "array<float>")], make).where("vector is not null")
