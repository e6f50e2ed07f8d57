"""The catalog's tables derived from the driver's, which have no images: documents stand in for files.

A document's text is a file's content, the event of its number says when and by what it was taken, and a histogram
of its words' hashes stands in for the picture from which perceptual hashes are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import pack
from ..functions.names import thumb_path

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files; those of one source lie on a drive that is missing."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", F.lit("/lib"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.octet_length(text).cast("long").alias("size"),
        (1_700_000_000 + (F.col("doc_id") * 7919) % 1000).alias("mtime"),
        F.sha2(text.cast("binary"), 256).alias("content_hash"),
        F.when(F.col("source") == "src13", "missing").otherwise("analyzed").alias("status"),
    )


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) of every document: counts of its words by a hash of 64 values."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    cell = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 2), 16, 10).cast("int") % 64
    counts = words.groupBy("id", cell.alias("c")).agg(F.count("*").cast("int").alias("n"))
    held = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))  # at most 64 entries
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("vector"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, phash, dhash) of every document, by the rules of the picture hashes on the histogram."""
    rows = histograms(spark, sf_dir)
    ordered = F.array_sort("vector")
    rows = rows.withColumn("median", (F.get(ordered, 31) + F.get(ordered, 32)) / 2.0)
    above = F.transform("vector", lambda x: x > F.col("median"))
    falls = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.get("vector", i) > F.get("vector", i + 1))
    return rows.select("id", "vector", pack(above).alias("phash"), pack(falls).alias("dhash"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("captured_at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("camera"), F.col("value").alias("sharpness"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("face_count"), F.max("quality").cast("double").alias("eyes_open_ratio"))
    joined = docs.join(events, docs.doc_id == F.col("event_id"), "left").join(labels, docs.doc_id == F.col("labelled"), "left")
    return joined.select(
        F.col("doc_id").alias("file_id"),
        (640 + 64 * (F.col("doc_id") % 5)).cast("int").alias("width"),
        (480 + 48 * (F.col("doc_id") % 4)).cast("int").alias("height"),
        "captured_at",
        "camera",
        "sharpness",
        ((F.col("n_chars") % 100) / 100.0).alias("exposure_score"),
        "face_count",
        "eyes_open_ratio",
        F.when(F.col("lang") != "de", (F.col("n_chars") % 97) / 97.0).alias("aesthetic_score"),
        F.when(F.col("lang") != "es", thumb_path("/thumbs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).alias("thumb_path"),
    )


def representative_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dhash, phash) of the representative of each live content."""
    from ..operators.near import representatives

    prints = fingerprints(spark, sf_dir).select(F.col("id").alias("file_id"), "dhash", "phash")
    return representatives(files(spark, sf_dir), prints).withColumnRenamed("file_id", "id")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What composite scores are made of, for every image."""
    return images(spark, sf_dir).select(
        F.col("file_id").alias("id"), "sharpness", F.col("exposure_score").alias("exposure"), F.col("aesthetic_score").alias("aesthetic"),
        "face_count", "eyes_open_ratio", (F.col("width").cast("long") * F.col("height")).alias("pixels"),
    )


# --- the same relations in DuckDB's SQL ----------------------------------------------------------------------

SQL_FILES = """files as (
    select doc_id as id, '/lib/' || source || '/' || lang || '/' || doc_id || '.txt' as path,
           cast(strlen(coalesce(text, '')) as bigint) as size, 1700000000 + (doc_id * 7919) % 1000 as mtime,
           sha256(coalesce(text, '')) as content_hash,
           case when source = 'src13' then 'missing' else 'analyzed' end as status
    from documents),
live as (select * from files where status <> 'missing')"""

SQL_PRINTS = """words as (
    select doc_id as id, md5(unnest(string_split(coalesce(text, ''), ' '))) as h from documents),
cells as (
    select id, (16 * (instr('0123456789abcdef', h[1]) - 1) + instr('0123456789abcdef', h[2]) - 1) % 64 as c, count(*) as n
    from words group by all),
counted as (select id, map(list(c), list(n)) as m from cells group by id),
vectors as (select id, list_transform(range(0, 64), lambda i: coalesce(m[i], 0)) as v from counted),
medians as (select id, v, list_sort(v) as s from vectors),
unsigned as (
    select id, v,
           list_sum(list_transform(range(0, 64), lambda i: case when v[i + 1] > (s[32] + s[33]) / 2.0 then cast(1 as hugeint) << i else 0 end)) as p,
           list_sum(list_transform(range(0, 63), lambda i: case when v[i + 1] > v[i + 2] then cast(1 as hugeint) << i else 0 end)) as d
    from medians),
prints as (
    select id, v, cast(case when p >= 9223372036854775808 then p - 18446744073709551616 else p end as bigint) as phash,
           cast(case when d >= 9223372036854775808 then d - 18446744073709551616 else d end as bigint) as dhash
    from unsigned)"""

SQL_REPS = """reps as (
    select p.id, p.dhash, p.phash from prints p
    where p.id in (select min(id) from live group by content_hash))"""


def sql_edges(dhash: int, phash: int) -> str:
    return f"""edges as (
    select x.id as a, y.id as b from reps x join reps y on x.id < y.id
    where bit_count(xor(x.dhash, y.dhash)) <= {dhash} or bit_count(xor(x.phash, y.phash)) <= {phash})"""


SQL_CLUSTERS = """links as (select a, b from edges union all select b, a from edges),
reach(node, r) as (select a, a from links union select l.b, reach.r from reach join links l on l.a = reach.node),
clusters as (select node as file_id, min(r) as cluster_id from reach group by node)"""

SQL_IMAGES = """images as (
    select d.doc_id as file_id, cast(640 + 64 * (d.doc_id % 5) as int) as width, cast(480 + 48 * (d.doc_id % 4) as int) as height,
           epoch_us(e.ts) // 1000000 as captured_at, case when e.event_type <> 'error' then e.event_type end as camera,
           e.value as sharpness, (d.n_chars % 100) / 100.0 as exposure_score, l.face_count, l.eyes_open_ratio,
           case when d.lang <> 'de' then (d.n_chars % 97) / 97.0 end as aesthetic_score,
           case when d.lang <> 'es' then '/thumbs/' || substr(sha256(coalesce(d.text, '')), 1, 2) || '/' || sha256(coalesce(d.text, '')) || '.jpg' end as thumb_path
    from documents d left join events e on e.event_id = d.doc_id
    left join (select doc_id, max(toxic) as face_count, cast(max(quality) as double) as eyes_open_ratio from labels group by doc_id) l
      on l.doc_id = d.doc_id)"""
