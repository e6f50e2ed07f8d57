"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, exact_dedup, html_extract, licenses, near_dedup, pii, quality, secrets, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file: $LUMENFRAME_VOCABULARY, or the installed public one."""
    if "LUMENFRAME_VOCABULARY" in os.environ:
        return os.environ["LUMENFRAME_VOCABULARY"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept", "links", "nearest")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenised(table(spark, sf_dir, "documents"), vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_decontamination, op3_near_dedup, op4_license_scan, op5_warc, op6_secret_scan, op7_pii, op8_main_text, op9_quality, op10_bpe)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        with normal as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents)
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
        from normal window same as (partition by t)""",
    "op5_warc": """
        with hashed as (select page_id, coalesce(html, '') as h from pages),
        bits as (select page_id, h, max(page_id) over (partition by h) as top,
                 list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(instr('0123456789abcdef', sha1(h)[i]) - 1), 4)), 'string_agg', '') as b
                 from hashed)
        select page_id, cast(strlen(h) as bigint) as payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          1 + cast(16 * cast(b[5*i+1] as int) + 8 * cast(b[5*i+2] as int) + 4 * cast(b[5*i+3] as int)
                               + 2 * cast(b[5*i+4] as int) + cast(b[5*i+5] as int) as int), 1)), 'string_agg', '') as payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type,
               case when page_id = top then null else top end as refers_to
        from bits""",
}
