import pytest
from oracle import connect, same

from lumenframe.llm.queries import ORACLE_SQL, QUERIES
from lumenframe.llm.shared import materialise, survivors

SF = "/root/testdata/sf0.001"

COLUMNS = {
    1: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], 5: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    6: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], 7: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    8: ["page_id", "url", "text", "n_chars"], 9: ["doc_id", "held_out", "score", "predicted"], 10: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


def test_one_query_each():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    assert df.columns[: len(COLUMNS.get(n, []))] == COLUMNS.get(n, [])
    if name in ORACLE_SQL:
        same(df, connect(SF), ORACLE_SQL[name])
    elif n not in (2, 4):
        assert df.count() == spark.read.parquet(f"{SF}/{'pages' if n == 8 else 'documents'}.parquet").count()


def test_survivors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "B"), (3, "c"), (None, "d")], "doc_id long, text string")
    decisions = spark.createDataFrame([(1, False), (2, True), (2, False), (3, True), (None, False)], "doc_id long, kept boolean")
    got = survivors(docs, decisions, "doc_id").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 2, 3]


def test_materialised_tables_are_shared(spark):
    df = materialise(spark.range(3), "x")
    assert df._scratch.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 3
