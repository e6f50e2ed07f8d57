import corpus_pipeline
import duckdb
import pytest
from test_decontam import brute as leaks
from test_near_dedup import brute as classes

from lumenframe.llm import quality
from lumenframe.llm.queries import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, as id -> row."""
    docs, out = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns or name == "bpe"
        rows = docs.collect()
        out.append((name, {r.doc_id: r for r in rows}))
        assert len(out[-1][1]) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    return dict(out)


def test_each_stage_equals_brute_force(spark, stages):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    model = quality.fit_on_labels(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = {i for i, t in texts.items() if model.score(__import__("numpy").array([quality.features(t)]))[0] >= quality.THRESHOLD}
    assert set(stages["quality"]) == good
    last = {}
    for i in sorted(good):
        last[(texts[i] or "").encode().lower()] = i
    assert set(stages["exact_dedup"]) == set(last.values())
    ids = sorted(last.values())
    of = classes([texts[i] for i in ids])
    assert set(stages["near_dedup"]) == {ids[c] for c in of.values()}
    ids = sorted(stages["near_dedup"])
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    dirty = {ids[d] for d, _, _ in leaks([texts[i] for i in ids], items)}
    assert set(stages["decontamination"]) == set(ids) - dirty and dirty
    assert set(stages["bpe"]) == set(stages["decontamination"])


def test_run_gives_the_last_stage(spark, stages):
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == {i: r.ids_sha256 for i, r in stages["bpe"].items()}


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, SF, "documents").limit(0), SF).collect() == []
