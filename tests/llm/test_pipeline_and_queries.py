import hashlib

import corpus_pipeline
import duckdb
import pytest

from kinsmith.llm import queries
from kinsmith.llm.common import materialize, table
from kinsmith.llm.decontam import contaminated
from kinsmith.llm.importance import importance_sample
from kinsmith.llm.minhash import near_duplicates
from kinsmith.llm.secrets import find_spans, redact


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda data, names: sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in data)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    """Stage by stage: what each decides of its input, applied here row by row, is what the next one gets."""
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "secrets", "tokens"]

    kept = {r["doc_id"] for r in importance_sample(docs, table(spark, sf, "labels")).collect()}
    one = materialize(stages["quality"](spark, docs, sf), "t")
    assert one.schema == docs.schema and {r["doc_id"] for r in one.collect()} == kept

    kept = {r["doc_id"] for r in near_duplicates(one).where("kept").collect()}
    two = materialize(stages["near_dedup"](spark, one, sf), "t")
    assert two.columns == docs.columns and sorted(r["doc_id"] for r in two.collect()) == sorted(kept)

    kept -= {r["doc_id"] for r in contaminated(two, table(spark, sf, "benchmark")).collect()}
    three = materialize(stages["decontamination"](spark, two, sf), "t")
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == kept

    four = materialize(stages["secrets"](spark, three, sf), "t")
    assert four.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    assert texts == {d: redact(rows[d]["text"]) for d in kept}
    assert not any(find_spans(t)[0] for t in texts.values())

    five = stages["tokens"](spark, four, sf).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in five} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, five))


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    rows = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, "a " * 30_000, "x"), (None, "password=abcdef123456 x", None)]
    spark.createDataFrame([(d, t, lang, None, 3, "k") for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"] > 0) for r in got) == [("2", True), ("None", True)]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
