"""Registered queries on the given tables, against SQL or brute force, and the pipeline by stages."""

import os

import pytest

from tests.check_oracle import compare, oracle

pytest.importorskip("corpus_pipeline")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def test_url_query_equals_sql(spark):
    from emberline.llm.book import LLM_BOOK

    query, sql = LLM_BOOK["op7_url_reputation"]
    for sf_dir in (SF_DIR, "/root/testdata/sf0.01"):
        assert compare(spark, oracle(sf_dir), "op7", query, sql, sf_dir) is None


def test_all_ten_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names


def test_pipeline_stages(spark):
    """Each stage against what the operators say about its own input."""
    import corpus_pipeline
    from emberline.llm import decontamination, near_duplicates, private_data, quality_rules
    from emberline.llm.frames import documents

    docs = documents(spark, SF_DIR).cache()
    columns, sizes = docs.columns, [docs.count()]
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF_DIR).cache()
        assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString(), name
        sizes.append(docs.count())
        ids = {row["doc_id"] for row in docs.collect()}
        if name == "quality rules":
            judged = quality_rules.with_verdict(quality_rules.judge_table(before)).where("kept").collect()
            assert ids == {row["doc_id"] for row in judged}
        if name == "near-duplicates":
            classes = near_duplicates.near_duplicates(before).collect()
            assert ids == {row["class_id"] for row in classes}
        if name == "decontamination":
            leaks = {row["doc_id"] for row in decontamination.find_leaks(before, benchmark).collect()}
            assert ids == {row["doc_id"] for row in before.collect()} - leaks
        if name == "personal data":
            assert private_data.report(docs).agg({"n_email": "sum", "n_phone": "sum"}).first()[0] == 0
            assert all(row["n_chars"] == len(row["text"]) for row in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == sizes[-1] and sizes == sorted(sizes, reverse=True)
    assert corpus_pipeline.run(spark, SF_DIR).count() == sizes[-1]
