"""Every stage of the pipeline on nulls in any column, empty and very long texts, ties, repeated rows, extra columns and empty tables."""

import corpus_pipeline
import pytest


def checked(docs):
    """Names that stages use on the way, as extra columns."""
    names = ["__id", "__key", "__row", "__source", "__hash", "__class", "__group", "__score", "__predicted", "__text", "__n"]
    return docs.selectExpr("*", *[f"doc_id + {k} AS {n}" for k, n in enumerate(names)])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows(spark, folder, docs, rows, name, stage):
    if name != "quality_classifier":
        wide = checked(docs)
        out = stage(spark, wide, folder).collect()
        if name == "packing":
            return
        given = {tuple(r) for r in wide.collect()}
        assert all(tuple(r) in given for r in out) and list(out[0].asDict()) == wide.columns
        texts = {" ".join((r["text"] or "").split()) for r in out}
        if name == "exact_dedup":
            assert len(out) < len(rows) and len(texts) >= 60
    else:
        # fitted on the labelled rows of the test table, then applied to both
        base = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
        wide = checked(docs.select("doc_id", "text", "lang", "source").union(base))
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns
        given = {tuple(r) for r in wide.collect()}
        assert all(tuple(r) in given for r in out.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[1:], ids=[n for n, _ in corpus_pipeline.STAGES[1:]])
def test_empty_table(spark, folder, no_docs, name, stage):
    out = stage(spark, no_docs, folder)
    assert out.count() == 0 and (name == "packing" or out.columns == no_docs.columns)


def test_classifier_on_an_empty_table(spark, folder, no_docs):
    try:
        out = corpus_pipeline.quality_classifier(spark, no_docs, folder)
    except ValueError:
        return  # nothing to learn from
    assert out.count() == 0 and out.columns == no_docs.columns
