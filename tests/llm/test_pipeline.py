import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebars.llm.quality import quality_report
from tidebars.llm.secrets import find_secrets, labelled_samples, train

from .test_packing import check, first_fit
from .test_similar_sets import plain_classes

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality_report(docs, "doc_id", "text").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if verdict[r["doc_id"]])
    found = plain_classes([t for _, t in rows])[0]
    rows = [r for i, r in enumerate(rows) if found[i] == i]
    left = spark.createDataFrame(rows, "name long, description string")
    spans = {r["name"]: sorted([*r["base_spans"], *r["added_spans"]]) for r in find_secrets(left, table=train(labelled_samples(left))).collect()}
    masked = []
    for name, text in rows:
        at, out = 0, []
        for s in spans[name]:
            if s["start"] >= at:
                out += [text[at:s["start"]], "[SECRET]"]
            at = max(at, s["end"])
        masked.append((name, "".join(out) + text[at:]))
    got = [r.asDict() | {"name": r["doc_id"]} for r in corpus_pipeline.run(spark, SF).collect()]
    assert check(got, masked) <= first_fit([r["length"] for r in got])


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_on_hardly_any_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, None, None, None, None)] * rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() == (0 if stage is corpus_pipeline.quality_rules else rows)
    assert corpus_pipeline.best_fit_packing(spark, docs, SF).count() == rows


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    report = quality_report(docs, "doc_id", "text").join(labels, "doc_id")
    assert report.where("not base_failed and not kept").count() == 0
    assert docs.join(labels, "doc_id").where(F.length("text") > 0).count() > 0
