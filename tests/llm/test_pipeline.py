"""The pipeline's stages take effect, and each hands on the columns of documents."""

import corpus_pipeline
from compare import of_spark
from pyspark.sql import functions as F

from framelake.llm import decontam, neardup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, before, sf), "test")
        assert after.columns == columns
        if name != "mixing":
            kept = {r.doc_id for r in after.collect()}
            assert kept <= {r.doc_id for r in before.collect()} and len(kept) >= 0.8 * before.count()
        if name == "near duplicates":
            classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(before).collect()}
            assert kept == set(classes.values())
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.contaminated(before, bench).collect()}
            assert bad and kept == {r.doc_id for r in before.collect()} - bad
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert last.columns == [*columns, "shard", "slot"] and last.count() == before.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_reruns_agree(spark, sf):
    assert of_spark(corpus_pipeline.run(spark, sf)) == of_spark(corpus_pipeline.run(spark, sf))


def test_stages_handle_odd_rows(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like those that stages use inside."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = [(None, None, None, None, None), (-1, "", "", "", 0), (-2, "w " * 30_000, None, "x", 1), (-3, "?!", "en", None, None), (-3, "other words of one id", "en", None, None), (None, "null id", "en", "x", 3)]
    rows = docs.unionByName(spark.createDataFrame(odd + odd[:3], docs.schema))
    for c in ("mark", "key", "node", "label", "_node_of_row", "_mark_of_row", "copies", "copy", "nth", "key_doc_id", "_nth", "score", "size", "taken", "target", "at", "arc", "text_", "_copies", "_copy", "_text_of_row", "_lang_of_row", "text_of_row", "lang_of_row"):
        rows = rows.withColumn(c, F.lit("kept"))
    n, before = rows.count(), rows
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(stage(spark, before, sf), "odd")
        assert set(before.columns) <= set(after.columns) and all(r.copies == r.mark == r.nth == r.score == r["at"] == "kept" for r in after.select("copies", "mark", "nth", "score", "at").collect()), name
        if name == "toxicity":
            assert after.count() >= n - 2
        if name == "near duplicates":
            ids = sorted(r.doc_id for r in after.where("doc_id < 0").collect())
            assert ids == [-3, -3, -2, -1] and after.where("doc_id IS NULL").count() == 2
        before = after
    assert before.count() > 0 and before.where("slot IS NULL").count() == 0
