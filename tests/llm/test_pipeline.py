import corpus_pipeline
from pyspark.sql import functions as F

from specloom.llm import decontaminate, near_dup

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 ...", None, None, None)], docs.schema)
    columns = docs.columns
    docs = docs.union(odd)
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    docs = corpus_pipeline.language(spark, docs, D)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == before - {10**6 + k for k in range(3)}
    groups = near_dup.near_duplicates(spark, docs).collect()
    docs = corpus_pipeline.near_duplicates(spark, docs, D)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {r.component_id for r in groups}
    n = docs.count()
    cut = corpus_pipeline.repeats(spark, docs, D)
    assert cut.columns == columns and cut.count() == n and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.overlaps(spark, cut, bench).collect()}
    clean = corpus_pipeline.benchmark(spark, cut, D)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - dirty
    out = corpus_pipeline.tokens(spark, clean, D)
    langs = {r.doc_id: r.lang for r in clean.collect()}
    assert {r.doc_id: r.lang for r in out.collect()} == langs and set(langs.values()) <= {r.lang for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert out.count() == clean.count() and out.where(F.element_at("ids", -1) != 2).count() == 0


def test_run_is_registered(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    assert q["pipeline"].__wrapped__ is corpus_pipeline.run and sum(k.startswith("op") and k[2].isdigit() for k in q) == 13
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0
