"""Each stage against what its operator decides by itself, on the stage's own input."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from arborlens.llm import lines, minhash, secrets, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "secret_scan", "best_fit_packing"]
    steps = dict(pipeline.STAGES)

    clean = steps["toxicity"](spark, docs, sf_dir).cache()
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}

    short = steps["line_dedup"](spark, clean, sf_dir).cache()
    texts = {r.doc_id: r.text for r in lines.dedup_lines(clean).collect()}
    assert short.columns == columns and {r.doc_id: r.text for r in short.collect()} == texts
    assert short.filter(F.col("n_chars") != F.char_length("text")).count() == 0

    single = steps["minhash_near_dedup"](spark, short, sf_dir).cache()
    kept = {r.doc_id for r in minhash.near_duplicates(short).filter("kept").collect()}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == kept

    safe = steps["secret_scan"](spark, single, sf_dir).cache()
    assert safe.columns == columns and safe.count() == single.count()
    assert all(not secrets.base_spans(r.text) for r in safe.collect())

    packed = steps["best_fit_packing"](spark, safe, sf_dir)
    assert packed.select("doc_id").distinct().count() == safe.count()


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert out.count() > 100
