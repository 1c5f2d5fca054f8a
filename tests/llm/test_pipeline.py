"""The pipeline's stages, one after the other, on a small corpus."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(30))
    body = " ".join(f"the word {i} of a text" for i in range(60))
    rows = [(1, body), (2, body), (3, body + " end"), (4, None), (5, "12 34 !"), (6, f"before {item} after"), (7, "here is password = hunter22x for the house of the king")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "secret_scans":
            assert {r.doc_id: r.text for r in kept.collect()}[7] == "here is [assign] for the house of the king"
    got = {r.doc_id: r.n_tokens for r in kept.collect()}
    assert set(got) == {1, 7} and min(got.values()) > 5
