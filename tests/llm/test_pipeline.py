"""The pipeline on small tables: each stage against what brute force says of its input."""

import corpus_pipeline

from .cases import documents
from .test_decontaminate import brute as passages
from .test_jaccard import brute as copies

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(DIR + "/documents.parquet")
    names = docs.columns
    kept = [docs.select("doc_id", "text").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.select("doc_id", "text").collect())
        assert docs.columns == names or i + 1 == len(corpus_pipeline.STAGES)
    ids = [sorted(r["doc_id"] for r in rows) for rows in kept]
    assert len(ids[0]) * 0.8 < len(ids[1]) <= len(ids[0])
    assert ids[2] == sorted({c for _, _, c, _ in copies([tuple(r) for r in kept[1]], 5, 80, 100)})
    items = [tuple(r) for r in spark.read.parquet(DIR + "/benchmark.parquet").select("item_id", "text").collect()]
    assert ids[3] == sorted(d for d, n, hit, _ in passages([tuple(r) for r in kept[2]], items) if not (hit and 20 * hit >= n))
    assert ids[4] == ids[3] == ids[5]
    assert not any("@mail" in (r["text"] or "") for r in kept[5])
    assert set(names) < set(docs.columns)


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    assert out.count() > 100


def test_run_on_empty_and_on_odd_tables(spark, tmp_path):
    ddl = {"labels": "doc_id BIGINT, quality INT, toxic INT", "benchmark": "item_id BIGINT, text STRING"}
    for name, columns in ddl.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    documents(spark).drop("ids", "n_tokens").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    # Copies of one text go; null and empty texts and those without words stay.
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8]
    assert out.filter("doc_id IN (2, 3)").select("n_tokens").distinct().collect() == [(1,)]
