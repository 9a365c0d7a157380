from collections import Counter

import corpus_pipeline as p
from pyspark.sql import functions as F

from tidemark.llm import registry
from tidemark.llm.common import clear_scratch, scratch_dir, stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    columns, rows = docs.columns, docs
    for name, stage in p.STAGES:
        stage(spark, rows, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns[: len(columns)] == columns
        if name != p.STAGES[-1][0]:
            assert out.columns == columns and out.count() <= rows.count()
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in rows.select("doc_id").collect()}
        if name != "line dedup" and name != p.STAGES[-1][0]:
            assert out.join(rows.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").count() == 0
        rows = out
    seen = Counter(r.doc_id for r in rows.select("doc_id").collect())
    assert seen and set(seen) <= set(before)
    assert rows.where("n_tokens is null or epoch is null or block is null or order_key is null").count() == 0
    again = p.run(spark, DATA)
    assert sorted(map(tuple, again.select("doc_id", "epoch", "block", "order_key").collect())) == sorted(map(tuple, rows.select("doc_id", "epoch", "block", "order_key").collect()))


def test_names():
    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_scratch(spark):
    df = stored(spark.range(5).toDF("x"))
    assert df.count() == 5 and scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    clear_scratch(spark)
    clear_scratch(spark)
