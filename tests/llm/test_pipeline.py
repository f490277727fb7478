import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_queries_can_be_read():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert all(map(callable, names.values()))


def test_run_applies_every_stage_in_turn(spark, monkeypatch):
    seen = []

    def stage(name):
        def apply(spark, docs, sf_dir):
            seen.append((name, docs.count(), [c for c in docs.columns if c[0] == "_"]))
            return docs.withColumn(f"_{name}", F.lit(1)).where(F.col("doc_id") % 2 == 0)

        return apply

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage("one")), ("two", stage("two"))])
    all_docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    even = all_docs.where("doc_id % 2 = 0").count()
    out = corpus_pipeline.run(spark, SMALL)
    assert seen == [("one", all_docs.count(), []), ("two", even, ["_one"])]
    assert out.count() == even and {"_one", "_two"} <= set(out.columns)


def test_pipeline_has_every_stage_and_packs_what_is_left(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "curriculum_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert set(before.columns) <= set(docs.columns)
        assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    left = docs.select("position", "text").collect()
    assert sorted(r["position"] for r in left) == list(range(1, len(left) + 1))
    assert sum(r["n_tokens"] for r in got) == sum(len(r["text"].split()) for r in left)
    assert {p["position"] for r in got for p in r["pieces"]} == {r["position"] for r in left if r["text"].split()}
