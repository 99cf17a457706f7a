import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import toxicity
from quire.llm.common import written
from quire.llm.queries import QUERIES


@pytest.fixture(scope="module")
def scored(spark, sf):
    return written(QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1"), "test-scored")


def test_toxicity_held_out(scored, spark):
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.9 and sum(s >= 0.5 for s in good) <= 0.02 * len(good)


def test_toxicity_contract(scored, spark):
    assert scored.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert scored.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_toxicity_odd_rows_and_filter(make, odd_rows, spark):
    bad = [(100 + i, f"you idiot number {i} are a fool and a moron") for i in range(60)]
    good = [(200 + i, f"the plain sentence number {i} says nothing of note") for i in range(120)]
    labels = spark.createDataFrame([(d, 1) for d, _ in bad] + [(d, 0) for d, _ in good] + [(100, 1), (None, 1), (1, None), (2, 5)], "doc_id long, toxic int")
    docs = make(bad + good + odd_rows).withColumn("prediction", F.lit(1)).withColumn("features", F.lit("clash")).withColumn("p", F.lit(1))
    model = toxicity.fit(docs, labels, trees=3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(got[d] >= 0.5 for d, _ in bad) and all(got[d] < 0.5 for d, _ in good) and got[1] == got[2] == got[3]
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(
        r["doc_id"] or 0 for r in toxicity.score(docs, model).where("score < 0.5").collect()
    )


def test_toxicity_without_both_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(make([(1, "x")]), toxicity.fit(make([(1, "x")]), none)).collect()] == [0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(make([(1, "x")]), toxicity.fit(make([(1, "x")]), one)).collect()] == [1.0]


def test_features_count_what_they_say():
    lexicon = {"fool": 2.0, "idi-": 1.5}
    got = dict(zip(toxicity.FEATURES, toxicity.features("You FOOL! f00l idiotic word", toxicity.Reader(lexicon))))
    assert got["word_share"] == got["prefix_share"] == got["hidden_hits"] == got["shouted"] == 0.2
    assert got["near_person"] == 0.4 and got["exclaimed"] == 0.2 and got["person_share"] == 0.2
    assert toxicity.features(None, toxicity.Reader({})) == [0.0] * len(toxicity.FEATURES)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, sf), f"test-{name}")
        if k < 4:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            sizes.append(docs.count())
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[0] >= sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0.5 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[4]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
