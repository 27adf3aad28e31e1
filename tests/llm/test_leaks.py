"""What the held-out fold says changes no score of another document."""

from pyspark.sql import functions as F

from folioqc.llm import language, toxicity
from folioqc.llm.common import crc_fold

FOLDER = "/root/testdata/sf0.001"


def scores(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_held_out_labels_change_no_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = crc_fold() == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("elsewhere"))
    assert labels.where(held).count() > 10
    assert scores(toxicity.classify(moved, other), "score", "predicted") == scores(toxicity.classify(docs, labels), "score", "predicted")


def test_held_out_texts_and_languages_change_no_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = crc_fold() == 2
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(held, F.concat(F.lit("zzz qqq "), "text")).otherwise(F.col("text"))).withColumn("source", F.lit("elsewhere"))
    want, got = scores(language.identify(docs), "held_out", "lang_pred", "score"), scores(language.identify(other), "held_out", "lang_pred", "score")
    learnt = {k for k, v in want.items() if not v[0]}
    # Texts run side by side in half precision, so the last digits follow the company.
    assert len(learnt) > 100 and all(got[k][1] == want[k][1] and abs(got[k][2] - want[k][2]) < 1e-3 for k in learnt)
    assert "xx" not in {v[1] for v in got.values()}
