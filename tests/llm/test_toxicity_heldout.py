"""Toxicity on labelled documents that the chain wasn't fitted on."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textloom.llm import toxicity
from textloom.llm.common import id_bucket, labelled_sample

DATA = "/root/testdata/sf0.1"


def held_out_figures(spark, data):
    documents, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = labelled_sample(documents, labels, "toxic", toxicity.SAMPLE_ROWS, id_bucket(F.col("doc_id"), 5) != 0).toPandas().sort_values("text", kind="stable")
    rows = rows.iloc[np.argsort(pd.util.hash_array(rows["text"].to_numpy(dtype=object)), kind="stable")]
    chain = toxicity.fit_rows(rows["text"].tolist(), rows["label"].tolist())
    # A text that stands on both sides of the fold isn't held out.
    known = spark.createDataFrame([(t,) for t in rows["text"]], "text string")
    fold = documents.where(id_bucket(F.col("doc_id"), 5) == 0).join(known, "text", "left_anti").join(labels, "doc_id")
    got = toxicity.score(fold.select("doc_id", "text"), chain).withColumnRenamed("toxic", "rejected").join(labels.select("doc_id", "toxic"), "doc_id")
    return {(r["toxic"], r["rejected"]): r["n"] for r in got.where("toxic is not null").groupBy("toxic", "rejected").agg(F.count("*").alias("n")).collect()}


def test_held_out_fold(spark):
    n = held_out_figures(spark, DATA)
    found, missed, wrong, right = (n.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    print("held out: toxic found", found, "of", found + missed, "others rejected", wrong, "of", wrong + right)
    assert found + missed > 50 and found >= 0.8 * (found + missed) and wrong <= 0.01 * (wrong + right)
