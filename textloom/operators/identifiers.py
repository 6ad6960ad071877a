"""The most frequent identifiers of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import identifiers
from textloom.scratch import dealt


def identifier_counts(texts: DataFrame) -> DataFrame:
    """Of texts (key, text): key, low, n, shown (as first seen). Texts are dealt out by key; their words are not shuffled again."""
    words = dealt(texts.select("key", "text"), "key", "text").select("key", F.posexplode(identifiers("text")).alias("pos", "word"))
    return words.groupBy("key", F.lower("word").alias("low")).agg(F.count("*").alias("n"), F.min_by("word", "pos").alias("shown"))


def top_identifiers(texts: DataFrame, n: int) -> DataFrame:
    """(key, identifiers): up to n, by count and then name; case doesn't tell them apart."""
    ranked = identifier_counts(texts).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "low"))).where(F.col("r") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "shown"))), lambda x: x["shown"])  # n at most
    return ranked.groupBy("key").agg(listed.alias("identifiers"))
