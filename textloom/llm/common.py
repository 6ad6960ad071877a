"""What the training-data operators share: input columns, shared scratch tables, labels and word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.scratch import write

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` splits at exactly these, and ``bytes.lower()`` lower-cases exactly A-Z.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that is unset and all of Spark runs on this machine, as in local tests, a folder of the machine is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    return materialize_parts([df], name)


def materialize_parts(parts: list[DataFrame], name: str) -> DataFrame:
    """The rows of all parts as one such table. They are written one after the other, each one's shuffle files gone before the next begins."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, name)
    for part in parts:
        write(part, path)
    return spark.read.schema(parts[0].schema).parquet(path)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, bound: int, keep: Column | None = None) -> DataFrame:
    """Up to ``bound`` distinct labelled texts as (text, label), chosen by a hash of the id.

    Rows without a text or a label of 0 or 1 aren't used. An id with labels of both kinds isn't used; a text whose ids have
    both has the label 0.
    """
    marks = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        .where("_lo = _hi")
        .select("doc_id", F.col("_lo").cast("int").alias("label"))
    )
    if keep is not None:
        marks = marks.where(keep)
    # Ids first: the texts of the other rows are never shuffled, and the bound holds before any text is read.
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = documents.select("doc_id", F.col("text").alias("text")).where("text is not null")
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("label").alias("label"))
