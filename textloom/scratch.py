"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text for a task that takes texts apart; their words and counts take some 25 times as much memory.
PART_BYTES = 8_000_000


def path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; without that setting, and with all of Spark on this machine, in a folder of the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def dealt(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt out by key to as many tasks as their texts ask for: what one of them holds doesn't grow with the table, as it does by Spark's own measure of
    the (compressed) bytes before words are made of them. All rows of a key meet in one task."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


#: Spark's setting by which an execution's shuffle files go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, to: str) -> None:
    """Add a DataFrame's rows to a table. What it shuffled is off the disk then."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(to)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame written to such a path and read back: what follows doesn't work it out again, also where executors are lost."""
    to = path(df.sparkSession, name)
    write(df, to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that were written to such paths; nothing that reads them may be run any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if folder.rpartition("/")[0].endswith("/textloom"):
                at = jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
