"""A corpus that follows a stream of files.

Each micro-batch has files as they are now (rel, abs_path, lang, size, content, error, and mtime for their order). The hash that a file's entry has
in the corpus is the state: a file whose text is as before changes nothing. A batch is merged and committed with its number, in the same switch of
versions, so a batch that Spark runs again after a restart is passed over, and one that was lost before the switch is made anew: each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from textloom.sources.partitioned import BUCKETS, PartitionedCorpus, refresh


def latest(files: DataFrame) -> DataFrame:
    """Of several rows of a file in a batch the last by mtime, then by text."""
    fields = [c for c in files.columns if c != "rel"]
    return files.groupBy("rel").agg(F.max_by(F.struct(*fields), F.struct("mtime", F.coalesce("content", F.lit("")))).alias("f")).select("rel", "f.*")


def refresh_stream(files: DataFrame, path: str, root: str, name: str = "files", errors: str | None = None, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that keeps the corpus at ``path`` up to date; give it a checkpoint and start it.

    ``name`` tells this stream's batches from those of others that feed the same corpus; a stream with a new checkpoint needs a new name.
    Rows (rel, error) are added to the JSON files at ``errors``, a folder for each batch.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = PartitionedCorpus.open(spark, path, buckets)
        _, failed = refresh(latest(batch), target, root, stream=(name, number))
        if errors and target.taken.get(name, -1) < number:
            failed.write.mode("overwrite").json(f"{errors.rstrip('/')}/batch-{number:012d}")

    return files.writeStream.foreachBatch(merge_batch)
