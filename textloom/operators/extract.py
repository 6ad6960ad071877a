"""Extraction of a source tree into a corpus, refreshed by content hash."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from textloom.operators import merge as m
from textloom.operators.structure import extract_definitions, records, with_patterns
from textloom.scratch import keep
from textloom.sources import corpus, tree
from textloom.sources.partitioned import PartitionedCorpus, refresh

log = logging.getLogger(__name__)


def plan(spark: SparkSession, root: str, existing: DataFrame, max_bytes: int = tree.MAX_BYTES, prune_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines to write, errors (rel, error)) of a tree and an existing corpus (pos, id, hash, json).

    A file whose entry has the hash of its text is left as it is; the others are parsed again, once each, and
    their old entries go, also where parsing fails.
    """
    files = tree.listing(spark, root).persist(StorageLevel.MEMORY_AND_DISK)
    read = tree.read_files(tree.source_files(files, max_bytes), max_bytes).persist(StorageLevel.MEMORY_AND_DISK)
    entries = m.last_wins(existing)
    ids = read.withColumn("id", F.concat("rel", F.lit(".file"))).withColumn("hash", F.sha2("content", 256))
    processed = m.changed_files(ids, entries)
    texts = processed.where("content is not null")
    found = extract_definitions(with_patterns(texts)).persist(StorageLevel.DISK_ONLY)  # records and errors come from the same pass
    new = corpus.to_lines(records(texts, root, found)).select("abs_path", "ordinal", "json")
    gone = m.missing_files(entries, ids) if prune_deleted else None
    head = tree.manifest(files, root)
    tree_line = head.select(F.to_json(F.struct(*head.columns)).alias("json"))
    errors = read.where("error is not null").select("rel", "error").unionByName(found.where("error is not null").select("rel", "error"))
    return m.merge(entries, processed, new, tree_line, gone), errors


def extract(spark: SparkSession, root: str, path: str, max_bytes: int = tree.MAX_BYTES, prune_deleted: bool = False) -> int:
    """Refresh the corpus at ``path`` from a tree; returns how many lines it has.

    Files that couldn't be read or took too long are rows (rel, error) of the table beside it, ``errors_path(path)``, which each run writes anew. Nothing
    is written if the tree has no file to take and the corpus no entry.
    """
    existing = corpus.load_entries(spark, path).persist(StorageLevel.MEMORY_AND_DISK)
    lines, errors = plan(spark, root, existing, max_bytes, prune_deleted)
    lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
    n = lines.count()
    if n > 1:
        corpus.write(lines, path)
    errors.write.mode("overwrite").json(errors_path(path))
    failed = spark.read.schema("rel string, error string").json(errors_path(path)).count()
    if failed:
        log.warning("%d files have errors, see %s", failed, errors_path(path))
    lines.unpersist()
    existing.unpersist()
    return n


def refresh_store(spark: SparkSession, root: str, path: str, max_bytes: int = tree.MAX_BYTES, prune_deleted: bool = False) -> PartitionedCorpus:
    """Refresh a corpus in buckets from a tree: only the buckets of files that changed are written. Errors are as in ``extract``."""
    files = tree.listing(spark, root)
    read = keep(tree.read_files(tree.source_files(files, max_bytes), max_bytes), "read")
    head = tree.manifest(files, root)
    line = head.select(F.to_json(F.struct(*head.columns)).alias("json"))
    listed = read.select(F.concat("rel", F.lit(".file")).alias("id")) if prune_deleted else None
    target, errors = refresh(read, PartitionedCorpus.open(spark, path), root, line, listed)
    errors.write.mode("overwrite").json(errors_path(path))
    return target


def errors_path(path: str) -> str:
    return f"{path.rstrip('/')}.errors"
