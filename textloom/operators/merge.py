"""Incremental refresh of a corpus by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREE_ID = "__TREE__"


def last_wins(entries: DataFrame) -> DataFrame:
    """Of entries (pos, id, hash, json): one for each id, at its first place with its last hash and record."""
    last = F.max_by(F.struct("hash", "json"), "pos")
    return entries.where("id is not null and hash is not null").groupBy("id").agg(F.min("pos").alias("pos"), last.alias("_e")).select("pos", "id", "_e.hash", "_e.json")


def changed_files(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files (id, hash, ...) that the corpus doesn't have with the same hash."""
    return files.join(existing.select("id", "hash"), ["id", "hash"], "left_anti")


def untouched(existing: DataFrame, processed: DataFrame) -> DataFrame:
    """Entries that don't belong to a processed file (id, ending in '.file').

    A file's entry goes by its id. Other entries go if the id begins with a processed path and a dot: each id's
    prefixes before a dot are joined with the paths, so no pair of tables is compared row by row.
    """
    files = processed.select("id").distinct()
    kept = existing.join(files, "id", "left_anti")
    prefixes = files.select(F.expr("substring(id, 1, length(id) - 5)").alias("prefix"))
    others = kept.where(~F.col("id").endswith(".file") & (F.col("id") != TREE_ID))
    dots = F.size(F.split("id", r"\.")) - 1
    cut = F.expr("transform(sequence(1, size(split(id, '[.]')) - 1), n -> substring_index(id, '.', n))")
    exploded = others.where(dots > 0).select("id", F.explode(cut).alias("prefix"))
    gone = exploded.join(prefixes, "prefix", "left_semi").select("id").distinct()
    return kept.join(gone, "id", "left_anti")


def missing_files(existing: DataFrame, listed: DataFrame) -> DataFrame:
    """File entries (id) whose files aren't listed any more."""
    return existing.where(F.col("id").endswith(".file")).join(listed.select("id"), "id", "left_anti").select("id")


def merge(existing: DataFrame, processed: DataFrame, new: DataFrame, tree: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """(section, ord, sub, json): the tree, then kept entries in their order, then new ones by path.

    ``new`` has abs_path, ordinal, json; ``gone`` (id) prunes files that were deleted. Without it their
    entries stay.
    """
    kept = untouched(existing, processed if gone is None else processed.select("id").unionByName(gone.select("id")))
    out = kept.select(F.lit(1).alias("section"), F.lpad(F.col("pos").cast("string"), 20, "0").alias("ord"), F.lit(0).cast("long").alias("sub"), "json")
    out = out.unionByName(new.select(F.lit(2).alias("section"), F.col("abs_path").alias("ord"), F.col("ordinal").cast("long").alias("sub"), "json"))
    if tree is not None:
        out = out.unionByName(tree.select(F.lit(0).alias("section"), F.lit("").alias("ord"), F.lit(0).cast("long").alias("sub"), "json"))
    return out
