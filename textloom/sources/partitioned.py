"""A corpus in buckets, of which a refresh writes only those that change.

Entries lie in buckets by the hash of their file's path. A version names each bucket's folder, the folder of the tree's lines and what
streams have been taken up to; it is switched by one small file when all is written. So buckets that nothing happened to keep their files byte by
byte, and a write that fails leaves the version before. Old versions can be restored until ``vacuum``.

An entry's place is (epoch, path, ordinal): kept entries keep theirs, new ones get the refresh's epoch, so the order is that of ``merge``: what is
kept in its order, then new entries by path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import merge
from textloom.scratch import keep
from textloom.sources import corpus, store

BUCKETS = 256
ENTRY = "epoch long, abs_path string, ordinal long, id string, hash string, json string"


def bucket(path: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit(""))), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class PartitionedCorpus:
    spark: SparkSession
    path: str
    number: int = 0
    buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)
    tree: str | None = None
    taken: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int = BUCKETS) -> PartitionedCorpus:
        """The current version; an empty corpus with so many buckets where there is none."""
        path, v = path.rstrip("/"), store.current(spark, path.rstrip("/"))
        if v is None:
            return PartitionedCorpus(spark, path, buckets=buckets)
        return PartitionedCorpus(spark, path, v["number"], v["buckets"], {int(b): f for b, f in v["folders"].items()}, v["tree"], v["taken"])

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """(bucket, epoch, abs_path, ordinal, id, hash, json) of all buckets, or of some."""
        wanted: dict[str, list[int]] = {}
        for b, folder in self.folders.items():
            if buckets is None or b in buckets:
                wanted.setdefault(folder, []).append(b)
        out = self.spark.createDataFrame([], f"bucket int, {ENTRY}")
        for folder, some in wanted.items():
            read = self.spark.read.schema(f"{ENTRY}, bucket int").option("basePath", f"{self.path}/{folder}").parquet(*[f"{self.path}/{folder}/bucket={b}" for b in some])
            out = out.unionByName(read.select(out.columns))
        return out

    def lines(self) -> DataFrame:
        """(section, ord, sub, json), as ``corpus.write`` takes them."""
        place = F.concat(F.lpad(F.col("epoch").cast("string"), 20, "0"), F.lit(" "), F.coalesce("abs_path", F.lit("")))
        out = self.entries().select(F.lit(1).alias("section"), place.alias("ord"), F.col("ordinal").alias("sub"), "json")
        if self.tree:
            tree = self.spark.read.text(f"{self.path}/{self.tree}")
            out = tree.select(F.lit(0).alias("section"), F.lit("").alias("ord"), F.lit(0).cast("long").alias("sub"), F.col("value").alias("json")).unionByName(out)
        return out

    def export(self, path: str) -> None:
        """The corpus as one file of JSON lines in its order."""
        corpus.write(self.lines(), path)

    def commit(self, processed: DataFrame, new: DataFrame, tree: DataFrame | None = None, gone: DataFrame | None = None, stream: tuple[str, int] | None = None) -> PartitionedCorpus:
        """The next version: entries of processed files (id, ending in '.file') go, those of ``new`` (abs_path, ordinal, path, id, hash, json) come.

        ``tree`` (json) replaces the tree's line; ``gone`` (id) prunes files. ``stream`` (name, batch) is kept with the version, so that a batch
        that comes again after a restart changes nothing.
        """
        if stream and self.taken.get(stream[0], -1) >= stream[1]:
            return self
        spark, suffix = self.spark, f"{self.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        new = keep(new.select(bucket("path", self.buckets).alias("bucket"), F.lit(self.number + 1).cast("long").alias("epoch"), "abs_path", F.col("ordinal").cast("long"), "id", "hash", "json"), "new")
        touched = processed.select("id") if gone is None else processed.select("id").unionByName(gone.select("id"))
        ids = self.entries().select("bucket", "id")  # of the entries only ids are read here
        dropped = keep(ids.join(merge.untouched(ids, touched).select("id").distinct(), "id", "left_anti"), "dropped")
        changed = sorted(r[0] for r in dropped.select("bucket").union(new.select("bucket")).distinct().collect())  # at most as many as there are buckets
        folders = {b: f for b, f in self.folders.items() if b not in changed}
        if changed:
            kept = self.entries(changed).join(dropped.select("id").distinct(), "id", "left_anti")
            kept.unionByName(new).repartition("bucket").sortWithinPartitions("bucket", "epoch", "abs_path", "ordinal").write.partitionBy("bucket").parquet(f"{self.path}/data-{suffix}")
            written = {int(n.removeprefix("bucket=")) for n in store.names(spark, f"{self.path}/data-{suffix}") if n.startswith("bucket=")}
            folders |= {b: f"data-{suffix}" for b in written}
        tree_folder = self.tree
        if tree is not None:
            tree_folder = f"tree-{suffix}"
            tree.select(F.col("json").alias("value")).write.text(f"{self.path}/{tree_folder}")
        taken = self.taken | ({stream[0]: stream[1]} if stream else {})
        return self._switch(folders, tree_folder, taken)

    def _switch(self, folders: dict[int, str], tree: str | None, taken: dict[str, int]) -> PartitionedCorpus:
        version = {"number": self.number + 1, "buckets": self.buckets, "folders": folders, "tree": tree, "taken": taken}
        store.commit(self.spark, self.path, version)
        return PartitionedCorpus.open(self.spark, self.path)

    def restore(self, number: int) -> PartitionedCorpus:
        """The content of an older version as the next one; what streams have been taken up to goes back with it."""
        import json

        old = json.loads(store.read_text(self.spark, f"{self.path}/versions/{number:012d}.json"))
        return self._switch({int(b): f for b, f in old["folders"].items()}, old["tree"], old["taken"])

    def vacuum(self) -> None:
        """Take away folders that the current version doesn't need; older versions can't be restored after it."""
        needed = {*self.folders.values(), self.tree, "versions"}
        for name in store.names(self.spark, self.path):
            if name not in needed:
                store.remove(self.spark, f"{self.path}/{name}")
        for name in store.names(self.spark, f"{self.path}/versions"):
            if name != f"{self.number:012d}.json":
                store.remove(self.spark, f"{self.path}/versions/{name}")


def refresh(files: DataFrame, target: PartitionedCorpus, root: str, tree: DataFrame | None = None, listed: DataFrame | None = None, stream: tuple[str, int] | None = None, parse: Callable | None = None) -> tuple[PartitionedCorpus, DataFrame]:
    """(next version, errors (rel, error)) from read files (rel, abs_path, lang, size, content, error).

    Files whose entry has the hash of their text are left alone; ``listed`` (id), all file ids that there are now, prunes the others.
    """
    from textloom.operators.structure import extract_definitions, records, with_patterns

    if stream and target.taken.get(stream[0], -1) >= stream[1]:
        return target, files.select("rel", "error").where("false")
    ids = files.withColumn("id", F.concat("rel", F.lit(".file"))).withColumn("hash", F.sha2("content", 256))
    current = target.entries().where(F.col("id").endswith(".file")).select("id", "hash")
    processed = keep(merge.changed_files(ids, current), "processed")
    texts = processed.where("content is not null")
    found = keep((parse or extract_definitions)(with_patterns(texts)), "definitions")
    new = corpus.to_lines(records(texts, root, found)).select("abs_path", "ordinal", "path", "id", "hash", "json")
    gone = merge.missing_files(current, listed) if listed is not None else None
    errors = files.where("error is not null").select("rel", "error").unionByName(found.where("error is not null").select("rel", "error"))
    return target.commit(processed, new, tree, gone, stream), errors
