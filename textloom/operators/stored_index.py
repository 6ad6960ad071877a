"""A TF-IDF index on disk that is refreshed by what changed.

A store has generations. Each refresh writes one: the new documents, their postings (in buckets by token), the ids of the documents that it
replaces or takes away, and by how much each token's document frequency changed. What a later generation replaced counts no more. A version names
the generations that make it up and the number of documents; it is switched by one small file, so a refresh that fails leaves the old version as it was.
Weights depend on all document frequencies, so they aren't stored: they are worked out from counts, and the documents' norms, which need a pass over all
postings, are written once for a version when a query first needs them. A query of a few tokens then reads their buckets alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import tokenize
from textloom.operators.retrieval import TfIdfIndex, term_counts, weighted
from textloom.scratch import keep
from textloom.sources import store

BUCKETS = 64
POSTINGS = "doc_index long, token string, tf long"
#: Tokens of a query for which buckets are picked one by one.
FEW_TOKENS = 1000
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(ids: DataFrame) -> DataFrame:
    """Ids, to be broadcast if they aren't too many: then postings needn't be shuffled to meet them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def bucket(token: Column | str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str
    number: int
    generations: tuple[str, ...]
    documents: int

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredIndex:
        """The current version; an empty one where there is none."""
        v = store.current(spark, path) or {"number": 0, "generations": [], "documents": 0}
        return StoredIndex(spark, path.rstrip("/"), v["number"], tuple(v["generations"]), v["documents"])

    def _table(self, generation: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{generation}/{name}")

    def _all(self, name: str, schema: str) -> DataFrame:
        """A table over all generations, with the place of each in the version."""
        out = self.spark.createDataFrame([], f"{schema}, gen int")
        for gen, generation in enumerate(self.generations):
            out = out.unionByName(self._table(generation, name, schema).withColumn("gen", F.lit(gen)))
        return out

    def _live(self, name: str, schema: str) -> DataFrame:
        if len(self.generations) < 2:
            return self._all(name, schema).drop("gen")
        replaced = self._all("gone", "doc_index long").groupBy("doc_index").agg(F.max("gen").alias("since")).where("since > 0")
        return self._all(name, schema).join(by_ids(replaced), "doc_index", "left").where("since is null or gen >= since").drop("gen", "since")

    @property
    def texts(self) -> DataFrame:
        """(doc_index, text)."""
        return self._live("docs", "doc_index long, text string")

    @property
    def counts(self) -> DataFrame:
        """(doc_index, token, tf, bucket)."""
        return self._live("postings", f"{POSTINGS}, bucket int")

    @property
    def idf(self) -> DataFrame:
        """(token, df, idf), from the changes of all generations."""
        df = self._all("df", "token string, change long").groupBy("token").agg(F.sum("change").alias("df")).where("df > 0")
        return df.withColumn("idf", F.log((F.lit(self.documents) + 1) / (F.col("df") + 0.5)) + 1)

    def refresh(self, docs: DataFrame, removed: DataFrame | None = None) -> StoredIndex:
        """The next version: ``docs`` (doc_index, text) are new or replace those of the same index, ``removed`` (doc_index) go.

        Of rows with the same index the least text counts; an index that is in both is new.
        """
        spark, generation = self.spark, f"generation-{self.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        to = f"{self.path}/{generation}"
        docs = docs.where("doc_index is not null").groupBy(F.col("doc_index").cast("long").alias("doc_index")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        docs.write.parquet(f"{to}/docs")
        docs = self._table(generation, "docs", "doc_index long, text string")
        term_counts(docs).withColumn("bucket", bucket("token")).repartition("bucket", F.xxhash64("doc_index") % 8).write.partitionBy("bucket").parquet(f"{to}/postings")
        gone = docs.select("doc_index")
        if removed is not None:
            gone = gone.unionByName(removed.select(F.col("doc_index").cast("long"))).distinct()
        gone.write.parquet(f"{to}/gone")
        gone = self._table(generation, "gone", "doc_index long")
        # Frequencies change by the tokens of new documents and those of the old ones that they replace.
        added = self._table(generation, "postings", POSTINGS).groupBy("token").agg(F.count("*").alias("change"))
        lost = self.counts.join(by_ids(gone), "doc_index", "left_semi").groupBy("token").agg((-F.count("*")).alias("change"))
        added.unionByName(lost).groupBy("token").agg(F.sum("change").alias("change")).where("change <> 0").write.parquet(f"{to}/df")
        n = self.documents + docs.count() - self.texts.select("doc_index").join(gone, "doc_index", "left_semi").count()
        return self._commit((*self.generations, generation), n)

    def compact(self) -> StoredIndex:
        """The same documents in one generation; the old ones stay until ``vacuum``."""
        generation = f"generation-{self.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        to = f"{self.path}/{generation}"
        self.texts.write.parquet(f"{to}/docs")
        self.counts.repartition("bucket", F.xxhash64("doc_index") % 8).write.partitionBy("bucket").parquet(f"{to}/postings")
        self.spark.createDataFrame([], "doc_index long").write.parquet(f"{to}/gone")
        self.idf.select("token", F.col("df").alias("change")).write.parquet(f"{to}/df")
        return self._commit((generation,), self.documents)

    def vacuum(self) -> None:
        """Take away what the current version doesn't need."""
        needed = {*self.generations, "versions", f"norms-{self.number:012d}"}
        for name in store.names(self.spark, self.path):
            if name not in needed:
                store.remove(self.spark, f"{self.path}/{name}")

    def _commit(self, generations: tuple[str, ...], documents: int) -> StoredIndex:
        new = replace(self, number=self.number + 1, generations=generations, documents=documents)
        store.commit(self.spark, self.path, {"number": new.number, "generations": list(generations), "documents": documents})
        return new

    @property
    def norms(self) -> DataFrame:
        """(doc_index, norm) of this version, written when they are first asked for."""
        to = f"{self.path}/norms-{self.number:012d}"
        if not store.exists(self.spark, f"{to}/_SUCCESS"):
            raw = self.counts.join(self.idf.select("token", "idf"), "token").select("doc_index", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
            raw.groupBy("doc_index").agg((F.sqrt(F.sum(F.col("raw") * F.col("raw"))) + 1e-8).alias("norm")).write.mode("overwrite").parquet(to)
        return self.spark.read.schema("doc_index long, norm double").parquet(to)

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """(doc_index, token, tf, w), of all tokens or of a few, for which only their buckets are read.

        Where all postings are passed over anyway, norms come from the same pass.
        """
        counts, idf = self.counts, self.idf
        if tokens is None:
            return weighted(counts.drop("bucket"), idf)
        wanted = F.col("token").isin(*tokens) if tokens else F.lit(False)
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "token string").select(bucket("token")).collect()})
        counts, idf = counts.where(F.col("bucket").isin(*buckets)).where(wanted), idf.where(wanted)
        raw = counts.join(idf.select("token", "idf"), "token").join(self.norms, "doc_index")
        return raw.select("doc_index", "token", "tf", ((1 + F.log("tf")) * F.col("idf") / F.col("norm")).alias("w"))

    def index(self) -> TfIdfIndex:
        """This version for batches of queries."""
        return TfIdfIndex(self.texts, self.idf, self.postings())

    def retrieve(self, query: str, k: int = 3) -> DataFrame:
        """The k best documents of one query, as ``TfIdfIndex.retrieve`` gives them."""
        tokens = [r[0] for r in self.spark.createDataFrame([(query,)], "text string").select(F.explode(F.array_distinct(tokenize("text")))).collect()]
        few = tokens if len(tokens) <= FEW_TOKENS else None
        return TfIdfIndex(self.texts, self.idf, self.postings(few)).retrieve(query, k)


def build(docs: DataFrame, path: str) -> StoredIndex:
    """A store of these documents alone, or the next version of the one that is there."""
    index = StoredIndex.open(docs.sparkSession, path)
    old = keep(index.texts.select("doc_index"), "old") if index.generations else None
    return index.refresh(docs, old)
