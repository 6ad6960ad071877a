"""TF-IDF index and cosine retrieval.

Texts, not their tokens, are dealt out by their index: a text's terms are then counted without a further shuffle.
Document frequencies are joined by token. A batch of queries is answered by bounds: no document gets more from a token than
the query's weight times the token's greatest weight in any document. Scores through each query's strongest tokens give a threshold; tokens whose
bounds together stay below it make no candidates, and candidates that can't reach it any more aren't scored to the end.

A stored index has counts, inverse frequencies and norms as tables, not the weights of all postings: these are worked out for the tokens of
queries only, where the counts are read. Norms come from the tokens in SLICES parts, so that no more than one part of all counts is shuffled at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokenize
from textloom.scratch import dealt, drop, keep, path, write

#: Tokens of each query, by their bounds, that the first threshold comes from.
FIRST_TOKENS = 3
#: Scores are rounded to 6 places, so what is this much below a threshold may still tie with it.
SLACK = 2e-6
#: Terms of a batch of queries that may be broadcast; beyond them the postings are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Documents whose indexes or norms may be broadcast, 16 bytes each.
BROADCAST_DOCS = 1_000_000
#: Parts of the tokens that norms are summed up from, one after the other.
SLICES = 4


def term_counts(docs: DataFrame, key: str = "doc_index", text: str = "text") -> DataFrame:
    """(key, token, tf); a text without tokens has no row."""
    rows = dealt(docs.select(key, F.col(text).alias("text")), key, "text")
    return rows.select(key, F.explode(tokenize("text")).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def inverse_frequencies(tf: DataFrame, n: Column | int, key: str = "doc_index") -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 0.5)) + 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return tf.groupBy("token").agg(F.count(key).alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 0.5)) + 1)


def weighted(tf: DataFrame, idf: DataFrame, key: str = "doc_index") -> DataFrame:
    """(key, token, tf, w): (1 + ln tf) * idf over the text's norm (plus 1e-8)."""
    raw = tf.join(idf.select("token", "idf"), "token").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key))) + 1e-8
    return raw.select(key, "token", "tf", (F.col("raw") / norm).alias("w"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _raw() -> Column:
    return (1 + F.log("tf")) * F.col("idf")


def norms(tf: DataFrame, idf: DataFrame, key: str = "doc_index") -> DataFrame:
    """(key, norm) of all texts with tokens, as a table."""
    to = path(tf.sparkSession, "squares")
    for k in range(SLICES):
        own = F.pmod(F.xxhash64("token"), F.lit(SLICES)) == k
        rows = tf.where(own).join(idf.where(own).select("token", "idf"), "token")
        write(rows.groupBy(key).agg(F.sum(_raw() * _raw()).alias("square")), to)
    squares = tf.sparkSession.read.parquet(to)
    out = keep(squares.groupBy(key).agg((F.sqrt(F.sum("square")) + 1e-8).alias("norm")), "norms")
    drop(squares)
    return out


@dataclass
class TfIdfIndex:
    """Postings of a corpus (doc_index, text); build once, retrieve often."""

    docs: DataFrame
    idf: DataFrame
    postings: DataFrame
    counts: DataFrame | None = None
    #: Of a stored index only.
    norms: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, persist: bool = True) -> TfIdfIndex:
        docs = docs.select("doc_index", F.coalesce("text", F.lit("")).alias("text"))
        tf = term_counts(docs)
        n = docs.count()
        if not persist:
            idf = inverse_frequencies(tf, n)
            return TfIdfIndex(docs, idf, weighted(tf, idf), tf)
        tf = keep(tf, "counts")
        idf = keep(inverse_frequencies(tf, n), "idf")
        known = norms(tf, idf)
        postings = tf.join(idf.select("token", "idf"), "token").join(known, "doc_index").select("doc_index", "token", "tf", (_raw() / F.col("norm")).alias("w"))
        return TfIdfIndex(docs, idf, postings, tf, known)

    def unpersist(self) -> None:
        """The stored index's tables go."""
        if self.norms is not None:
            drop(self.idf, self.counts, self.norms)

    def _slices(self) -> list[tuple[DataFrame, DataFrame]]:
        """Counts and norms of a stored index in parts by document, so many that each part's norms may be broadcast and no count is shuffled for them."""
        n = -(-self.norms.count() // BROADCAST_DOCS)
        own = [F.pmod(F.xxhash64("doc_index"), F.lit(n)) == k for k in range(n)] if n > 1 else [F.lit(True)]
        return [(self.counts.where(part), F.broadcast(self.norms.where(part))) for part in own]

    def _with_idf(self, terms: DataFrame) -> DataFrame:
        return _few(terms.join(self.idf.select("token", "idf"), "token"), BROADCAST_TERMS)

    def _greatest(self, tokens: DataFrame) -> DataFrame:
        """(token, greatest): the greatest weight of each of some tokens in any document."""
        if self.norms is None:
            return self.postings.join(_few(tokens, BROADCAST_TERMS), "token").groupBy("token").agg(F.max("w").alias("greatest"))
        to, tokens = path(tokens.sparkSession, "greatest"), self._with_idf(tokens)
        for counts, known in self._slices():
            write(counts.join(tokens, "token").join(known, "doc_index").groupBy("token").agg(F.max(_raw() / F.col("norm")).alias("greatest")), to)
        return tokens.sparkSession.read.parquet(to).groupBy("token").agg(F.max("greatest").alias("greatest"))

    def _postings_of(self, tokens: DataFrame, docs: DataFrame) -> DataFrame:
        """(doc_index, token, w) of some tokens in some documents; few enough of these are broadcast."""
        docs = _few(docs, BROADCAST_DOCS)
        if self.norms is None:
            return self.postings.select("doc_index", "token", "w").join(_few(tokens, BROADCAST_TERMS), "token").join(docs, "doc_index", "left_semi")
        rows = self.counts.join(docs, "doc_index", "left_semi").join(self._with_idf(tokens), "token")
        known = self.norms.join(docs, "doc_index", "left_semi")
        return rows.join(_few(known, BROADCAST_DOCS), "doc_index").select("doc_index", "token", (_raw() / F.col("norm")).alias("w"))

    def query_weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, token, qw) of queries (query_id, text); tokens that no document has are ignored."""
        return weighted(term_counts(queries, "query_id"), self.idf, "query_id").select("query_id", "token", F.col("w").alias("qw"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_index, score) of the documents that share a token with a query, rounded to 6 places."""
        parts = self._partial(self.query_weights(queries))
        return parts.select("query_id", "doc_index", F.round("part", 6).alias("score"))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, token, qw, bound): what a token can give a document at most."""
        weights = keep(self.query_weights(queries), "weights")
        return weights.join(self._greatest(weights.select("token").distinct()), "token").select("query_id", "token", "qw", (F.col("qw") * F.col("greatest")).alias("bound"))

    def _partial(self, terms: DataFrame) -> DataFrame:
        """(query_id, doc_index, part): scores through some tokens only, as a table."""
        terms = terms.select("query_id", "token", "qw")
        if self.norms is None:
            rows = self.postings.join(_few(terms, BROADCAST_TERMS), "token")
            return keep(rows.groupBy("query_id", "doc_index").agg(F.sum(F.col("w") * F.col("qw")).alias("part")), "parts")
        to, terms = path(terms.sparkSession, "parts"), self._with_idf(terms)
        for counts, known in self._slices():
            # Norms come after the sums: a text's counts are in one task already, so only sums are sent.
            sums = counts.join(terms, "token").groupBy("query_id", "doc_index").agg(F.sum(_raw() * F.col("qw")).alias("sum"))
            write(sums.join(known, "doc_index").select("query_id", "doc_index", (F.col("sum") / F.col("norm")).alias("part")), to)
        return terms.sparkSession.read.parquet(to)

    @staticmethod
    def _threshold(parts: DataFrame, k: int) -> DataFrame:
        """(query_id, least): the k-th best of partial scores, where there are k."""
        best = Window.partitionBy("query_id").orderBy(F.desc("part"))
        return parts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", F.col("part").alias("least"))

    def candidates(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, doc_index, part) of the documents that may be among the k best, and (query_id, token, qw) of the tokens that ``part`` leaves out.

        A document that is left out scores less than k others do.
        """
        terms = keep(self.bounds(queries), "bounds")
        strongest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "token")
        first = terms.withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= FIRST_TOKENS)
        parts = self._partial(first)
        least = keep(self._threshold(parts, k), "thresholds")
        drop(parts)
        # Weakest first: as long as the bounds together stay below the threshold, a document needs another token.
        weakest = Window.partitionBy("query_id").orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, 0)
        terms = terms.withColumn("together", F.sum("bound").over(weakest)).join(least, "query_id", "left")
        terms = keep(terms.withColumn("needed", (F.col("together") >= F.col("least") - SLACK) | F.col("least").isNull()).drop("together"), "terms")
        parts = self._partial(terms.where("needed"))
        rest = terms.where(~F.col("needed")).groupBy("query_id").agg(F.sum("bound").alias("rest"))
        reached = self._threshold(parts, k)
        kept = parts.join(rest, "query_id", "left").join(reached, "query_id", "left")
        kept = kept.where(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("least", F.lit(0.0)) - SLACK)
        return kept.select("query_id", "doc_index", "part"), terms.where(~F.col("needed")).select("query_id", "token", "qw")

    def retrieve_batch(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """The k best documents of each query; those without a common token have score 0 and fill up by index."""
        if k < 1:
            raise ValueError("k must be at least 1")
        queries = queries.select("query_id", "text")
        kept, rest = self.candidates(queries, k)
        kept = keep(kept, "kept")
        # What the left-out tokens add: the postings of candidates only.
        found = self._postings_of(rest.select("token").distinct(), kept.select("doc_index").distinct())
        more = kept.join(rest, "query_id").join(found, ["doc_index", "token"])
        more = more.select("query_id", "doc_index", (F.col("w") * F.col("qw")).alias("part"))
        scored = kept.unionByName(more).groupBy("query_id", "doc_index").agg(F.round(F.sum("part"), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_index")
        # The first k documents of the corpus are all that can be needed to fill up.
        first = [r[0] for r in self.docs.select("doc_index").orderBy("doc_index").limit(k).collect()]
        fill = F.array(*[F.lit(i) for i in first]).cast("array<long>")
        filled = queries.select("query_id").distinct().select("query_id", F.explode(fill).alias("doc_index"), F.lit(0.0).alias("score"))
        rows = scored.unionByName(filled).groupBy("query_id", "doc_index").agg(F.max("score").alias("score"))
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _scored_from_counts(self, qw: DataFrame) -> DataFrame:
        """(doc_index, score) of the documents that share a token with a query (token, qw).

        For one query postings needn't be made: a document's norm and its product with the query are sums over the same rows.
        """
        weights = self.idf.select("token", "idf").join(F.broadcast(qw), "token", "left")
        raw = self.counts.join(weights, "token").select("doc_index", "qw", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
        sums = raw.groupBy("doc_index").agg(F.sum(F.col("raw") * F.col("raw")).alias("square"), F.sum(F.col("raw") * F.col("qw")).alias("product"))
        return sums.where("product is not null").select("doc_index", F.round(F.col("product") / (F.sqrt("square") + 1e-8), 6).alias("score"))

    def retrieve(self, query: str, k: int = 3) -> DataFrame:
        """The k best documents (doc_index, score, text), best first; ties by index."""
        if k < 1:
            raise ValueError("k must be at least 1")
        spark = self.docs.sparkSession
        qw = self.query_weights(spark.createDataFrame([(0, query)], "query_id int, text string")).select("token", "qw")
        if self.counts is None or self.norms is not None:
            scored = self._partial(qw.select(F.lit(0).alias("query_id"), "token", "qw")).select("doc_index", F.round("part", 6).alias("score"))
        else:
            scored = self._scored_from_counts(qw)
        # Documents without a common token score 0; of those only the first k can be among the hits.
        first = self.docs.select("doc_index").orderBy("doc_index").limit(k).withColumn("score", F.lit(0.0))
        ranked = scored.unionByName(first).groupBy("doc_index").agg(F.max("score").alias("score"))
        top = ranked.orderBy(F.desc("score"), "doc_index").limit(k)
        # Texts are read for the hits only.
        return self.docs.join(F.broadcast(top), "doc_index").select("doc_index", "score", "text").orderBy(F.desc("score"), "doc_index")


def context(hits: DataFrame) -> DataFrame:
    """One row: the hits' texts, best first, with '---' lines between."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_index", "text")))
    return hits.agg(F.array_join(F.transform(ordered, lambda h: h["text"]), "\n---\n").alias("context"))


def prompt(context_: Column, query: Column | None = None) -> Column:
    """The prompt of a context; the question is left out unless given."""
    parts = [F.lit("Context:\n"), context_, F.lit("\n\nAnswer clearly:")]
    if query is not None:
        parts.insert(2, F.concat(F.lit("\n\nQuestion: "), query))
    return F.concat(*parts)
