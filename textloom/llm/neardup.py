"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document is the set of its word shingles. Equal sets are one vertex from the start. Each vertex
stands in TREES orders of all vertices, sorted by DEPTH MinHash values each. Its neighbours in an order share
the longest prefix with it, however deep that is: in a thin region few values, in a dense one
many. A neighbour with at least MIN_PREFIX values in common, of which a sketch doesn't rule
out the similarity, is a candidate. Candidates are verified on their full sets; links make components.

Orders are dealt to tasks by range of the sorted signatures, so a large group of near copies is
spread like others. First each vertex's likeliest candidates are verified, then those that
still join two components; pairs within a component can't change the result.

REACH bounds the first look only. A region is what shares MIN_PREFIX values in an order. Those of more vertices than
are in reach, or cut by the edge of a task, are looked at again where they still hold several components: all
vertices outside a region's largest component meet all of other components, by a sketch that rules out no similar pair and nearly all of similarity 0.75
or less where sets have up to some hundred shingles, and by all values of their signatures.
Where very many vertices are nearly alike and yet in different components, this takes time in the square of their number.

Defined cases: a text without words has the empty set and links with nothing; one with fewer words than
a shingle has one shingle, of all its words. A text of any length is taken whole. Of equal prefixes the smaller id comes
first. An empty table gives an empty one. A null id is in its set's component but never its name; where a set
has null ids only, component_id is null. Repeated rows link. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, table, words
from textloom.llm.components import components

TREES = 20
DEPTH = 8
MIN_PREFIX = 3
#: Neighbours on one side in an order that are looked at first.
REACH = 5
SKETCH = 64
#: Of the sketch's four-bit values this share agrees, at least, in a candidate. At similarity 0.8 it is 0.81 on average with a deviation of 0.05.
SKETCH_SHARE = 0.58
SIMILARITY = (4, 5)
#: Places of two whole signatures (four bits each) that agree, at least, in a candidate of a dense region: at similarity 0.8 130 on average with a deviation of 4.9.
AGREE = 109
#: Bits of a set's odd sketch; a power of two.
ODD = 512
#: Regions of more vertices are dealt to SALTS tasks.
CROWD = 1000
SALTS = 32
#: Likeliest candidates of a vertex that are verified first.
FIRST = 2
#: Ids that may be broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000

_VALUES = TREES * DEPTH
_A = (np.random.RandomState(7).randint(0, 2**31, _VALUES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.RandomState(8).randint(0, 2**31, _VALUES).astype(np.uint32) * np.uint32(2654435761)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(ws: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    h = np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ h[j : j + len(out)]) * _MIX
            out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One MinHash value for each of the orders' places."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(_VALUES, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 2048):
            best = np.minimum(best, ((low[None, at : at + 2048] ^ _B[:, None]) * _A[:, None]).min(axis=1))
    # The top bits of a minimum are nearly all zero: mix them.
    best ^= best >> np.uint32(15)
    with np.errstate(over="ignore"):
        best *= np.uint32(0x85EBCA6B)
    return (best >> np.uint32(16)).astype(">u2")


def odd_sketch(shingles: np.ndarray) -> bytes:
    """For each of ODD bits whether an odd number of shingles falls on it.

    Bits in which two sets differ come from shingles that one of them alone has, so there are at least as many of these.
    """
    return np.packbits(np.bincount((shingles & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1).tobytes()


def described(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for the empty set), the signature and the odd sketch of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(words(t), k, hashes) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": [len(s) for s in sets], "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "signature": [signature(s).tobytes() if len(s) else None for s in sets], "odd": [odd_sketch(s) if len(s) else None for s in sets]})

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, set_key binary, signature binary, odd binary")


def orders(vertices: DataFrame) -> DataFrame:
    """A row for each vertex and order: (tree, label, id, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            s = np.frombuffer(b"".join(b["signature"]), dtype=np.uint8).reshape(len(b), TREES, 2 * DEPTH)
            low = s.reshape(len(b), _VALUES, 2)[:, : 2 * SKETCH : 2, 1] & 15
            sketch = (low[:, 0::2] << 4 | low[:, 1::2]).astype(np.uint8)
            sketches = [x.tobytes() for x in sketch]
            for t in range(TREES):
                yield pd.DataFrame({"tree": np.full(len(b), t, dtype=np.int32), "label": [x.tobytes() for x in s[:, t]], "id": b["id"], "sketch": sketches})

    return vertices.mapInPandas(run, "tree int, label binary, id long, sketch binary")


def neighbours(rows: DataFrame) -> DataFrame:
    """Neighbours in any order of which the sketch allows a link, as (a, b, share), and regions as (tree, prefix, n).

    A task gives the regions of more rows than are in reach, and its first and last one, which may go on in another task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, region, size, first = None, None, 0, True

        def ended() -> list[tuple]:
            return [(region[0], region[1], size)] if region is not None and (first or size > REACH + 1) else []

        for b in batches:
            if not len(b):
                continue
            tree, ids = b["tree"].to_numpy(), b["id"].to_numpy()
            label = np.frombuffer(b"".join(b["label"]), dtype=np.uint8).reshape(len(b), -1)
            sketch = np.frombuffer(b"".join(b["sketch"]), dtype=np.uint8).reshape(len(b), -1)
            prefix = label[:, : 2 * MIN_PREFIX]
            starts = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1))))
            lengths = np.diff(np.append(starts, len(b)))
            regions = []
            # Whole regions inside the batch that are in reach need no look one by one.
            for at in np.flatnonzero((lengths > REACH + 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)).tolist():
                name = (int(tree[starts[at]]), prefix[starts[at]].tobytes())
                if name == region:
                    size += int(lengths[at])
                    continue
                regions += ended()
                first = first and region is None
                region, size = name, int(lengths[at])
            if regions:
                yield pd.DataFrame(regions, columns=["tree", "prefix", "n"])
            if held is not None:
                tree, ids, label, sketch = (np.concatenate(x) for x in zip(held, (tree, ids, label, sketch), strict=True))
            old = 0 if held is None else len(held[0])
            out = []
            for o in range(1, min(REACH, len(ids) - 1) + 1):
                i = np.arange(max(0, old - o), len(ids) - o)
                i = i[(tree[i] == tree[i + o]) & (label[i, : 2 * MIN_PREFIX] == label[i + o, : 2 * MIN_PREFIX]).all(axis=1)]
                x = sketch[i] ^ sketch[i + o]
                share = (((x >> 4) == 0).sum(axis=1) + ((x & 15) == 0).sum(axis=1)) / SKETCH
                near = share >= SKETCH_SHARE
                i = i[near]
                out.append(pd.DataFrame({"a": np.maximum(ids[i], ids[i + o]), "b": np.minimum(ids[i], ids[i + o]), "share": share[near]}))
            held = tuple(x[-REACH:].copy() for x in (tree, ids, label, sketch))
            if out:
                pairs = pd.concat(out)
                yield pairs[pairs["a"] != pairs["b"]].drop_duplicates(["a", "b"])
        first = True
        if last := ended():
            yield pd.DataFrame(last, columns=["tree", "prefix", "n"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in run(batches):
            yield b.reindex(columns=["a", "b", "share", "tree", "prefix", "n"]).astype({"a": "Int64", "b": "Int64", "tree": "Int32", "n": "Int64"})

    partitions = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(partitions, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    return ranged.mapInPandas(whole, "a long, b long, share double, tree int, prefix binary, n long")


def bounded(df: DataFrame) -> DataFrame:
    """For a join: broadcast if the table, which is counted, is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def crowded_regions(found: DataFrame) -> DataFrame:
    """(tree, prefix) of regions with pairs that weren't in reach: too many rows, or in several tasks."""
    sums = found.where("tree is not null").groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.count("*").alias("tasks"))
    return sums.where((F.col("n") > REACH + 1) | ((F.col("tasks") > 1) & (F.col("n") > 1))).select("tree", "prefix")


def open_regions(vertices: DataFrame, regions: DataFrame, roots: DataFrame) -> DataFrame:
    """The vertices of regions that hold several components: (tree, prefix, id, root, main, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.frombuffer(b"".join(b["signature"]), dtype=np.uint8).reshape(len(b), TREES, 2 * DEPTH)
                for t in range(TREES):
                    yield pd.DataFrame({"tree": np.full(len(b), t, dtype=np.int32), "prefix": [x[: 2 * MIN_PREFIX].tobytes() for x in s[:, t]], "id": b["id"]})

    rows = vertices.select("id", "signature").mapInPandas(run, "tree int, prefix binary, id long")
    rows = materialize(rows.join(bounded(regions), ["tree", "prefix"]), "regions")
    rows = rows.join(roots, "id", "left").select("tree", "prefix", "id", F.coalesce("root", "id").alias("root"))
    sizes = rows.groupBy("tree", "prefix", "root").agg(F.count("*").alias("k")).groupBy("tree", "prefix")
    sizes = sizes.agg(F.count("*").alias("roots"), F.sum("k").alias("n"), F.max_by("root", F.struct("k", "root")).alias("main"))
    several = materialize(sizes.where("roots > 1").select("tree", "prefix", "n", "main"), "open")
    return materialize(rows.join(bounded(several), ["tree", "prefix"]), "shared")


_WORDS = [f"w{i}" for i in range(_VALUES // 16)]
_ODD = [f"o{i}" for i in range(ODD // 64)]


def nibbles(vertices: DataFrame) -> DataFrame:
    """id, n_shingles, four bits of each value of the signature, sixteen to a number, and the odd sketch in numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                low = np.frombuffer(b"".join(b["signature"]), dtype=np.uint8).reshape(len(b), _VALUES, 2)[:, :, 1] & 15
                odd = np.frombuffer(b"".join(b["odd"]), dtype="<i8").reshape(len(b), -1)
                packed = np.ascontiguousarray((low[:, 0::2] << 4) | low[:, 1::2]).view("<i8")
                yield pd.DataFrame({"id": b["id"], "n_shingles": b["n_shingles"], **{w: packed[:, i] for i, w in enumerate(_WORDS)}, **{w: odd[:, i] for i, w in enumerate(_ODD)}})

    return vertices.select("id", "n_shingles", "signature", "odd").mapInPandas(run, "id long, n_shingles long, " + ", ".join(f"{w} long" for w in _WORDS + _ODD))


def region_pairs(shared: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, share) of open regions: vertices of different components that may be similar, one of them outside the region's largest."""
    ids = materialize(shared.select("id").distinct(), "ids")
    own = nibbles(vertices.join(bounded(ids), "id", "left_semi"))
    rows = materialize(shared.join(own, "id"), "members")
    side = lambda c: F.struct("id", "root", "n_shingles", *_WORDS, *_ODD).alias(c)
    crowded = F.col("n") > CROWD
    x = rows.where("root != main").select("tree", "prefix", F.when(crowded, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"), side("x"))
    salts = F.when(crowded, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    y = rows.select("tree", "prefix", F.explode(salts).alias("salt"), side("y"))
    agree = F.lit(_VALUES)
    for w in _WORDS:
        z = F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        agree = agree - F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    top, bottom = SIMILARITY
    # Sets of too different sizes can't be similar.
    sizes = F.least("x.n_shingles", "y.n_shingles") * bottom >= F.greatest("x.n_shingles", "y.n_shingles") * top
    # Nor those of which more shingles differ than the sizes allow: (1 - s) / (1 + s) of both together at similarity s.
    differ = F.lit(0)
    for w in _ODD:
        differ = differ + F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}")))
    few = differ * (bottom + top) <= (F.col("x.n_shingles") + F.col("y.n_shingles")) * (bottom - top)
    pairs = x.join(y, ["tree", "prefix", "salt"]).where(F.col("x.root") != F.col("y.root")).where(sizes).where(few).where(agree >= AGREE)
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"), (agree / _VALUES).alias("share")).distinct()


def likeliest(pairs: DataFrame) -> DataFrame:
    """The pair (a, b) of each vertex with the largest share."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "share")
    best = ends.groupBy("e.id").agg(F.max_by("e.other", F.struct("share", "e.other")).alias("other"))
    return best.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose vertices aren't in one component yet."""
    root = lambda c, to: roots.select(F.col("id").alias(c), F.col("root").alias(to))
    return pairs.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, bottom = SIMILARITY
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(shared * bottom >= top * (len(x) + len(y) - shared))
            yield b.loc[np.array(keep, dtype=bool), ["a", "b"]]

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def full_sets(documents: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The shingles of the vertices in ``ids``, read again from their texts; of an id with several texts the least set in order of bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "shingles": [shingle_set(words(t), k, hashes).astype("<u8").tobytes() for t in b["text"]]})

    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(bounded(ids), "id", "left_semi")
    return rows.mapInPandas(run, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles"))


def near_components(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = materialize(described(documents, k), "described")
    whole = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min_by("signature", "doc_id").alias("signature"), F.min_by("odd", "doc_id").alias("odd"), F.max("n_shingles").alias("n_shingles"))
    whole = materialize(whole, "sets")
    vertices = whole.select("id", "signature", "odd", "n_shingles")
    # An id with several texts is one vertex; one of its sets, the same in each run, is compared.
    found = materialize(neighbours(orders(vertices.select("id", "signature"))), "found")
    pairs = materialize(found.where("a is not null").groupBy("a", "b").agg(F.max("share").alias("share")), "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = materialize(full_sets(documents, ids, k), "shingles")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "share", "a", "b")
    first = ends.withColumn("n", F.row_number().over(Window.partitionBy("e.id").orderBy(F.desc("share"), "e.other"))).where(F.col("n") <= FIRST).select("a", "b").distinct()
    roots = components(materialize(verify(first, sets), "links"))

    def joined(links: DataFrame) -> DataFrame:
        links = materialize(links, "links")
        return roots if links.isEmpty() else components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links))

    roots = joined(verify(across(pairs, roots), sets))
    shared = open_regions(vertices, materialize(crowded_regions(found), "crowded"), roots)
    further = materialize(region_pairs(shared, vertices).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "further")
    if not further.isEmpty():
        more = further.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(ids, "id", "left_anti")
        sets = sets.unionByName(materialize(full_sets(documents, materialize(more, "ids"), k), "shingles"))
        roots = joined(verify(likeliest(further), sets))
        roots = joined(verify(across(further, roots), sets))
    named = whole.select("set_key", "id").join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), 2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest id, once, with its columns; five-word shingles."""
    found = near_components(docs, 5)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"])) if again else kept
