"""Hard negatives: for each anchor and each of its nearest rows of the same label, near rows of other labels that score
a little less.

Scores are integer inner products. Vectors are given one more component, so that all stored ones are equally long
(sqrt(M^2 - |x|^2), M the greatest length) and anchors as queries have 0 there: the greatest inner product is then the least distance, and
the triangle inequality holds. Each vector is assigned to the nearest of a bounded number of pivots (its Voronoi cell), with its distance from it.
Anchors form groups by the nearest of the first few pivots. A join has two rounds:

1. A group meets the rows whose nearest group pivot is its own. What an anchor finds there bounds the distance of what it still needs.
2. From these bounds follows, for each group and cell, the ring of distances from the cell's pivot in which a row can serve an anchor of the
   group. A row goes to the groups whose ring has it, and only to them; there the exact join is done by blocks of anchors and chunks of rows.

The first join finds each anchor's nearest rows of its label, the second, for each of their scores as a limit, the best
rows of other labels not above it. Nothing is approximate: pivots and groups decide the work alone. Rows of a group go to tasks in chunks whatever their
vectors are, and anchors with one label and vector ask once, so many copies of one vector neither meet in one task nor
multiply the work; the few lists of a vector that very many anchors share are copied for their final join.
Broadcast are pivots (at most MOST_PIVOTS vectors) and rings (MOST_GROUPS x MOST_PIVOTS pairs of numbers at most, 4 MB).

Defined results: a row without an id, label or vector, or with a component that is null or not finite, takes no part. Shorter vectors
count as filled up with zeros. Ties go to the smaller id. Repeated rows count once; rows of one id that
differ are all rows, of which an anchor's list has each pair of id and score once, and its own id with its own
squared length never. A positive with a negative score has no negatives; an empty table, or one without anchors, gives no rows. Where products reach
2^53 they are worked out with whole numbers of any size; a score that doesn't fit a long is an error. Only the three columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, table

SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST_PERCENT = 80
#: Pivots are at most so many, drawn by a hash of the id; of n rows about sqrt(n) / 4.
MOST_PIVOTS = 1024
#: Groups of anchors: at most so many, with so many anchors each on average at least.
MOST_GROUPS, GROUP_ANCHORS = 256, 128
#: Anchors of a block and rows of a chunk in one call of the local join; smaller chunks where rows would not fill the tasks.
BLOCK, CHUNK, LEAST_CHUNK, TILE = 4096, 16_384, 256, 256
#: A vector that more than this many anchors share (and more than a thousandth of all) has its lists copied SALTS times.
HOT_ANCHORS, SALTS = 10_000, 64
#: Relative slack of distances against rounding.
SLACK = 1e-6

LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "key binary, slot int, vec_id long, score long"


@dataclass(frozen=True)
class Space:
    """What all tasks know: number of components, greatest length, pivots (with the added component) and how many of them are groups'."""

    dims: int
    longest: float
    pivots: np.ndarray
    groups: int

    @property
    def stored(self) -> str:
        """Type of stored components: exact for whole numbers of this length."""
        return "<f4" if self.longest < 1 << 24 else "<f8"

    @property
    def exact(self) -> bool:
        """Whether each sum of products is a whole number that a double holds."""
        return self.longest**2 < 1 << 53

    def matrix(self, blobs) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), dtype=self.stored).astype(np.float64).reshape(-1, self.dims)

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Of rows (or anchors as queries) from each pivot."""
        square = np.einsum("ij,ij->i", x, x) if query else np.full(len(x), self.longest**2)
        inner = x @ self.pivots[:, :-1].T
        if not query:
            inner += np.outer(self.added(x), self.pivots[:, -1])
        return np.sqrt(np.maximum(square[:, None] + self.longest**2 - 2 * inner, 0))


def whole(values: np.ndarray, ends: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the components of lists, filled up with zeros."""
    out = np.zeros((len(ends) - 1, dims))
    size = np.diff(ends)
    flat = np.floor(scale * values[ends[0] : ends[-1]].astype(np.float64))
    out[np.arange(dims)[None, :] < size[:, None]] = flat
    return out


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    x = np.ascontiguousarray(x)
    ends = (np.arange(len(x) + 1) * (x.shape[1] * x.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def measure(rows: DataFrame, anchor: Column, scale: int) -> tuple[Space, int] | None:
    """The space of usable rows and the number of anchors; None without rows."""
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    # floor() of a value beyond a long is cut off; the length needs to be right to a few digits only.
    large = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0)))
    square = F.when(F.array_max(F.transform("embedding", F.abs)) * scale < float(1 << 62), square).otherwise(large)
    n, longest, dims, anchors = rows.agg(F.count("*"), F.max(F.coalesce(square, F.lit(0.0))), F.max(F.size("embedding")), F.count_if(anchor)).first()
    if not n:
        return None
    count = min(MOST_PIVOTS, int(np.ceil(np.sqrt(n) / 4)))
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(count).collect()
    space = Space(max(dims, 1), float(np.sqrt(longest)) * (1 + 1e-9), np.zeros((0, max(dims, 1) + 1)), 0)
    values = [np.array(r["embedding"], dtype=np.float64) for r in sample]
    drawn = np.stack([whole(v, np.array([0, len(v)]), space.dims, scale)[0] for v in values])
    _, first = np.unique(drawn, axis=0, return_index=True)
    drawn = drawn[np.sort(first)]
    pivots = np.hstack([drawn, space.added(drawn)[:, None]])
    groups = min(MOST_GROUPS, len(pivots), max(1, -(-anchors // GROUP_ANCHORS)))
    return Space(space.dims, space.longest, pivots, groups), anchors


def assign(rows: DataFrame, anchor: Column, space: Space, scale: int) -> DataFrame:
    """(row, vec_id, label, vec, is_anchor, cell, ring, home): each usable row with its cell, its distance from the cell's pivot and its group."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            lists = b.column("embedding")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            x = whole(values, ends, space.dims, scale)
            far = space.distances(x, query=False)
            cell = far.argmin(axis=1)
            home = far[:, : space.groups].argmin(axis=1)
            columns = [b.column("vec_id"), b.column("label"), _binary(x.astype(space.stored)), b.column("is_anchor"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), pa.array(home.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vec", "is_anchor", "cell", "ring", "home"])

    taken = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    out = taken.mapInArrow(run, "vec_id long, label long, vec binary, is_anchor boolean, cell int, ring double, home int")
    return out.withColumn("row", F.monotonically_increasing_id())


def _number(column: str, values: list[int]) -> Column:
    """values[column], as a literal array: one value a group."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(column) + 1)


class Join:
    """Rows of a space, to be searched by requests (key, label, vec, same, caps, floors).

    A request asks, for each place in its two arrays (slot), for the first k rows by score, then id, of its label (same) or of other
    labels, with scores from the floor to the cap.
    """

    def __init__(self, points: DataFrame, space: Space) -> None:
        self.points, self.space = points, space
        self.spark = points.sparkSession
        self.shared = self.spark.sparkContext.broadcast(space)

    def nearest(self, requests: DataFrame, k: int) -> DataFrame:
        """(key, slot, vec_id, score, rank)."""
        requests = materialize(self._grouped(requests), "requests")
        counts = self._counts(requests.select(F.col("home").alias("group")))
        blocks = [max(1, -(-c // BLOCK)) for c in counts]
        requests = requests.withColumn("block", F.pmod(F.xxhash64("key"), _number("home", blocks)).cast("int")).withColumnRenamed("home", "group")
        # First round: each row meets the one group that it is nearest to, if the group has anchors.
        own = self.points.where(_number("home", [int(c > 0) for c in counts]) == 1).withColumn("group", F.col("home"))
        probed = materialize(self._best(self._visit(requests, own, blocks, k), k), "probed")
        known = probed.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("known"))
        raised = F.transform(F.col("floors"), lambda f, i: F.greatest(f, F.coalesce(F.element_at("known", i), F.lit(LEAST_LONG))))
        bounded = materialize(requests.join(known, "key", "left").withColumn("floors", raised).drop("known"), "bounded")
        # Second round: each row meets the groups it may serve.
        rings = self.spark.sparkContext.broadcast(self._rings(bounded))
        return self._best(self._visit(bounded, self._served(rings), blocks, k), k)

    def _grouped(self, requests: DataFrame) -> DataFrame:
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                far = shared.value.distances(shared.value.matrix(b.column("vec").to_pylist()), query=True)[:, : shared.value.groups]
                yield b.append_column("home", pa.array(far.argmin(axis=1).astype(np.int32)))

        columns = ["key", "label", "vec", "same", "caps", "floors"]
        return requests.select(*columns).mapInArrow(run, "key binary, label long, vec binary, same boolean, caps array<long>, floors array<long>, home int")

    def _counts(self, rows: DataFrame) -> list[int]:
        """Rows of each group; a number for each of at most MOST_GROUPS groups."""
        found = dict(rows.groupBy("group").count().collect())
        return [found.get(g, 0) for g in range(self.space.groups)]

    def _rings(self, requests: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """For each group and cell the least and greatest distance from the cell's pivot at which a row may serve."""
        shared = self.shared

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            space = shared.value
            for b in batches:
                x = space.matrix(b["vec"])
                far = space.distances(x, query=True)
                floor = np.array([min(f, default=MOST_LONG) for f in b["floors"]], dtype=np.float64)
                reach = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x) + space.longest**2 - 2 * floor, 0)) + SLACK * space.longest
                group = b["group"].to_numpy()
                for g in np.unique(group):
                    at = group == g
                    low, high = (far[at] - reach[at, None]).min(axis=0), (far[at] + reach[at, None]).max(axis=0)
                    yield pd.DataFrame({"group": g, "cell": np.arange(len(low)), "low": low, "high": high})

        found = requests.select("group", "vec", "floors").mapInPandas(run, "group int, cell int, low double, high double")
        rows = found.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        low = np.full((self.space.groups, len(self.space.pivots)), np.inf)
        high = np.full_like(low, -np.inf)
        low[rows["group"], rows["cell"]], high[rows["group"], rows["cell"]] = rows["low"], rows["high"]
        return low, high

    def _served(self, rings) -> DataFrame:
        """Rows with each group that they may serve."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = rings.value
            for b in batches:
                cell, ring = b.column("cell").to_numpy(), b.column("ring").to_numpy()
                group, at = np.nonzero((ring >= low[:, cell]) & (ring <= high[:, cell]))
                yield b.take(pa.array(at)).append_column("group", pa.array(group.astype(np.int32)))

        columns = self.points.select("row", "vec_id", "label", "vec", "cell", "ring")
        return columns.mapInArrow(run, "row long, vec_id long, label long, vec binary, cell int, ring double, group int")

    def _visit(self, requests: DataFrame, rows: DataFrame, blocks: list[int], k: int) -> DataFrame:
        """(key, slot, vec_id, score): of each block of requests and chunk of its group's rows the first k of each slot."""
        shared = self.shared
        counts = self._counts(rows.select("group"))
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        chunk = min(CHUNK, max(LEAST_CHUNK, sum(c * b for c, b in zip(counts, blocks, strict=True)) // tasks))
        chunks = [-(-c // chunk) for c in counts]
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), _number("group", [max(1, c) for c in chunks])).cast("int"))
        dealt = dealt.select("group", "chunk", F.explode(F.sequence(F.lit(0), _number("group", blocks) - 1)).alias("block"), "vec_id", "label", "vec")
        asking = requests.where(_number("group", chunks) > 0).select("group", "block", F.explode(F.sequence(F.lit(0), _number("group", chunks) - 1)).alias("chunk"), "key", "label", "vec", "same", "caps", "floors")
        place = ["group", "block", "chunk"]
        return asking.groupBy(*place).cogroup(dealt.groupBy(*place)).applyInPandas(lambda a, b: _local(shared.value, a, b, k), FOUND)

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        """The first k of each request and slot; what was found twice counts once."""
        order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["key", "slot", "rank"])


def _local(space: Space, asking: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The exact join of a block of requests and a chunk of rows."""
    names = ["key", "slot", "vec_id", "score"]
    rows = rows.drop_duplicates(["vec_id", "label", "vec"]).sort_values("vec_id", kind="stable")
    if not len(asking) or not len(rows):
        return pd.DataFrame([], columns=names)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    spare = len(ids) - len(np.unique(ids))  # equal pairs of id and score need two rows of an id
    x, q = space.matrix(rows["vec"]), space.matrix(asking["vec"])
    if not space.exact:
        x, q = (np.array([[int(v) for v in row] for row in m], dtype=object) for m in (x, q))
    out: list[tuple] = []
    key, label, same, caps, floors = (asking[c].to_numpy() for c in ("key", "label", "same", "caps", "floors"))
    for begin in range(0, len(q), TILE):
        scores = q[begin : begin + TILE] @ x.T
        if not space.exact and any(not LEAST_LONG <= v <= MOST_LONG for v in scores.flat):
            raise ValueError("a score doesn't fit a long")
        for i, score in enumerate(scores, begin):
            fits = np.flatnonzero((labels == label[i]) == same[i])
            s = score[fits] if not space.exact else score[fits].astype(np.int64)
            for slot, (cap, floor) in enumerate(zip(caps[i], floors[i], strict=True)):
                at = np.flatnonzero((s <= int(cap)) & (s >= int(floor)))
                if len(at) > k + spare:
                    at = at[s[at] >= np.partition(s[at], len(at) - k - spare)[len(at) - k - spare]]
                pairs = sorted(set(zip((-s[at]).tolist(), ids[fits[at]].tolist(), strict=True)))[:k]
                out.extend((key[i], slot, vec_id, -minus) for minus, vec_id in pairs)
    return pd.DataFrame(out, columns=names)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    ``anchor`` says which rows are anchors. A negative scores from ``least_percent`` of its positive's score up to all of it.
    """
    spark = rows.sparkSession
    rows = usable(rows.select("vec_id", "label", "embedding"))
    measured = measure(rows, anchor, scale)
    if measured is None or not measured[1]:
        return spark.createDataFrame([], OUTPUT)
    space, anchors = measured
    points = materialize(assign(rows, anchor, space, scale), "points")
    join = Join(points, space)
    # Label and vector as one key; a label is written without a colon.
    key = F.unhex(F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("vec")), 256))
    marked = points.where("is_anchor").withColumn("key", key)
    vectors = materialize(marked.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("n")), "vectors")
    longs = lambda v: F.array(F.lit(v).cast("long"))
    # One more than asked for: an anchor may be among them itself.
    asked = vectors.select("key", "label", "vec", F.lit(True).alias("same"), longs(MOST_LONG).alias("caps"), longs(LEAST_LONG).alias("floors"))
    near = materialize(join.nearest(asked, positives + 1), "near")
    # For each score of a positive: the greatest and least score of its negatives.
    least = F.expr(f"cast((cast(score as decimal(38, 0)) * {least_percent} + 99) div 100 as long)")
    limits = near.where("score >= 0").select("key", "score", least.alias("least")).where("least <= score").distinct()
    limits = limits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("score").alias("cap"), "least"))).alias("limits"))
    asked = vectors.join(limits, "key").select("key", "label", "vec", F.lit(False).alias("same"), F.col("limits.cap").alias("caps"), F.col("limits.least").alias("floors"))
    asked = materialize(asked, "asked")
    far = join.nearest(asked, negatives).join(asked.select("key", "caps"), "key")
    far = far.select("key", F.element_at("caps", F.col("slot") + 1).alias("score"), F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).alias("negative"))
    # One row for each positive of a vector, with its few negatives.
    lists = near.join(far.groupBy("key", "score").agg(F.collect_list("negative").alias("negatives")), ["key", "score"], "left").select("key", "vec_id", "score", "negatives")
    lists = lists.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score", "negatives"))).alias("positives"))
    return _given_out(marked.select("key", "vec_id", "vec").distinct(), vectors, lists, space, anchors, positives)


def _given_out(marked: DataFrame, vectors: DataFrame, lists: DataFrame, space: Space, anchors: int, positives: int) -> DataFrame:
    """Each anchor takes the lists of its vector, without itself."""
    # At most a thousand vectors have more than a thousandth of the anchors.
    hot = vectors.where(F.col("n") > max(HOT_ANCHORS, anchors // 1000)).select("key", F.lit(SALTS).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    asking = marked.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts))
    lists = lists.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
    given = asking.join(lists.select("key", "salt", "positives"), ["key", "salt"])
    own = _squared(space)("vec")
    others = F.filter("positives", lambda p: ~((p["vec_id"] == F.col("anchor_id")) & (p["score"] == F.col("own"))))
    given = given.select(F.col("vec_id").alias("anchor_id"), own.alias("own"), "positives").select("anchor_id", F.explode(F.slice(others, 1, positives)).alias("p"))
    given = given.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.negatives").alias("n"))
    return given.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.negative_id").alias("negative_id"), "positive_score", F.col("n.negative_score").alias("negative_score"))


def _squared(space: Space):
    """A vector's product with itself, as a long."""

    def run(vec: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(vec), dtype=space.stored).astype(np.float64).reshape(len(vec), -1)
        if space.exact:
            return pd.Series(np.einsum("ij,ij->i", x, x).astype(np.int64))
        return pd.Series([min(sum(int(v) ** 2 for v in row), MOST_LONG) for row in x])

    return F.pandas_udf(run, "long")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def negatives_sql() -> str:
    """The same rows by scores of all pairs."""
    product = "list_inner_product(a.v, b.v)::bigint"
    return f"""WITH r AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {product} AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= {NEGATIVES}"""
