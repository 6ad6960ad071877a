"""Connected components of links between ids, by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def forest(links: DataFrame) -> DataFrame:
    """Each partition's links (a, b) as a forest of stars (id, its root): at most a row for each id.

    It only saves rounds: what a partition joins is joined in the whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        rows = [(x, root(x)) for x in up]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(run, "a long, b long")


def components(links: DataFrame, native: bool = False, rounds: int = 60) -> DataFrame:
    """(id, root) for every id that has a link to another one; the root is the smallest id of its component.

    Rounds of two steps. Large star: every id links its larger neighbours to the smallest
    id it knows. Small star: every id links itself and its smaller neighbours to it. Minima are
    aggregated and joined back, so that a hub's links never meet in one task. It ends when
    a round changes nothing: then every id is linked with its root alone.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize((edges if native else forest(edges)).distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = edges.select(b.alias("u"), a.alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Those at the smaller end of no link keep what is linked to them through the larger one.
        large = large.where("a != b").distinct()
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smaller, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct(a, F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialize(small.where("a != b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components haven't settled")
    return edges.select(a.alias("id"), b.alias("root"))
