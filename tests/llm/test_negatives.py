"""Hard negatives against scores of all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import negatives
from textloom.llm.registry import ORACLES, QUERIES

SCHEMA = "vec_id long, label int, embedding array<float>, row long, cell int, key string, score string, home int, slot int, caps int"


def table(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, 2, "k", "s", 3, 4, 5) for i, y, v in rows], SCHEMA)


def usable(rows):
    for i, y, v in rows:
        if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            yield i, y, tuple(math.floor(256 * float(np.float32(c))) for c in v)


def plain(rows, every=10, positives=5, count=5, least=80):
    """Set semantics: repeated rows once, each pair of id and score once."""
    rows = sorted(set(usable(rows)))
    out = set()
    for a, y, v in rows:
        if a % every:
            continue
        score = lambda w, v=v: sum(p * q for p, q in zip(v, w, strict=False))
        same = sorted({(-score(w), i) for i, z, w in rows if z == y} - {(-score(v), a)})[:positives]
        other = sorted({(-score(w), i) for i, z, w in rows if z != y})
        for p, i in same:
            fits = [(n, j) for n, j in other if -least * p <= -100 * n <= -100 * p][:count]
            out |= {(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fits, 1)}
    return out


def mined(spark, rows, **kw):
    got = [tuple(r) for r in negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, **kw).collect()]
    return got


def vectors(rnd, n, dims, spread=1.0):
    centers = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, rnd.randrange(3), [c + rnd.gauss(0, spread) for c in centers[rnd.randrange(6)]]) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "spread"), [(400, 5, 0.3), (300, 12, 2.0), (200, 1, 1.0)])
def test_random_vectors(spark, monkeypatch, n, dims, spread):
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 6)  # several groups
    rows = vectors(random.Random(n), n, dims, spread)
    got = mined(spark, rows)
    assert set(got) == plain(rows) and len(got) == len(set(got)) and got


def test_edges(spark, monkeypatch):
    """Nulls, values that aren't finite, lists of other lengths, ties, repeated rows and ids."""
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 2, [1.0, 0.5]) for i in range(0, 60)]  # ties everywhere
    rows += [(i, i % 3, [1.0, 0.5]) for i in range(10, 30)]  # ids twice, labels may differ
    rows += [(20, 0, [0.9, 0.5]), (20, 0, [0.9, 0.5]), (30, 1, [0.9])]
    rows += [(None, 1, [1.0, 1.0]), (70, None, [1.0, 1.0]), (80, 1, None), (90, 1, [1.0, None]), (100, 0, [nan, 1.0]), (110, 1, [inf, 1.0]), (120, 0, [-inf])]
    rows += [(130, 1, []), (140, 0, [-5.0, -5.0]), (150, 0, [0.0, 0.0]), (155, 1, [0.0, 0.0]), (160, 1, [1.0, 0.5, 0.25])]
    got = mined(spark, rows)
    assert set(got) == plain(rows) and len(got) == len(set(got))
    assert {r[0] for r in got} >= {0, 10, 20, 150}


def test_copies_of_one_vector(spark, monkeypatch):
    """A third of the rows are one vector, half of the anchors too; blocks, chunks and copied lists are small."""
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 5)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "CHUNK", 40)
    monkeypatch.setattr(negatives, "LEAST_CHUNK", 7)
    monkeypatch.setattr(negatives, "HOT_ANCHORS", 2)
    rnd = random.Random(8)
    rows = vectors(rnd, 300, 4)
    rows += [(i, 1 + (i % 5 == 0), [0.5, 0.25, 0.1, 0.9]) for i in range(300, 450)]
    got = mined(spark, rows)
    assert set(got) == plain(rows) and len(got) == len(set(got))


@pytest.mark.parametrize("factor", [3000.0, 3e5, 1.5e6])
def test_large_components(spark, factor):
    """Products beyond 2^53 stay whole."""
    rows = [(i, y, [c * factor for c in v[:2]]) for i, y, v in vectors(random.Random(4), 60, 3)]
    assert set(mined(spark, rows)) == plain(rows)


def test_scores_beyond_a_long(spark):
    rows = [(i, i % 2, [1e30, 2e30]) for i in range(12)]
    with pytest.raises(Exception, match="long"):
        mined(spark, rows)


def test_other_settings(spark):
    rows = vectors(random.Random(3), 150, 3)
    got = mined(spark, rows, positives=2, negatives=3, least_percent=95)
    assert set(got) == plain(rows, positives=2, count=3, least=95)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(10, 1, [1.0])], [(10, None, None)], [(10, 1, []), (20, 1, []), (3, 2, [])]])
def test_few_rows(spark, rows):
    got = mined(spark, rows)
    assert set(got) == plain(rows)


def test_bounds_keep_far_groups_apart(spark, monkeypatch):
    """Where vectors lie in clusters, most rows go to few groups; none that is needed is left out."""
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 4)
    rnd = random.Random(6)
    centers = np.array([[math.cos(a), math.sin(a)] for a in np.arange(12) * math.pi / 6]) * 20
    rows = [(i, rnd.randrange(2), [float(c) + rnd.gauss(0, 0.05) for c in centers[rnd.randrange(12)]]) for i in range(1200)]
    sent = []
    served = negatives.Join._served
    monkeypatch.setattr(negatives.Join, "_served", lambda self, rings: sent.append((self, served(self, rings))) or sent[-1][1])
    assert set(mined(spark, rows)) == plain(rows)
    for join, out in sent:
        assert join.space.groups > 5 and out.count() < 0.5 * join.space.groups * len(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = c.sql(ORACLES["op13_hard_negatives"]).df()
    got = QUERIES["op13_hard_negatives"](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(x[want.columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want) and len(want)
