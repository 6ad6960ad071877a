"""Batches by bounds against scores of all pairs, and stored indices against those built anew."""

import random

import pytest

from textloom.operators import stored_index
from textloom.operators.retrieval import TfIdfIndex
from textloom.operators.stored_index import StoredIndex
from textloom.sources import store

WORDS = ["the", "of", "and", *[f"w{i}" for i in range(120)]]


def texts(rnd, n, common=6):
    return [(i, " ".join(rnd.choices(WORDS[:3], k=common) + rnd.choices(WORDS[3:], [1 / (j + 1) for j in range(120)], k=rnd.randrange(1, 20)))) for i in range(n)]


def plain_best(index, queries, k):
    """The k best of each query from the scores of all pairs, filled up by index."""
    scores = {}
    weights = {}
    for r in index.postings.collect():
        weights.setdefault(r["token"], []).append((r["doc_index"], r["w"]))
    for r in index.query_weights(queries).collect():
        for d, w in weights.get(r["token"], []):
            scores[r["query_id"], d] = scores.get((r["query_id"], d), 0) + w * r["qw"]
    docs = [r[0] for r in index.docs.select("doc_index").collect()]
    return {q: sorted((-round(scores.get((q, d), 0.0), 6), d) for d in docs)[:k] for (q,) in queries.select("query_id").distinct().collect()}


def given(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["doc_index"], r["rank"]))
    return {q: [(s, d) for s, d, _ in sorted(v, key=lambda x: x[2])] for q, v in out.items()}


@pytest.mark.parametrize("k", [1, 3, 10])
def test_batches_by_bounds(spark, k):
    rnd = random.Random(k)
    index = TfIdfIndex.build(spark.createDataFrame(texts(rnd, 300), "doc_index long, text string"))
    asked = [(i, t) for i, t in texts(rnd, 25, 3)] + [(90, ""), (91, "unknown"), (92, None), (93, "the of"), (94, "w5"), (94, "w6")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got, want = given(index.retrieve_batch(queries, k)), plain_best(index, queries, k)
    assert {q: [d for _, d in v] for q, v in got.items()} == {q: [d for _, d in v] for q, v in want.items()}
    assert all(abs(a[0] - b[0]) < 2e-6 for q in want for a, b in zip(got[q], want[q], strict=True))
    index.unpersist()


def test_few_pairs_are_scored(spark):
    """Common words are in all documents: a join of their postings would give every pair."""
    rnd = random.Random(1)
    docs = [(i, f"the of and the {' '.join(rnd.choices(WORDS[3:], k=4))} x{i % 100} y{i % 97}") for i in range(1500)]
    index = TfIdfIndex.build(spark.createDataFrame(docs, "doc_index long, text string"))
    queries = spark.createDataFrame([(i, f"the of and x{i} y{i}") for i in range(40)], "query_id long, text string")
    pairs = index.postings.join(index.query_weights(queries), "token").select("query_id", "doc_index").distinct().count()
    kept, rest = index.candidates(queries, 3)
    assert pairs == 1500 * 40 and kept.count() < pairs / 40 and rest.count()
    assert {q: [d for _, d in v] for q, v in given(index.retrieve_batch(queries, 3)).items()} == {q: [d for _, d in v] for q, v in plain_best(index, queries, 3).items()}
    index.unpersist()


def rows(df):
    return sorted((r["doc_index"], r["token"], r["tf"], round(r["w"], 9)) for r in df.collect())


def test_refreshes_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(2)
    path, now = f"file://{tmp_path}/index", {}
    index = StoredIndex.open(spark, path)
    assert not index.documents and not index.postings().count()
    for step in range(10):
        new = {rnd.randrange(30): t for _, t in texts(rnd, rnd.randrange(6))} | ({7: None} if step == 4 else {})
        gone = [rnd.randrange(30) for _ in range(rnd.randrange(4))]
        removed = spark.createDataFrame([(i,) for i in gone], "doc_index long") if gone else None
        index.refresh(spark.createDataFrame(list(new.items()), "doc_index long, text string"), removed)
        now = {i: t for i, t in now.items() if i not in gone} | new
        index = StoredIndex.open(spark, path)
        assert index.documents == len(now)
        if step == 6:
            index = index.compact()
            index.vacuum()
            assert len(index.generations) == 1
    rebuilt = TfIdfIndex.build(spark.createDataFrame(list(now.items()), "doc_index long, text string"))
    assert rows(index.postings()) == rows(rebuilt.postings)
    assert sorted(map(tuple, index.texts.collect())) == sorted((i, t or "") for i, t in now.items())
    for question in ("w1 the w9", "w3", "nothing", ""):
        assert [tuple(r) for r in index.retrieve(question, 4).collect()] == [tuple(r) for r in rebuilt.retrieve(question, 4).collect()]
    few = index.postings(["w1", "w2"])
    assert rows(few) == [r for r in rows(rebuilt.postings) if r[1] in ("w1", "w2")]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert any("bucket" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    again = stored_index.build(spark.createDataFrame([(1, "new words")], "doc_index long, text string"), path)
    assert again.documents == 1 and [r["token"] for r in again.postings().orderBy("token").collect()] == ["new", "words"]


def test_a_failed_refresh_leaves_the_version(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = StoredIndex.open(spark, path).refresh(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_index long, text string"))
    bad = spark.createDataFrame([(3, "c")], "doc_index long, text string").selectExpr("doc_index", "if(doc_index = 3, raise_error('lost'), text) as text")
    with pytest.raises(Exception, match="lost"):
        index.refresh(bad)
    assert StoredIndex.open(spark, path) == index and StoredIndex.open(spark, path).texts.count() == 2
    index.refresh(spark.createDataFrame([(4, "d")], "doc_index long, text string"))
    with pytest.raises(FileExistsError):  # made from a version that isn't the current one any more
        index.refresh(spark.createDataFrame([(5, "e")], "doc_index long, text string"))
    assert store.current(spark, path)["number"] == 2
