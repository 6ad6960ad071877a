"""A stored index keeps counts and norms, not postings or their shuffles."""

import random

from textloom.operators import retrieval


def test_a_stored_index_in_slices(spark, monkeypatch):
    """Norms beyond what may be broadcast: the same answers, no cached rows, and no posting is shuffled for them."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(300)], k=40))) for i in range(400)], "doc_index long, text string")
    queries = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=6))) for i in range(12)], "query_id long, text string")
    best = lambda index: sorted(tuple(r) for r in index.retrieve_batch(queries, 3).collect())
    want = best(retrieval.TfIdfIndex.build(docs, persist=False))
    index = retrieval.TfIdfIndex.build(docs)
    assert best(index) == want and len(want) == 36
    monkeypatch.setattr(retrieval, "BROADCAST_DOCS", 50)
    assert len(index._slices()) == 8 and sum(counts.count() for counts, _ in index._slices()) == index.counts.count()
    assert best(index) == want
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
    weights = {(r["doc_index"], r["token"]): r["w"] for r in retrieval.weighted(index.counts, index.idf).collect()}
    assert all(abs(weights[r["doc_index"], r["token"]] - r["w"]) < 1e-12 for r in index.postings.collect())
    index.unpersist()
