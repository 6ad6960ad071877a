"""What a task holds doesn't grow with the table, and nothing is shuffled or parsed twice without need."""

import unicodedata

from textloom import scratch
from textloom.functions.text import tokenize
from textloom.operators import identifiers, retrieval, stored_index, structure


def plan(df):
    return df._jdf.queryExecution().toString()


def test_tasks_by_bytes_of_text(spark, monkeypatch):
    monkeypatch.setattr(scratch, "PART_BYTES", 1000)
    docs = spark.range(200).selectExpr("id as doc_index", "repeat('some words here ', 10) as text")
    assert retrieval.term_counts(docs).rdd.getNumPartitions() == 32
    texts = docs.withColumnsRenamed({"doc_index": "key"})
    assert identifiers.identifier_counts(texts).rdd.getNumPartitions() == 32
    # Rows of a repeated key are still counted together, and nothing is lost where there are no rows.
    twice = retrieval.term_counts(docs.unionByName(docs))
    assert {r["tf"] for r in twice.collect()} == {20} and twice.count() == 600
    assert retrieval.term_counts(docs.where("false")).count() == 0


def test_tokens_are_split_before_they_are_lower_cased(spark):
    texts = ["Aİb ÇΣ ΑΣ ςa", "STRASSE ẞx Ⅷ ⓐⒶ K", "", None, "--", "İ", "ΟΔΟΣ-Σ", *(f"A{chr(c)}B Σ{chr(c)}" for c in range(0x10000) if not 0xD800 <= c < 0xE000)]
    parts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    from pyspark.sql import functions as F

    from textloom.functions.text import SEPARATOR

    before = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), SEPARATOR), lambda t: F.replace(F.lower(t), F.lit("ς"), F.lit("σ"))), lambda t: t != "")
    assert [r["text"] for r in parts.where(tokenize("text") != before).collect()] == []
    assert unicodedata.lookup("LATIN CAPITAL LETTER I WITH DOT ABOVE") == "İ"


def test_one_query_needs_no_postings(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} the {'the ' * (i % 3)}") for i in range(60)] + [(60, None), (61, "")], "doc_index long, text string")
    lazy, kept = retrieval.TfIdfIndex.build(docs, persist=False), retrieval.TfIdfIndex.build(docs)
    for query in ("word3 the word1", "none of these", "", "word3 word3 the"):
        got = lazy.retrieve(query, 70)
        assert got.collect() == kept.retrieve(query, 70).collect()
        assert "windowspecdefinition(doc_index" not in plan(got)
    kept.unpersist()


def test_all_postings_need_no_norms_on_disk(spark):
    index = stored_index.StoredIndex.open(spark, scratch.path(spark, "sizes"))
    index = index.refresh(spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "doc_index long, text string"))
    index = index.refresh(spark.createDataFrame([(2, "b d")], "doc_index long, text string"), spark.createDataFrame([(3,)], "doc_index long"))
    got = index.postings()
    assert "norm-" not in plan(got) and f"norms-{index.number:012d}" not in scratch_names(spark, index.path)
    want = retrieval.TfIdfIndex.build(index.texts, persist=False).postings
    rows = lambda df: sorted((r["doc_index"], r["token"], r["tf"], round(r["w"], 9)) for r in df.collect())
    assert rows(got) == rows(want) == rows(index.postings(["a", "b", "c", "d"]))


def scratch_names(spark, path):
    from textloom.sources import store

    return store.names(spark, path)


def test_records_parse_files_once(spark):
    files = spark.createDataFrame([("a.py", "/a.py", "py", 40, "class A:\n    x = 1\n\ndef run(a):\n    return a\n")], "rel string, abs_path string, lang string, size int, content string")
    out = structure.records(files, "/data").where("type != 'file'")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {(r["id"], r["type"], r["class_name"], r["function"]) for r in out.collect()} == {("a.py.A.class", "class", "A", None), ("a.py.run", "function", None, "run")}
