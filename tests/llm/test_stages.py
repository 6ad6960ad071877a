"""Each stage of the pipeline, and all of it, on rows that are null, empty, long or repeated, with columns of clashing names, and on empty tables."""

import pytest

import corpus_pipeline

EXTRA = "score double, matches string, id long, label int, key string, root long, toxic boolean, line string, bands string, a int, b int, n int, item_id int, ids string, toxicity double, n_removed int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
PASSAGE = " ".join(f"benchmark{i} question{i % 7} answer{i % 5}" for i in range(30))
TEXTS = [
    (3, "alpha beta gamma delta epsilon zeta eta theta"), (4, "other words stand here and there in a row of ten"), (4, "other words stand here and there in a row of ten"), (5, None), (6, ""),
    (None, "nobody's text, it is here for once and never again"), (7, "one"), (8, "é😀 ▁ <|endoftext|> x"), (9, "lorem ipsum dolor " * 9000), (10, f"so it goes {PASSAGE} and so on"), (11, " \n\t "),
]


def write(spark, path, rows, labels, items):
    spark.createDataFrame([(i, t, "en", None, None, 1.0, "m", 5, None, "k", 1, True, "l", "b", 1, 2, 3, 4, "x", 0.5, 6) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    write(spark, root / "full", TEXTS, [(3, 1, 0), (4, 1, 0), (5, 0, None), (None, 1, 1), (8, 0, 1)], [(1, PASSAGE), (2, None), (3, ""), (3, PASSAGE)])
    write(spark, root / "bare", TEXTS, [], [])
    write(spark, root / "none", [], [], [])
    return {name: str(root / name) for name in ("full", "bare", "none")}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("folder", ["full", "bare", "none"])
def test_stages(spark, folders, number, folder):
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.read.parquet(f"{folders[folder]}/documents.parquet")
    out = stage(spark, docs, folders[folder])
    rows = out.collect()
    if number < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    if folder == "none":
        assert not rows
        return
    ids = {r["doc_id"] for r in rows}
    assert {3, 4, 7, 8, 9} <= ids or name == "toxicity" and folder == "full"
    if name == "benchmark decontamination":
        assert (10 in ids) == (folder == "bare")
    if name == "MinHash near-dedup":
        assert sum(r["doc_id"] == 4 for r in rows) == 1


def test_pipeline_on_empty_tables(spark, folders):
    assert not corpus_pipeline.run(spark, folders["none"]).count()
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, folders["bare"]).collect()}
    assert {3, 4, 7, 8, 9, 10} <= kept
