"""What line dedup leaves on disk, and its forms for tables beyond the limits of broadcasts and buckets."""

import os
import random
import time

from pyspark.sql import functions as F

from textloom.llm import lines
from textloom.llm.common import materialize


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark):
    before = shuffle_files(spark)
    out = materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counted")
    ended = time.time() + 20
    while shuffle_files(spark) - before and time.time() < ended:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and out.count() == 100


def test_lines_are_read_again_by_ids_in_parts(spark, monkeypatch):
    """Ids beyond what may be broadcast: no text is shuffled, no part has too many."""
    rows = spark.range(0, 2000, 1, 4).select(F.monotonically_increasing_id().alias("id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    rows = materialize(rows, "rows")
    ids = materialize(rows.where(F.xxhash64("id") % 3 == 0).select("id"), "ids")
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(lines, "BLOCK_BITS", 5)
    parts = lines.chosen(rows, ids)
    sizes = [p.count() for p in parts]
    assert len(sizes) > 5 and max(sizes) <= 100 and sum(sizes) == ids.count()
    got = [tuple(r) for p in parts for r in p.collect()]
    assert sorted(got) == sorted(tuple(r) for r in rows.join(ids, "id", "left_semi").collect())
    for p in parts:
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_beyond_all_limits_the_result_is_the_same_and_little_is_left(spark, monkeypatch):
    rnd, made = random.Random(8), []
    for i in range(600):
        passage = "this licence covers the work named below and " + "what comes with it as " * (i % 3)
        made.append(made[-1][:-1] + rnd.choice("xyz") if i % 5 == 4 else passage + "".join(rnd.choices("abcdefghij ", k=13)))
    docs = spark.createDataFrame([(i, "\n".join(made[3 * i : 3 * i + 3])) for i in range(200)], "doc_id long, text string")
    want = {r["doc_id"]: (r["n_removed"], r["text"]) for r in lines.dedup_lines(docs).collect()}
    assert sum(n for n, _ in want.values()) > 60
    for name, value in (("BROADCAST_ROWS", 40), ("BLOCK_BITS", 4), ("MANY", 4), ("CROWD", 40), ("PARTED_ROWS", 500), ("PAIRS_AT_ONCE", 5)):
        monkeypatch.setattr(lines, name, value)
    scratch = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/textloom"
    before = set(os.listdir(scratch))
    out = lines.dedup_lines(docs)
    new = set(os.listdir(scratch)) - before
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in out.collect()} == want
    # Lines, signatures and members of buckets are no longer there; what the result is made of is.
    assert not {n for n in new if n.startswith(("lines-", "members-", "shared-", "texts-", "hashed-", "parted-"))}, new
    assert any(n.startswith("again-") for n in new)


def test_rows_of_a_stage_go_when_the_next_has_its_own(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda s, d, _, k=k: d.where(F.col("doc_id") >= k)) for k in range(4)])
    scratch = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/textloom"
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [n[:7] for n in os.listdir(scratch) if n.startswith("stage-")] == ["stage-3"]
    assert out.count() == 17 and spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 20
