"""Corpora in buckets: what a refresh writes, what a failure leaves, and a stream that is killed between batches."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import merge
from textloom.sources import corpus
from textloom.sources.partitioned import PartitionedCorpus, refresh
from textloom.streaming import refresh as streaming

FILES = "rel string, abs_path string, lang string, size long, content string, error string, mtime double"


def files(spark, texts, at=0.0):
    return spark.createDataFrame([(r, f"/t/{r}", "py", len(t or ""), t, None if t is not None else "OSError", at) for r, t in texts.items()], FILES)


def source(i, n=1):
    return "".join(f"class C{i}x{k}:\n    def f{k}(self):\n        return {i}\n\n" for k in range(n))


def lines(target):
    return [json.loads(r["json"])["id"] for r in target.lines().orderBy("section", "ord", "sub").collect()]


def digests(path):
    return {os.path.join(d, f): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    texts = {f"d/{i}.py": source(i) for i in range(12)}
    first, _ = refresh(files(spark, texts), PartitionedCorpus.open(spark, path, 16), "/t")
    before, folders = digests(tmp_path / "corpus"), dict(first.folders)
    assert first.entries().count() == 36 and first.number == 1
    texts["d/3.py"] = source(3, 2)
    second, _ = refresh(files(spark, texts), first, "/t")
    after = digests(tmp_path / "corpus")
    assert all(after[f] == h for f, h in before.items())
    changed = {b for b in folders if second.folders[b] != folders[b]}
    assert len(changed) == 1 and second.entries().count() == 38
    ids = lines(second)
    assert ids[-5:] == ["d/3.py.file", "d/3.py.C3x0.class", "d/3.py.C3x1.class", "d/3.py.f0", "d/3.py.f1"] and len(ids) == 38  # kept first, then new ones
    same, _ = refresh(files(spark, texts), second, "/t")
    assert same.folders == second.folders
    back = same.restore(1)
    assert back.folders == folders and lines(back) == lines(first)
    back.vacuum()
    assert lines(PartitionedCorpus.open(spark, path)) == lines(first) and not digests(tmp_path / "corpus").keys() - before.keys()


def test_order_and_prefixes_are_those_of_the_merge(spark, tmp_path):
    """Random refreshes, with a path that begins another one, against the plain merge of lines."""
    rnd = random.Random(3)
    target = PartitionedCorpus.open(spark, f"file://{tmp_path}/corpus", 8)
    existing = spark.createDataFrame([], "pos long, id string, hash string, json string")
    names = ["a", "a.b", "a.b.c", "x", "y.py", "z"]
    for step in range(4):
        processed = spark.createDataFrame([(f"{n}.file",) for n in rnd.sample(names, 3)], "id string")
        rows = [(f"/t/{n[:-5]}", k, n[:-5], n if k == 0 else f"{n[:-5]}.f{k}", f"h{step}", json.dumps({"id": n if k == 0 else f"{n[:-5]}.f{k}", "hash": f"h{step}", "step": step})) for (n,) in processed.collect() for k in range(3)]
        new = spark.createDataFrame(rows, "abs_path string, ordinal long, path string, id string, hash string, json string")
        tree = spark.createDataFrame([(json.dumps({"id": "__TREE__", "hash": None, "step": step}),)], "json string")
        target = target.commit(processed, new, tree)
        out = [r["json"] for r in merge.merge(existing, processed, new, tree).orderBy("section", "ord", "sub").collect()]
        assert [r["json"] for r in target.lines().orderBy("section", "ord", "sub").collect()] == out
        body = [(p, json.loads(j)["id"], f"h{step}", j) for p, j in enumerate(out) if json.loads(j)["id"] != "__TREE__"]
        existing = spark.createDataFrame(body, "pos long, id string, hash string, json string")
    target.export(f"file://{tmp_path}/lines")
    assert [r["json"] for r in corpus.load_entries(spark, f"file://{tmp_path}/lines").orderBy("pos").collect()] == [j for *_, j in body]


def test_a_failed_write_leaves_the_corpus(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    good, _ = refresh(files(spark, {"a.py": source(1), "b.py": source(2)}), PartitionedCorpus.open(spark, path, 4), "/t")
    bad = files(spark, {"a.py": source(9)}).withColumn("content", F.when(F.col("rel") == "a.py", F.raise_error(F.lit("disk full"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="disk full"):
        refresh(bad, good, "/t")
    assert PartitionedCorpus.open(spark, path) == good and len(lines(good)) == 6


def test_pruning_and_errors(spark, tmp_path):
    target, _ = refresh(files(spark, {"a.py": source(1), "b.py": source(2)}), PartitionedCorpus.open(spark, f"file://{tmp_path}/c", 4), "/t")
    listed = spark.createDataFrame([("a.py.file",)], "id string")
    target, errors = refresh(files(spark, {"a.py": source(1), "n.py": None}), target, "/t", listed=listed)
    assert set(lines(target)) == {"a.py.file", "a.py.C1x0.class", "a.py.f0"} and [tuple(r) for r in errors.collect()] == [("n.py", "OSError")]


def test_a_stream_that_is_killed_gives_the_same_corpus(spark, tmp_path, monkeypatch):
    """The query dies after a batch was committed and before Spark knows it, and once before the commit."""
    versions = [{f"{i}.py": source(i) for i in range(4)}, {"1.py": source(1, 2), "5.py": source(5)}, {"1.py": source(1), "0.py": source(0)}]
    for n, texts in enumerate(versions):
        files(spark, texts, float(n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if not f.name.startswith("seen"):
                os.utime(f, (1_000_000 + n, 1_000_000 + n))
                f.rename(f.with_name(f"seen-{n}.parquet"))
    commit, deaths = PartitionedCorpus.commit, {"after": 1, "before": 2}

    def dying(self, *args, stream=None, **kw):
        args = list(args)
        batch = (args[4] if len(args) > 4 else stream)[1]
        if deaths.get("before") == batch:
            del deaths["before"]
            raise RuntimeError("killed before")
        out = commit(self, *args, **({"stream": stream} if stream else {}), **kw)
        if deaths.get("after") == batch:
            del deaths["after"]
            raise RuntimeError("killed after")
        return out

    monkeypatch.setattr(PartitionedCorpus, "commit", dying)
    path = f"file://{tmp_path}/corpus"
    runs = 0
    for runs in range(1, 6):
        stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = streaming.refresh_stream(stream, path, "/t", buckets=4).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(100)
            break
        except Exception as e:
            assert "killed" in str(e)
    assert runs == 3 and not deaths
    got = PartitionedCorpus.open(spark, path)
    monkeypatch.setattr(PartitionedCorpus, "commit", commit)
    want = PartitionedCorpus.open(spark, f"file://{tmp_path}/plain", 4)
    for texts in versions:
        want, _ = refresh(files(spark, texts), want, "/t")
    assert lines(got) == lines(want) and got.number == want.number == 3
