import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import events
from textloom.operators.retrieval import TfIdfIndex
from textloom.operators.rules import Context, Rule, RuleEngine
from textloom.streaming.accounts import guarded_in_order, guarded_stream, side_output, use_rocksdb

COMMANDS = "account_id string, seq long, type string, amount decimal(18,2)"


def model(rows):
    balance, out = {}, []
    for a, q, kind, amount in sorted(rows, key=lambda r: (r[0], r[1])):
        b = balance.get(a, 0)
        ok = amount > 0 and (kind == "deposit" or b >= amount)
        balance[a] = b + (amount if kind == "deposit" else -amount) if ok else b
        out.append((a, q, ok, float(balance[a])))
    return out


def rows_of(df):
    return sorted((r["account_id"], r["seq"], r["accepted"], float(r["balance"])) for r in df.collect())


def sample():
    r = random.Random(3)
    return [(f"a{r.randrange(4)}", i, r.choice(["deposit", "withdraw"]), r.choice([-5, 0, 1, 3, 10])) for i in range(200)]


def test_guarded(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "account_id string, seq long, type string, amount int")
    assert rows_of(events.guarded(df)) == model(rows)
    assert events.guarded(df.where("false")).count() == 0


@pytest.mark.parametrize("pieces", [5_000, 1])
def test_an_account_over_many_segments(spark, monkeypatch, pieces):
    """One account has nearly all commands; with one piece a map, nearly every segment is folded in its turn."""
    monkeypatch.setattr(events, "MOST_PIECES", pieces)
    r = random.Random(11)
    rows = [("big" if r.random() < 0.95 else f"a{r.randrange(6)}", i, r.choice(["deposit", "withdraw", "withdraw"]), r.choice([-5, 0, 1, 3, 10, 40])) for i in range(600)]
    rows += [(None, 1, "deposit", 5), ("zero", 1, "withdraw", None)]
    df = spark.createDataFrame(rows, "account_id string, seq long, type string, amount int")
    got = rows_of(events.guarded(df, segment_rows=60))
    assert got == model([(a, q, k, m or 0) for a, q, k, m in rows if a])


def test_balance_maps_are_folds():
    r = random.Random(2)
    for _ in range(200):
        low = r.randrange(20)
        m = events.BalanceMap(low, low + r.randrange(60))
        run = [(r.choice(["deposit", "withdraw"]), r.randrange(-2, 30)) for _ in range(r.randrange(40))]
        for kind, amount in run:
            m.then(kind, amount)
        for b in range(low, m.high + 1):
            after = b
            for kind, amount in run:
                after = events.decide(after, kind, amount)[1]
            assert m(b) == after


def test_versions_and_snapshots(spark):
    r = random.Random(5)
    log = [(f"a{r.randrange(3)}", r.choice(["deposit", "withdraw"]), r.randrange(1, 100)) for _ in range(200)]
    numbered, balance = [], {}
    for a, kind, amount in log:
        version = max((v for b, v in balance if b == a), default=0) + 1
        balance[a, version] = balance.get((a, version - 1), 0) + (amount if kind == "deposit" else -amount)
        numbered.append((a, version, kind, amount))
    df = spark.createDataFrame(numbered, "account_id string, version long, type string, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    taken = events.snapshots(df.where("version <= 35"), 7)
    assert {(x["account_id"], x["version"]): float(x["balance"]) for x in taken.collect()} == {k: v for k, v in balance.items() if k[1] % 7 == 0 and k[1] <= 35}
    more = events.extend_snapshots(taken, df, 7)
    whole = taken.unionByName(more)
    assert {(x["account_id"], x["version"]): float(x["balance"]) for x in whole.collect()} == {k: v for k, v in balance.items() if k[1] % 7 == 0}
    asks = [(i, f"a{r.randrange(4)}", r.randrange(-1, 90)) for i in range(150)]
    wanted = spark.createDataFrame(asks, "request long, account_id string, version long")
    want = {i: (0.0 if v == 0 and a != "a3" else balance.get((a, v))) for i, a, v in asks}
    for shots in (taken, whole, taken.where("version != 14"), taken.where("false")):
        got = {x["request"]: None if x["balance"] is None else float(x["balance"]) for x in events.at_versions(df, shots, wanted, 7).collect()}
        assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rows = sample()
    df = spark.createDataFrame(rows, "account_id string, seq long, type string, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    for k in range(2):
        df.where(f"seq div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = guarded_stream(stream).writeStream.format("memory").queryName("accounts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(rows_of(spark.table("accounts"))) == 200
    assert rows_of(spark.table("accounts")) == model(rows)


def put(spark, path, rows):
    df = spark.createDataFrame(rows, "account_id string, seq long, type string, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    df.coalesce(1).write.mode("append").parquet(str(path))


def in_order(spark, tmp_path, name, patience):
    use_rocksdb(spark)
    (tmp_path / name).mkdir(exist_ok=True)
    stream = guarded_in_order(spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)), patience)
    return stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state"))


def test_shuffled_stream_equals_batch(spark, tmp_path):
    """Commands of several accounts come in any order over three micro-batches, each run after a restart."""
    rows, seen = [], {}
    for a, _, kind, amount in sample():
        seen[a] = seen.get(a, 0) + 1
        rows.append((a, seen[a], kind, amount))
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    for part in (shuffled[:70], shuffled[70:110], shuffled[110:]):
        put(spark, tmp_path / "shuffled", part)
        assert in_order(spark, tmp_path, "shuffled", None).trigger(availableNow=True).start().awaitTermination(100)
    decided, side = side_output(spark.read.parquet(str(tmp_path / "shuffled-out")))
    assert rows_of(decided) == model(rows) and not side.count()


def test_gaps_are_given_up(spark, tmp_path):
    first = [("a", 1, "deposit", 10), ("a", 4, "withdraw", 3), ("a", 5, "withdraw", 30), ("b", 1, "deposit", 2), ("a", 5, "deposit", 9)]
    query = in_order(spark, tmp_path, "gaps", 0.01).trigger(processingTime="100 milliseconds").start()
    rows = lambda: spark.read.parquet(str(tmp_path / "gaps-out")).count() if (tmp_path / "gaps-out/_spark_metadata/0").exists() else 0
    try:
        for part, enough in ((first, 7), ([("b", 2, "withdraw", 1)], 8), ([("a", 2, "deposit", 100), ("a", 6, "deposit", 1), ("b", 2, "deposit", 8)], 11)):
            put(spark, tmp_path / "gaps", part)
            end = time.time() + 60
            while rows() < enough and time.time() < end:
                time.sleep(0.5)
    finally:
        query.stop()
    out = spark.read.parquet(str(tmp_path / "gaps-out"))
    decided, side = side_output(out)
    assert rows_of(decided) == [("a", 1, True, 10.0), ("a", 4, True, 7.0), ("a", 5, False, 7.0), ("a", 6, True, 8.0), ("b", 1, True, 2.0), ("b", 2, True, 1.0)]
    assert sorted((r["account_id"], r["seq"], r["status"]) for r in side.collect()) == [("a", 2, "late"), ("a", 2, "missing"), ("a", 3, "missing"), ("a", 5, "repeated"), ("b", 2, "late")]


def test_rules(spark):
    seen = []
    rule = lambda i, p=0, d=(), **k: Rule(i, p, d, apply=lambda df: (seen.append(i), df)[1], **k)
    engine = RuleEngine().register(rule("c", 1, ("A", "missing"))).register(rule("a", 1)).register(rule("b", 5, ("c",))).register(rule("n", 9, applies=lambda ctx: ctx["ON"]))
    assert [r.id for r in engine.plan({"on": False})] == ["b", "a", "c"]
    engine.register(rule("A", 7))
    assert [r.id for r in engine.plan({"On": True})] == ["n", "A", "b", "c"]
    engine.execute(spark.range(1), {"on": True})
    assert seen == ["n", "A", "b", "c"]
    with pytest.raises(ValueError, match="depend"):
        RuleEngine().register(Rule("x", 0, ("y",))).register(Rule("y", 0, ("x",))).plan()
    double = Rule("d", apply=lambda df: df.withColumn("id", F.col("id") * 2), predicate=F.col("id") > 1)
    assert sorted(r[0] for r in RuleEngine().register(double).execute(spark.range(4)).collect()) == [0, 1, 4, 6]
    assert Context({"A": 1})["a"] == 1


def test_retrieval(spark):
    docs = spark.createDataFrame([(0, "red green"), (1, "red red blue"), (2, None), (3, "red green"), (4, "")], "doc_index long, text string")
    index = TfIdfIndex.build(docs)
    hits = [tuple(r)[:2] for r in index.retrieve("GREEN red", 10).collect()]
    assert [h[0] for h in hits] == [0, 3, 1, 2, 4] and hits[0][1] == hits[1][1] == 1.0
    assert [r["doc_index"] for r in index.retrieve("unknown", 2).collect()] == [0, 1]
    with pytest.raises(ValueError, match="k must"):
        index.retrieve("red", 0)
    queries = spark.createDataFrame([(7, "blue"), (8, "none")], "query_id long, text string")
    best = {(r["query_id"], r["rank"]): r["doc_index"] for r in index.retrieve_batch(queries, 2).collect()}
    assert best == {(7, 1): 1, (7, 2): 0, (8, 1): 0, (8, 2): 1}
    index.unpersist()
