"""The quality query against sums over a chain in plain Python, one text at a time."""

import math
from zlib import crc32

import duckdb

from textloom.llm import quality
from textloom.llm.common import id_bucket
from textloom.llm.registry import QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plain_score(field, text):
    """Each line's chance to be good, by messages over two labels, averaged by the lines' lengths (with their line ends)."""
    lines = (text or "").encode().split(b"\n")
    own = [list(row) for row in quality.own_columns(quality.line_values(lines))]
    odds = []
    for i, row in enumerate(own):
        active = [0, *(1 + c for c in row)]
        active += [1 + quality.OWN + c for c in own[i - 1]] if i else [1 + 3 * quality.OWN] * len(row)
        active += [1 + 2 * quality.OWN + c for c in own[i + 1]] if i + 1 < len(own) else [2 + 3 * quality.OWN] * len(row)
        odds.append(sum(field.weights[c] for c in active))
    stay = math.exp(field.same)

    def step(message):
        total = [message[0] * stay + message[1], message[0] + message[1] * stay]
        return [x / sum(total) for x in total]

    def local(i):
        good = math.exp(min(odds[i], 500))
        return [1 / (1 + good), good / (1 + good)]

    ahead, back = [[0.5, 0.5]], [[0.5, 0.5]]
    for i in range(1, len(lines)):
        ahead.append(step([a * b for a, b in zip(ahead[-1], local(i - 1), strict=True)]))
    for i in range(len(lines) - 2, -1, -1):
        back.append(step([a * b for a, b in zip(back[-1], local(i + 1), strict=True)]))
    back.reverse()
    total = weight = 0.0
    for i, line in enumerate(lines):
        bad, good = (a * b * c for a, b, c in zip(ahead[i], local(i), back[i], strict=True))
        total += (len(line) + 1) * good / (bad + good)
        weight += len(line) + 1
    return total / weight


def test_query_against_plain_sums(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(documents.select("doc_id", "text"), labels, keep=id_bucket(F.col("doc_id"), 5) != 0)
    assert field.weights.any() and field.same > 0
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in QUERIES["op1_quality"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = plain_score(field, text)
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.3) and got[i]["held_out"] == (crc32(str(i).encode()) % 5 == 0)


def test_very_many_lines(spark):
    """A text of 300,000 lines and others beside it."""
    field = quality.fit_rows(["good line\n" * 5, "bad\n" * 5], [1, 0])
    rows = spark.createDataFrame([(1, "good line\n" * 300_000), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in rows.select("doc_id", quality.scorer(field)(F.col("text")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[2] == got[3]
