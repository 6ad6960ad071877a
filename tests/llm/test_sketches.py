"""Sketches of sets rule out no similar pair, and leave few of the others."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import lines, neardup


def shingle_set(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def template(rnd, n):
    """Lines of one passage with an ending each, similarities of 0.6 or so; every fifth is a near copy of the one before."""
    out = []
    for i in range(n):
        passage = "this licence covers the work named below and " * 2
        out.append(out[-1][:-1] + rnd.choice("xyz") if i % 5 == 4 else passage[:60] + "".join(rnd.choices("abcdefghij ", k=14)))
    return list(dict.fromkeys(out))


def test_sketches_of_lines(spark):
    made = list(enumerate([*template(random.Random(3), 300), "", "abc", "abd", "x" * 3000, "x" * 3001]))
    known = lines.sketches(lines.hashes(spark.createDataFrame(made, "id long, line string"))).withColumn("k", F.lit(1))
    x, y = (known.select(F.struct(*known.columns).alias(c), "k") for c in "xy")
    pairs = x.join(y, "k").where("x.id > y.id").where(lines.may_be_similar(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    left = {(r[0], r[1]) for r in pairs.select("x.id", "y.id").collect()}
    sets = [shingle_set(line) for _, line in made]
    similar = {(i, j) for i in range(len(made)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert len(similar) > 50 and similar <= left and len(left) < 2 * len(similar) + 50


def test_a_crowded_line_is_parted_once(spark):
    """A line's rare shingles are rows once, however many crowded buckets it is in."""
    made = list(enumerate(template(random.Random(4), 100)))
    frame = spark.createDataFrame(made, "id long, line string")
    hashed = lines.hashes(frame)
    members = frame.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("v"), F.struct("id", F.lit(0).cast("long").alias("s0"), F.lit(0).alias("s1")).alias("own"))
    wanted = sum(len(r["prefix"]) for r in lines.prefixes(frame.select("id"), frame).collect())
    assert lines.parted(members, hashed).count() == wanted


def test_odd_sketches_of_sets():
    rnd = np.random.RandomState(1)
    for n in (0, 1, 50, 600, 5000):
        x = np.unique(rnd.randint(0, 2**62, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[n // 8 :], rnd.randint(0, 2**62, n // 8).astype(np.uint64))))
        differ = np.unpackbits(np.frombuffer(neardup.odd_sketch(x), np.uint8) ^ np.frombuffer(neardup.odd_sketch(y), np.uint8)).sum()
        assert differ <= len(np.setxor1d(x, y))


def test_few_pairs_of_a_template_go_on(spark, monkeypatch):
    """Documents that are nearly similar enough: nearly all pairs of a region had to be looked up in their full sets."""
    rnd, counts, plain = random.Random(5), {}, neardup.materialize

    def counted(df, name):
        out = plain(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    base, rows = [f"w{i}" for i in range(100)], []
    for d in range(250):
        words = list(base)
        for i in rnd.sample(range(100), 6):
            words[i] = f"x{d}y{i}"
        rows.append((d, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    sets, root = [{tuple(t.split()[i : i + 2]) for i in range(99)} for _, t in rows], list(range(250))
    for i in range(250):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))
    assert counts.get("further", 0) < 0.05 * 250 * 249 / 2
