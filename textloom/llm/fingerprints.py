"""Document fingerprints by winnowing.

Every k characters are hashed; of each window of w hashes the smallest is kept, the
rightmost on ties, with its position. Two texts that share a passage of at least
k + w - 1 characters share a fingerprint.

Defined cases: a null text counts as empty; the empty text has the empty fingerprint; a text
of under k characters has one fingerprint, of its whole; one of under w hashes has one
window. Two empty fingerprints are alike to the degree 1, an empty and another one to 0.
Repeated ids are ordered by text, null ids come first. Extra columns are left out. A text of any length is fingerprinted
whole, in memory of some bytes a character; of an only row the next document is itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

K = 10
WINDOW = 15
#: Rows in a range of ids that one task goes through in order.
ROWS_PER_RANGE = 4000
MAX_RANGES = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of every run of k code points, by doubling: h(a+b) = h(a) * B^len(b) + h(b)."""
    n = len(points)
    with np.errstate(over="ignore"):
        if 0 < n < k:
            points, k = points[:], n
        h = (points.astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        out, out_len, power, size, rest = None, 0, _BASE, 1, k
        while rest:
            if rest & 1:
                if out is None:
                    out = h
                else:
                    m = min(len(out), max(0, len(h) - out_len))
                    out = out[:m] * power + h[out_len : out_len + m]
                out_len += size
            rest >>= 1
            if rest:
                m = max(0, len(h) - size)
                h = h[:m] * power + h[size:]
                power = power * power
                size *= 2
        out = out[: max(0, n - k + 1)]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return (out >> np.uint64(32)).astype(np.uint64)


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprints, in order of position."""
    points = code_points(text or "")
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    hashes = gram_hashes(points, k)
    n = len(hashes)
    # Smallest hash first, then the largest position: the rightmost of equal hashes.
    low = np.uint64(0xFFFFFFFF)
    key = (hashes << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))
    span, size = min(window, n), 1
    best = key
    while size * 2 <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < span:
        best = np.minimum(best[: len(best) - (span - size)], best[span - size :])
    chosen = best[np.concatenate(([True], best[1:] != best[:-1]))]
    return chosen >> np.uint64(32), low - (chosen & low)


def encode(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Sixteen hex digits for each fingerprint: eight of the position, eight of the hash."""
    return ((positions << np.uint64(32)) | hashes).astype(">u8").tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)
    return both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of fingerprint hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.sort(np.concatenate((a, b)))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to as many of the following text's first (or to all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_chars": [len(t) for t in texts], "fingerprint": [encode(*winnow(t, k, window)) for t in texts]})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def with_following(documents: DataFrame) -> DataFrame:
    """Deal the rows to ranges of ids in order, each range with the first row of the next one besides.

    Returns doc_id, text, bucket, ahead (1: the row belongs to the next range). Only bounds of the
    ranges (at most MAX_RANGES numbers) pass through the driver; texts are shuffled once.
    """
    # A null id sorts before all others.
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
    cuts = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * MAX_RANGES)).first()[0] if ranges > 1 else None
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    low = F.lit(-(2**63)).cast("long")
    # The number of cuts at or below the id, by halving.
    where = F.pandas_udf(lambda s: pd.Series([0 if pd.isna(x) else _below(cuts, int(x)) for x in s], dtype="int32"), "int") if len(cuts) > 64 else None
    bucket = where(F.col("doc_id")) if where else F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    firsts = rows.groupBy("bucket").agg(F.min(F.coalesce("doc_id", low)).alias("first")).orderBy("bucket").collect()
    before = {r["first"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}  # the last range looks ahead to the first
    if not before:
        return rows.withColumn("ahead", F.lit(0))
    to = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    to = F.element_at(to, F.coalesce("doc_id", low))
    copies = F.when(to.isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("ahead")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ahead")), F.struct(to.alias("bucket"), F.lit(1).alias("ahead"))))
    rows = rows.select("doc_id", "text", F.explode(copies).alias("_c")).select("doc_id", "text", "_c.bucket", "_c.ahead")
    return rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def _below(cuts: list[int], x: int) -> int:
    i = bisect_left(cuts, x)
    return i + (i < len(cuts) and cuts[i] == x)


def fingerprints_with_edit(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are to each other and to the next text's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: bucket, ahead, doc_id, text, hashes, positions
        for b in batches:
            out = []
            for doc_id, text, bucket, ahead in zip(b["doc_id"], b["text"], b["bucket"], b["ahead"], strict=True):
                if held is not None and held[1] and ahead and held[0] == bucket:
                    continue  # another row with the first id of the next range
                marks = winnow(text, k, window)
                if held is not None and not held[1]:
                    changed = edited(held[3], text)
                    own, other = held[4], winnow(changed, k, window)
                    out.append((held[2], len(held[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encode(*own), encode(*other), likeness(own[0], other[0]), likeness(own[0], marks[0])))
                held = (bucket, ahead, doc_id, text, marks)
            if out:
                yield _frame(out)

    return with_following(documents).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    frame = pd.DataFrame(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64")
    return frame


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edit(table(spark, sf_dir, "documents"))
