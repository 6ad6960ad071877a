"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

An item of n words is sought in every window of n words of a text. A window's fingerprint is
the SimHash of its weighted five-word shingles. Fingerprints are cut into BLOCKS blocks; two that differ in at most
RADIUS bits differ in at most RADIUS / BLOCKS bits in some block. So the index has for each block a table from every
value to the items within that many bits of it: a window looks up its values and gets all items within
RADIUS. These get their Hamming distance, then the exact weighted Jaccard similarity of the shingles.

Windows without any shingle of an item of their size have similarity 0 with all of them, so no fingerprint could
make them a match: their fingerprints are left out, by a look-up of the text's shingles among the items'.

Shingles in fewer items weigh more: ln(1 + items / items with it), for others ln(1 + items).

The items are a query set. It goes to the executors in parts of bounded size; a text is cut to words once and
meets each part. Nothing of the texts is collected.

Defined cases: null and empty texts and items match nothing; an item (or window) of under five words has
one shingle, of all its words; a text shorter than an item is one window. Texts and items of any length are taken
whole. Of windows equally similar the first is given; a similarity of exactly 0.8 matches. Empty tables match nothing.
Repeated rows of either table count each on its own. Extra columns of the items are left out, those of the documents pass through
unless they have the name of an output column.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
#: Two fingerprints of similarity 0.8 differ in about 20 of 128 bits, with a deviation of 4.
RADIUS = 39
BLOCKS = 8
#: A part of the items has at most so many bytes of text and so many items (a bit each in the tables: 67 MB).
PART_BYTES = 4_000_000
PART_ITEMS = 1024
#: Windows whose fingerprints are held at once.
WINDOWS_AT_ONCE = 2048

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Differences of two 16-bit values in at most RADIUS // BLOCKS bits.
_NEAR = np.flatnonzero(np.bitwise_count(np.arange(65536, dtype=np.uint16)) <= RADIUS // BLOCKS).astype(np.uint16)
MATCH = "array<struct<item_id:long,start:int,end:int,similarity:double>>"


#: ASCII punctuation parts words, so that marks around a passage don't change its words; A-Z are lower-cased.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words, from the words' hashes."""
    with np.errstate(over="ignore"):
        n = len(hashes) - k + 1
        out = np.zeros(max(0, n), dtype=np.uint64)
        for j in range(k):
            out = (out ^ hashes[j : j + len(out)]) * _MIX[0]
            out ^= out >> np.uint64(31)
        return out


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    with np.errstate(over="ignore"):
        two = []
        for m in _MIX[1:]:
            h = (shingles ^ (shingles >> np.uint64(29))) * m
            two.append(h ^ (h >> np.uint64(32)))
    both = np.stack(two, axis=1).astype("<u8")
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def blocks_of(bits: np.ndarray) -> np.ndarray:
    """The 16-bit value of each block of each fingerprint."""
    return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


class MultiIndex:
    """For each block and value the items near it, a bit for each item in words of 64."""

    def __init__(self, bits: np.ndarray):
        self.table = np.zeros((BLOCKS, 65536, (len(bits) + 63) // 64), dtype=np.uint64)
        for i, values in enumerate(blocks_of(bits).tolist()):
            for block, value in enumerate(values):
                self.table[block, _NEAR ^ np.uint16(value), i // 64] |= np.uint64(1 << i % 64)

    def near(self, bits: np.ndarray) -> np.ndarray:
        """Whether each item shares a near block with each fingerprint: a row for each fingerprint."""
        values = blocks_of(bits)
        found = self.table[0, values[:, 0]]
        for block in range(1, BLOCKS):
            found = found | self.table[block, values[:, block]]
        return np.unpackbits(found.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool)


class Index:
    """A part of the items, by their size."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], weight: dict[int, float], other: float):
        self.place: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                self.place.setdefault(w, len(self.place) + 1)
        self.hashes = np.array([0] + [word_hash(w) for w in self.place], dtype=np.uint64)
        self.weight, self.other = weight, other
        by_size: defaultdict[int, list[tuple[int | None, list[bytes]]]] = defaultdict(list)
        for item in items:
            by_size[len(item[1])].append(item)
        self.sizes, every = {}, []
        owners: defaultdict[tuple[int, int], set[int]] = defaultdict(set)  # (shingle length, shingle) -> sizes
        for n, some in by_size.items():
            k = min(SHINGLE, n)
            sets = []
            for _, ws in some:
                h = shingle_hashes(np.array([word_hash(w) for w in ws], dtype=np.uint64), k)
                sets.append(set(h.tolist()))
                for x in sets[-1]:
                    owners[k, x].add(n)
            bits = np.stack([self.fingerprint(np.array(sorted(s), dtype=np.uint64)) for s in sets])
            self.sizes[n] = ([i for i, _ in some], sets, bits, sum(map(len, every)))
            every.append(bits)
        self.bits, self.index = np.concatenate(every), None
        self.owners = {}
        for k in {k for k, _ in owners}:
            keys = sorted(x for kk, x in owners if kk == k)
            self.owners[k] = (np.array(keys, dtype=np.uint64), [sorted(owners[k, x]) for x in keys])

    def multi_index(self) -> MultiIndex:
        """Made where it is used: its tables are larger than the items."""
        if self.index is None:
            self.index = MultiIndex(self.bits)
        return self.index

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(x, self.other) for x in shingles.tolist()], dtype=np.float32)

    def fingerprint(self, shingles: np.ndarray) -> np.ndarray:
        return (self.weights(shingles) @ signs(shingles) > 0).astype(np.uint8)

    def similarity(self, a: set[int], b: set[int]) -> float:
        both = sum(self.weight.get(x, self.other) for x in sorted(a & b))
        return both / sum(self.weight.get(x, self.other) for x in sorted(a | b))

    def matches(self, ws: list[bytes]) -> list[tuple[int | None, int, int, float]]:
        """For each item its most similar window (the first of equal ones), where that is similar enough."""
        ids = np.fromiter(map(self.place.get, ws, repeat(0)), dtype=np.int64, count=len(ws))
        known = ids > 0
        starts: defaultdict[int, list[int]] = defaultdict(list)  # item size -> where its shingles start
        for k, (keys, owners) in self.owners.items():
            if len(ids) < k:
                continue
            run = known[: len(ids) - k + 1].copy()
            for j in range(1, k):
                run &= known[j : len(ids) - k + 1 + j]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            with np.errstate(over="ignore"):
                h = np.zeros(len(at), dtype=np.uint64)
                for j in range(k):
                    h = (h ^ self.hashes[ids[at + j]]) * _MIX[0]
                    h ^= h >> np.uint64(31)
            where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for p, i in zip(at[keys[where] == h].tolist(), where[keys[where] == h].tolist(), strict=True):
                for n in owners[i]:
                    starts[n].append(p)
        out = []
        for n, found in sorted(starts.items()):
            out.extend(self._windows(ws, n, np.unique(found)))
        return out

    def _windows(self, ws: list[bytes], n: int, found: np.ndarray) -> list[tuple[int | None, int, int, float]]:
        k, last = min(SHINGLE, n), max(0, len(ws) - n)
        # All windows with a shingle found.
        reach = np.zeros(last + 2, dtype=np.int64)
        np.add.at(reach, np.clip(found - n + k, 0, last), 1)
        np.add.at(reach, np.clip(found, 0, last) + 1, -1)
        every = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        item_ids, sets, bits, first = self.sizes[n]
        best: dict[int, tuple[float, int]] = {}
        cuts = np.flatnonzero(np.diff(every, prepend=-1 - n) > n)
        for run in np.split(every, cuts[1:]):
            for at in range(0, len(run), WINDOWS_AT_ONCE):
                part = run[at : at + WINDOWS_AT_ONCE]
                lo, hi = int(part[0]), min(len(ws), int(part[-1]) + n)
                h = shingle_hashes(np.array([word_hash(w) for w in ws[lo:hi]], dtype=np.uint64), k)
                # A shingle counts once in a window: it is added where it first stands there.
                values = self.weights(h)[:, None] * signs(h)
                size = min(n, len(ws)) - k + 1
                total = self._window_sums(h, values, part - lo, size)
                own = (total > 0).astype(np.uint8)
                candidates = self.multi_index().near(own)[:, first : first + len(item_ids)]
                for i in np.flatnonzero(candidates.any(axis=0)).tolist():
                    near = np.flatnonzero(candidates[:, i])
                    near = near[np.count_nonzero(own[near] != bits[i], axis=1) <= RADIUS]
                    for j in near.tolist():
                        a = int(part[j]) - lo
                        s = self.similarity(set(h[a : a + size].tolist()), sets[i])
                        if s >= SIMILARITY - 1e-9 and s > best.get(i, (0.0, 0))[0]:
                            best[i] = (s, int(part[j]))
        return [(item_ids[i], a, min(a + n, len(ws)), s) for i, (s, a) in sorted(best.items())]

    @staticmethod
    def _window_sums(h: np.ndarray, values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        sums = np.concatenate((np.zeros((1, values.shape[1]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
        total = sums[starts + size] - sums[starts]
        order = np.argsort(h, kind="stable")
        again = np.flatnonzero(h[order][1:] == h[order][:-1])
        # A later copy at b, the copy before at a: windows that hold both count it once.
        for a, b in zip(order[again].tolist(), order[again + 1].tolist(), strict=True):
            if b - a < size:
                total[(starts <= a) & (starts + size > b)] -= values[b]
        return total


def indexes(benchmark: DataFrame) -> list[Index]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    items = sorted(((r[0], words(r[1])) for r in rows.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    items = [x for x in items if x[1]]
    df: Counter[int] = Counter()
    for _, ws in items:
        df.update(set(shingle_hashes(np.array([word_hash(w) for w in ws], dtype=np.uint64), min(SHINGLE, len(ws))).tolist()))
    weight = {x: math.log(1 + len(items) / c) for x, c in df.items() if c > 1}
    other = math.log(1 + len(items))
    out, part, size = [], [], 0
    for item in items:
        part.append(item)
        size += sum(map(len, item[1]))
        if size >= PART_BYTES or len(part) >= PART_ITEMS:
            out.append(Index(part, weight, other))
            part, size = [], 0
    return [*out, Index(part, weight, other)] if part else out


def _finder(shared: list):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("similarity", pa.float64())]))
    names = ("item_id", "start", "end", "similarity")

    @F.arrow_udf(MATCH)
    def run(texts: pa.Array) -> pa.Array:
        parts = [x.value for x in shared]
        cut = map(words, texts.to_pylist())
        return pa.array([[dict(zip(names, m, strict=True)) for part in parts for m in part.matches(ws)] for ws in cut], kind)

    return run


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns given, with matches: for each item found its best window (in words) and similarity."""
    kept = [c for c in documents.columns if c != "matches"]
    shared = [documents.sparkSession.sparkContext.broadcast(x) for x in indexes(benchmark)]
    found = _finder(shared)(F.col("text").cast("string")) if shared else F.array().cast(MATCH)
    return documents.select(*kept, found.alias("matches"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.sort_array(F.transform("matches", lambda m: m["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("similarity"),
        "matches",
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without any benchmark item, with their columns."""
    return find(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*docs.columns)
