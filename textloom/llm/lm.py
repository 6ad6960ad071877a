"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | context) * P(group | class, context) * P(token | class, group). The first two
factors are softmaxes over log-linear features of the two tokens before: of their classes (bias, the class before
as n-gram feature, the one before that as skip feature, their hashed pair) and of the words themselves (hashed
n-gram and skip features, for the class and, within a class, for its groups of words). The last is the token's
share of its group. Classes: the end of a text, the TOP most frequent words each, other words by their last two
bytes, and words seen once or never by a hash of these bytes. Within a class, words are dealt to GROUPS groups by a
hash; each group of rare words keeps one share for unseen ones. The hashed features have a row for each of about
sqrt(N) / 4 values, so the tables grow with the corpus, up to 2**16 rows (about 130 MB for all four).

The work, in Spark jobs:

1. tasks number the words of their block of texts and send each word with its count to its bucket;
2. buckets add up the counts and return them to the blocks, with sums by last bytes and the top words;
3. blocks turn their tokens into classes and add up what doesn't depend on the model;
4. counts of class triples are the model's sufficient statistics; gradient updates are computed over
   them by partition and added up;
5. the words' weights are learned in PASSES passes over all tokens to learn from: each task adds up what it
   observes and what the model expects for its blocks, slices of these sums are added up by shuffle in two steps;
6. every text is scored by block, in batches of tokens.

Only tables of bounded size reach the driver: sums by two bytes, by class and group, TOP words, slopes.

Defined cases: a null or empty text is the end token alone; a null id is learned from. With nothing to learn
from, N is 0 and V is 0, and every token has base probability 1. Repeated rows count each.
Extra columns are left out. Equal counts are ordered by word. A text of any length is one of its block's texts and is scored whole.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import id_bucket, materialize, table, words

TOP = 64
SUFFIXES = 47
RARE = 16
END_CLASS = 0
CLASSES = 1 + TOP + SUFFIXES + RARE
#: Hashed values of the class two before in the pair feature.
PAIRS = 32
#: Groups of tasks whose counts are added up first.
SALTS = 64
ROUNDS = 25
RATE = 0.1
RIDGE = 1e-6
BLOCK_CHARS = 16_000_000
BLOCK_TEXTS = 30_000
ROWS_PER_BUCKET = 4000
#: The end of a text; no word has white space in it.
END = b" "
#: Groups of a class's words.
GROUPS = 32
PASSES = 2
#: How far a weight goes at once: up to STEP, less where little was seen than CALM occurrences.
STEP = 0.8
CALM = 10.0
WORD_RIDGE = 1.0
#: Tokens taken at once, slices that the sums of the words' slopes are cut into.
BATCH = 16_384
#: Contexts scored at once; nothing but sums is kept of them, so a core's cache holds them.
SCORED = 512
SLICES = 16
#: Numbers of a table that are worked on at once.
CACHED = 64 * 1024
#: Rows of a table that occur more often in a batch are summed one by one.
LONG_RUN = 32


def word_codes(names: list[bytes]) -> np.ndarray:
    """16 bits of a hash of each word."""
    return (pd.util.hash_array(np.array([w.decode("latin-1") for w in names], dtype=object)) >> np.uint64(48)).astype(np.uint16)


END_CODE = int(word_codes([END])[0])


def group(code: np.ndarray) -> np.ndarray:
    return code >> 11


def _pack(head: dict, *arrays: np.ndarray) -> bytes:
    """A small header and arrays of 32-bit numbers, compressed."""
    first = json.dumps(head | {"sizes": [len(a) for a in arrays]}).encode()
    return zstandard.compress(len(first).to_bytes(4, "little") + first + b"".join(a.astype("<u4").tobytes() for a in arrays), 1)


def _unpack(data: bytes) -> tuple[dict, list[np.ndarray]]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    head = json.loads(raw[4 : 4 + n])
    out, at = [], 4 + n
    for k in head["sizes"]:
        out.append(np.frombuffer(raw, dtype="<u4", count=k, offset=at))
        at += 4 * k
    return head, out


def _block_rows(block: int, ids: list, learn: list[bool], codes: list[np.ndarray], place: dict[bytes, int], buckets: int) -> Iterator[tuple]:
    """The texts of a block as numbers, and its words with their counts in texts to learn from, by bucket."""
    sizes = np.array([len(c) for c in codes])
    flat, taught = np.concatenate(codes), np.array(learn)
    yield ("text", -1, block, b"", _pack({"ids": ids, "learn": [int(x) for x in learn]}, sizes, flat))
    counts = np.bincount(flat[np.repeat(taught, sizes)], minlength=len(place))
    names = list(place)
    bucket = (pd.util.hash_array(np.array([w.decode("latin-1") for w in names], dtype=object)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0, [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        some = order[a:b]
        yield ("word", int(bucket[some[0]]), block, b"\n".join(names[i] for i in some.tolist()), _pack({}, some, counts[some]))


def number(documents: DataFrame, learn: Column, buckets: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, turn = TaskContext.get().partitionId(), count()
        names = ["kind", "bucket", "block", "words", "data"]
        place, ids, taught, codes, chars = None, [], [], [], 0
        for b in batches:
            for doc_id, text, take in zip(b["doc_id"], b["text"], b["learn"], strict=True):
                if place is None:
                    place = defaultdict(count().__next__)
                tokens = [*words(text), END]
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                taught.append(bool(take))
                codes.append(np.fromiter(map(place.__getitem__, tokens), dtype=np.uint32, count=len(tokens)))
                chars += len(text or "") + 50
                if chars > BLOCK_CHARS or len(ids) >= BLOCK_TEXTS:
                    yield from (pd.DataFrame([r], columns=names) for r in _block_rows(part << 24 | next(turn), ids, taught, codes, place, buckets))
                    place, ids, taught, codes, chars = None, [], [], [], 0
        if ids:
            rows = list(_block_rows(part << 24 | next(turn), ids, taught, codes, place, buckets))
            yield pd.DataFrame(rows, columns=names)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), learn.alias("learn"))
    return rows.mapInPandas(run, "kind string, bucket long, block long, words binary, data binary")


def suffix(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


def _count_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of a bucket's words for each block, sums by last bytes, and its top words."""
    place: defaultdict[bytes, int] = defaultdict(count().__next__)
    blocks = []
    for block, names, data in zip(rows["block"], rows["words"], rows["data"], strict=True):
        _, (local, n) = _unpack(data)
        blocks.append((block, np.array([place[w] for w in names.split(b"\n")]), local, n))
    total = np.zeros(len(place), dtype=np.int64)
    for _, at, _, n in blocks:
        total[at] += n
    out = [("count", block, None, _pack({}, local, total[at]), 0, 0) for block, at, local, _ in blocks]
    names = list(place)
    ends = np.array([suffix(w) for w in names]) * GROUPS + group(word_codes(names))
    end = np.array([w == END for w in names])
    out.extend(("end", 0, None, None, int(n), int(n > 0)) for n in total[end])
    for kind, some in (("often", ~end & (total > 1)), ("rare", ~end & (total == 1))):
        keys, back = np.unique(ends[some], return_inverse=True)
        n, types = np.bincount(back, total[some]), np.bincount(back)
        out.extend((kind, int(k), None, None, int(a), int(b)) for k, a, b in zip(keys, n, types, strict=True))
    best = np.argsort(-total, kind="stable")[: TOP + 1]
    out.extend(("top", 0, names[i], None, int(total[i]), 1) for i in best.tolist() if total[i] > 1 and not end[i])
    return pd.DataFrame(out, columns=["kind", "key", "word", "data", "n", "types"])


@dataclass
class Lexicon:
    """Classes of words and the tokens' shares of their groups; its size doesn't depend on the corpus."""

    tokens: int = 0  # N
    types: int = 0  # V
    top: dict[bytes, int] = field(default_factory=dict)
    suffix_class: dict[int, int] = field(default_factory=dict)
    group_tokens: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, GROUPS)))
    group_types: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, GROUPS)))

    def often(self, key: int) -> int:
        return self.suffix_class.get(key, 1 + TOP + key % SUFFIXES)

    @staticmethod
    def rare(key: int) -> int:
        return 1 + TOP + SUFFIXES + (key * 40503 >> 4) % RARE

    def classes(self, names: list[bytes], counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and the log10 of its share of its group."""
        kind = np.empty(len(names), dtype=np.uint8)
        for i, (w, c) in enumerate(zip(names, counts.tolist(), strict=True)):
            if w == END:
                kind[i] = END_CLASS
            elif c > 1:
                kind[i] = self.top.get(w) or self.often(suffix(w))
            else:
                kind[i] = self.rare(suffix(w))
        share = np.zeros(len(names))
        mid = (kind > TOP) & (kind <= TOP + SUFFIXES)
        share[mid] = np.log10(counts[mid] / np.maximum(1, self.group_tokens[kind[mid], group(codes[mid])]))
        low = kind > TOP + SUFFIXES
        share[low] = -np.log10(self.group_types[kind[low], group(codes[low])] + 1)
        return kind, share


def lexicon(counted: DataFrame) -> Lexicon:
    out = Lexicon()
    fine = counted.where("kind in ('often', 'rare', 'end')").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    fine = fine.select("kind", F.expr(f"key div {GROUPS}").alias("key"), F.expr(f"cast(key % {GROUPS} as int)").alias("g"), "n", "types")
    sums = fine.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()  # by two bytes: 2 * 65,536 rows at most
    top = counted.where("kind = 'top'").orderBy(F.desc("n"), "word").limit(TOP).collect()
    out.tokens, out.types = sum(r["n"] for r in sums), sum(r["types"] for r in sums)
    often = {r["key"]: r["n"] for r in sums if r["kind"] == "often"}
    for r in top:
        word = bytes(r["word"])
        out.top[word] = 1 + len(out.top)
        often[suffix(word)] -= r["n"]
    ranked = sorted(often, key=lambda k: (-often[k], k))[: SUFFIXES - 1]
    out.suffix_class = {k: 1 + TOP + i for i, k in enumerate(ranked)} | {k: TOP + SUFFIXES for k in often if k not in set(ranked)}
    # The class of each key is known now: at most 2 * 65,536 rows.
    kinds = [(r["kind"], r["key"], out.often(r["key"]) if r["kind"] == "often" else out.rare(r["key"])) for r in sums if r["kind"] != "end"]
    named = counted.sparkSession.createDataFrame(kinds, "kind string, key long, c int")
    by_group = fine.join(F.broadcast(named), ["kind", "key"]).groupBy("c", "g").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    for r in by_group.collect():  # CLASSES * GROUPS rows at most
        out.group_tokens[r["c"], r["g"]] += r["n"]
        out.group_types[r["c"], r["g"]] += r["types"]
    for r in top:
        word = bytes(r["word"])
        at = out.often(suffix(word)), int(group(word_codes([word]))[0])
        out.group_tokens[at] -= r["n"]
        out.group_types[at] -= 1
    return out


def _ragged_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


def classify(numbered: DataFrame, counted: DataFrame, lex: Lexicon) -> DataFrame:
    """By block: the classes of all tokens, and for each text what doesn't depend on the model."""
    shared = numbered.sparkSession.sparkContext.broadcast(lex)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lex, texts, counts, names = shared.value, None, {}, {}
        block = int(rows["block"].iloc[0])
        for kind, bucket, listed, data in zip(rows["kind"], rows["bucket"], rows["words"], rows["data"], strict=True):
            if kind == "text":
                texts = data
            elif kind == "word":
                names[bucket] = (listed.split(b"\n"), data)
        head, (sizes, flat) = _unpack(texts)
        sizes = sizes.astype(np.int64)
        size = sum(len(x) for x, _ in names.values())
        word = [b""] * size
        for listed, data in names.values():
            for i, w in zip(_unpack(data)[1][0].tolist(), listed, strict=True):
                word[i] = w
        counts = np.zeros(size, dtype=np.int64)
        for kind, data in zip(rows["kind"], rows["data"], strict=True):
            if kind == "count":
                _, (local, n) = _unpack(data)
                counts[local] = n
        codes = word_codes(word)
        kind, share = lex.classes(word, counts, codes)
        add = lambda x: _ragged_sums(x[flat], sizes)
        floor = math.log10(lex.tokens + lex.types + 1)
        base = add(np.log10(counts + 1.0)) - floor * sizes
        known = add((counts > 0).astype(np.int64))
        return pd.DataFrame({"block": [block], "ids": [json.dumps(head["ids"])], "learn": [np.array(head["learn"], dtype=np.uint8).tobytes()], "sizes": [sizes.astype("<i8").tobytes()], "classes": [zstandard.compress(kind[flat].tobytes(), 1)], "codes": [zstandard.compress(codes[flat].astype("<u2").tobytes(), 1)], "base": [base.astype("<f8").tobytes()], "known": [known.astype("<i8").tobytes()], "share": [add(share).astype("<f8").tobytes()]})

    counts = counted.where("kind = 'count'").select(F.lit("count").alias("kind"), F.lit(-1).cast("long").alias("bucket"), F.col("key").alias("block"), F.lit(None).cast("binary").alias("words"), "data")
    return numbered.unionByName(counts).groupBy("block").applyInPandas(run, "block long, ids string, learn binary, sizes binary, classes binary, codes binary, base binary, known binary, share binary")


def _contexts(classes: np.ndarray, sizes: np.ndarray, end: int = END_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """The classes (or codes) of one and two tokens before; before a text stands the end."""
    before, skip = np.zeros_like(classes), np.zeros_like(classes)
    before[1:], skip[2:] = classes[:-1], classes[:-2]
    starts = np.cumsum(sizes) - sizes
    before[starts] = end
    skip[starts] = end
    second = starts + 1
    skip[second[sizes > 1]] = end
    return before.astype(np.int64), skip.astype(np.int64)


def triples(classified: DataFrame) -> DataFrame:
    """How often each class follows each two, in texts to learn from: (before, data) with counts by (two before, class)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for b in batches:
            for learn, sizes, data in zip(b["learn"], b["sizes"], b["classes"], strict=True):
                sizes, learn = np.frombuffer(sizes, "<i8"), np.frombuffer(learn, np.uint8).astype(bool)
                classes = np.frombuffer(zstandard.decompress(data), np.uint8)
                before, skip = _contexts(classes, sizes)
                key = ((before * CLASSES + skip) * CLASSES + classes)[np.repeat(learn, sizes)]
                total += np.bincount(key, minlength=CLASSES**3)
        rows = total.reshape(CLASSES, -1)
        used = np.flatnonzero(rows.any(axis=1))
        yield pd.DataFrame({"before": used, "salt": TaskContext.get().partitionId() % SALTS, "data": [_sparse(rows[i]) for i in used]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CLASSES**2, dtype=np.int64)
        for d in rows["data"]:
            at, n = _dense(d)
            total[at] += n
        return pd.DataFrame({"before": [int(rows["before"].iloc[0])], "data": [_sparse(total)]})

    part = classified.select("learn", "sizes", "classes").mapInPandas(partial, "before long, salt long, data binary")
    # In two steps, so that no group has a row of every task.
    part = part.groupBy("before", "salt").applyInPandas(whole, "before long, data binary")
    return part.groupBy("before").applyInPandas(whole, "before long, data binary")


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return zstandard.compress(at.astype("<i4").tobytes() + counts[at].astype("<i8").tobytes(), 1)


def _dense(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    n = len(raw) // 12
    return np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i8", n, 4 * n)


@dataclass
class Weights:
    bias: np.ndarray
    before: np.ndarray  # class before x class
    skip: np.ndarray  # class two before x class
    pair: np.ndarray  # class before x hashed class two before x class

    @staticmethod
    def zero() -> Weights:
        return Weights(np.zeros(CLASSES), np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, PAIRS, CLASSES)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.bias, self.before, self.skip, self.pair

    def log_p(self, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Natural logs of all classes' probabilities, a row for each context."""
        z = self.bias + self.before[before] + self.skip[skip] + self.pair[before, pair_hash(skip)]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def pair_hash(skip: np.ndarray) -> np.ndarray:
    return (skip * 40503 >> 3) % PAIRS


def _slopes(weights: Weights, rows: Iterator[tuple[int, bytes]]) -> tuple[float, Weights]:
    """The log-likelihood of some rows of triples and its slopes."""
    out, like = Weights.zero(), 0.0
    for b, data in rows:
        at, n = _dense(data)
        skips, back = np.unique(at // CLASSES, return_inverse=True)
        seen = np.zeros((len(skips), CLASSES))
        np.add.at(seen, (back, at % CLASSES), n)
        log_p = weights.log_p(np.full(len(skips), b), skips)
        like += float((seen * log_p).sum())
        rest = seen - np.exp(log_p) * seen.sum(axis=1, keepdims=True)
        out.bias += rest.sum(axis=0)
        out.before[b] += rest.sum(axis=0)
        out.skip[skips] += rest
        np.add.at(out.pair[b], pair_hash(skips), rest)
    return like, out


def train(counts: DataFrame, rounds: int = ROUNDS) -> tuple[Weights, list[float]]:
    """Gradient updates over partitions of the triples; the sums of at most CLASSES rows come back."""
    spark = counts.sparkSession
    counts = counts.repartition(8, "before").cache()
    start = counts.collect()  # CLASSES rows
    total = np.zeros((CLASSES, CLASSES))
    for r in start:
        at, n = _dense(bytes(r["data"]))
        np.add.at(total[r["before"]], at % CLASSES, n)
    tokens = total.sum()
    weights, likes = Weights.zero(), []
    if not tokens:
        return weights, likes
    # From a model with the class before only.
    weights.bias[:] = np.log((total.sum(axis=0) + 0.5) / (tokens + 0.5 * CLASSES))
    prior = np.exp(weights.bias) / np.exp(weights.bias).sum()
    weights.before[:] = np.log((total + 20 * prior) / (total.sum(axis=1, keepdims=True) + 20)) - weights.bias
    mean, square = Weights.zero(), Weights.zero()
    for k in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            rows = [(b, d) for x in batches for b, d in zip(x["before"], x["data"], strict=True)]
            like, s = _slopes(shared.value, iter(rows))
            own = sorted({b for b, _ in rows})
            data = np.concatenate([s.bias, s.skip.ravel(), s.before[own].ravel(), s.pair[own].ravel()]).astype("<f4")
            yield pd.DataFrame({"like": [like], "own": [own], "data": [data.tobytes()]})

        slope, like = Weights.zero(), 0.0
        for r in counts.mapInPandas(run, "like double, own array<long>, data binary").collect():
            like += r["like"]
            x, own = np.frombuffer(bytes(r["data"]), "<f4").astype(np.float64), r["own"]
            c, m = CLASSES, len(r["own"])
            slope.bias += x[:c]
            slope.skip += x[c : c + c * c].reshape(c, c)
            slope.before[own] += x[c + c * c : c + c * c + m * c].reshape(m, c)
            slope.pair[own] += x[c + c * c + m * c :].reshape(m, PAIRS, c)
        likes.append(like / tokens)
        shared.destroy()
        for w, s, a, q in zip(weights.parts(), slope.parts(), mean.parts(), square.parts(), strict=True):
            s = s / tokens - RIDGE * w
            a += 0.1 * (s - a)
            q += 0.01 * (s * s - q)
            w += RATE * (a / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-8)
    counts.unpersist()
    return weights, likes


def _softmax(z: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (times a number for each row), written over z, and the logs of the sums. Weights move by STEP a pass at most, so nothing overflows."""
    total, ones = np.empty(len(z), dtype=z.dtype), np.ones(z.shape[1], dtype=z.dtype)
    step = CACHED // z.shape[1]
    for a in range(0, len(z), step):  # what fits a core's cache
        part = z[a : a + step]
        np.exp(part, out=part)
        total[a : a + step] = part @ ones
        share = 1 / total[a : a + step] if times is None else times[a : a + step] / total[a : a + step]
        part *= share[:, None]
    return z, np.log(total)


def _log_sums(z: np.ndarray) -> np.ndarray:
    """The logs of the sums alone, where probabilities aren't needed; z is written over."""
    total, ones = np.empty(len(z), dtype=z.dtype), np.ones(z.shape[1], dtype=z.dtype)
    step = CACHED // z.shape[1]
    for a in range(0, len(z), step):
        part = z[a : a + step]
        total[a : a + step] = np.exp(part, out=part) @ ones
    return np.log(total)


@dataclass
class Words:
    """The whole model: what the classes before give, and the weights of hashed words for classes and for groups within a class."""

    bits: int
    classes: np.ndarray  # class before and class two before x class
    groups: np.ndarray  # class x group
    near: np.ndarray  # hashed word before x class
    far: np.ndarray  # hashed word two before x class
    near_in: np.ndarray  # hashed word before and class x group
    far_in: np.ndarray  # hashed word two before and class x group

    @staticmethod
    def start(weights: Weights, lex: Lexicon, bits: int | None = None) -> Words:
        if bits is None:
            bits = min(16, max(8, round(math.log2(math.sqrt(lex.tokens) / 4 + 1))))
        before, skip = np.divmod(np.arange(CLASSES**2), CLASSES)
        inner = np.log(np.where(np.arange(CLASSES)[:, None] > TOP + SUFFIXES, lex.group_types + 1, lex.group_tokens + 0.5))
        rows = 1 << bits
        tables = [np.zeros((rows, CLASSES), np.float32) for _ in range(2)] + [np.zeros((rows * CLASSES // GROUPS, GROUPS), np.float32) for _ in range(2)]
        return Words(bits, weights.log_p(before, skip).astype(np.float32), inner.astype(np.float32), *tables)

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.near, self.far, self.near_in, self.far_in

    def row(self, code: np.ndarray) -> np.ndarray:
        return (code * 40503 & 0xFFFF) >> 16 - self.bits

    def row_in(self, code: np.ndarray, kind: np.ndarray) -> np.ndarray:
        mixed = (code << 7 | kind).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) * np.uint64(len(self.near_in)) >> np.uint64(32)).astype(np.int64)

    def class_logits(self, context: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Unscaled logs of all classes, a row for each context."""
        z = self.classes.take(context, axis=0)
        z += self.near.take(one, axis=0)
        z += self.far.take(two, axis=0)
        return z

    def group_logits(self, kind: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Unscaled logs of all groups within a class."""
        z = self.groups.take(kind, axis=0)
        z += self.near_in.take(one, axis=0)
        z += self.far_in.take(two, axis=0)
        return z


def _context_words(sizes: np.ndarray, classes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token both classes before as one number, the code before and that two before."""
    before, skip = _contexts(classes, sizes)
    one, two = (x.astype(np.uint16) for x in _contexts(codes, sizes, END_CODE))
    return (before * CLASSES + skip).astype(np.int32), one, two


def _unblock(row: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.sizes, "<i8"), np.frombuffer(zstandard.decompress(row.classes), np.uint8), np.frombuffer(zstandard.decompress(row.codes), "<u2")


def _starts(named: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))


def _add_rows(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add rows to rows of a table; rows may repeat.

    Those that repeat often are summed by run. The others go in rounds, in each of which no row of the table occurs
    twice: sums of many short runs at once take several times as long.
    """
    order = np.argsort(at.astype(np.int32), kind="stable")
    named = at[order]
    starts = _starts(named)
    lengths, ones = np.diff(starts, append=len(at)), np.ones(len(at), dtype=values.dtype)
    for k in np.flatnonzero(lengths > LONG_RUN).tolist():
        a, n = starts[k], lengths[k]
        total[named[a]] += ones[:n] @ values.take(order[a : a + n], axis=0)
    starts, lengths = starts[lengths <= LONG_RUN], lengths[lengths <= LONG_RUN]
    for k in range(LONG_RUN):
        here = starts[lengths > k] + k
        if not len(here):
            break
        total[named[here]] += values.take(order[here], axis=0)


def _alike(context: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of tokens in which those of one context stand together, and where each context begins."""
    key = one.astype(np.int64) << 30 | two << 14 | context
    order = np.argsort(key)
    return order, _starts(key[order])


def _class_slopes(model: Words, kind: np.ndarray, context: np.ndarray, one: np.ndarray, two: np.ndarray, near: np.ndarray, far: np.ndarray) -> float:
    """Add the expected counts of the classes' weights; the log-likelihood. Tokens of one context are taken together."""
    like = 0.0
    order, first = _alike(context, one, two)
    numbers = np.append(first, len(order))
    for a in range(0, len(first), BATCH):
        heads = first[a : a + BATCH]
        ends = numbers[a + 1 : a + 1 + len(heads)]
        at = order[heads]
        z = model.class_logits(context[at], one[at], two[at])
        repeats = ends - heads
        like += float(z[np.repeat(np.arange(len(heads)), repeats), kind[order[heads[0] : ends[-1]]]].sum(dtype=np.float64))
        p, logs = _softmax(z, repeats.astype(np.float32))
        like -= float(logs.astype(np.float64) @ repeats)
        _add_rows(near, one[at], p)
        _add_rows(far, two[at], p)
    return like


def _group_slopes(model: Words, kind: np.ndarray, sub: np.ndarray, one: np.ndarray, two: np.ndarray, near: np.ndarray, far: np.ndarray) -> float:
    """The same for the groups within classes."""
    like = 0.0
    for a in range(0, len(kind), 4 * BATCH):
        at = slice(a, a + 4 * BATCH)
        z = model.group_logits(kind[at], one[at], two[at])
        like += float(z[np.arange(len(z)), sub[at]].sum(dtype=np.float64))
        p, logs = _softmax(z)
        like -= float(logs.sum(dtype=np.float64))
        _add_rows(near, one[at], p)
        _add_rows(far, two[at], p)
    return like


def _word_slopes(model: Words, blocks: Iterator[tuple], observe: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of blocks (learn, sizes, classes, codes) but for the words' shares; observed and expected counts of all weights."""
    expected = [np.zeros_like(t) for t in model.tables()]
    observed = [np.zeros_like(t) for t in model.tables()] if observe else []
    like = 0.0
    for learn, sizes, classes, codes in blocks:
        taught = np.repeat(learn, sizes)
        context, one, two = (x[taught].astype(np.int64) for x in _context_words(sizes, classes, codes))
        kind, sub = classes[taught].astype(np.int64), group(codes[taught]).astype(np.int64)
        mid = kind > TOP
        inner = kind[mid], sub[mid], model.row_in(one[mid], kind[mid]), model.row_in(two[mid], kind[mid])
        outer = kind, context, model.row(one), model.row(two)
        del one, two, context, taught
        like += _class_slopes(model, *outer, *expected[:2]) + _group_slopes(model, *inner, *expected[2:])
        for t, rows, hit in zip(observed, (*outer[2:], *inner[2:]), (kind, kind, inner[1], inner[1]), strict=False):
            t += np.bincount(rows * t.shape[1] + hit, minlength=t.size).reshape(t.shape)
    flat = [np.concatenate([t.ravel() for t in x]) if x else np.zeros(0, np.float32) for x in (observed, expected)]
    return like, flat[0], flat[1]


def _word_sums(classified: DataFrame, model: Words, observe: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """`_word_slopes` of all blocks: slices of each task's sums are added up by shuffle."""
    shared = classified.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = ((np.frombuffer(r.learn, np.uint8).astype(bool), *_unblock(r)) for b in batches for r in b.itertuples(index=False))
        like, seen, expected = _word_slopes(shared.value, blocks, observe)
        pack = lambda x: [zstandard.compress(y.astype("<f4").tobytes(), 1) for y in np.array_split(x, SLICES)]
        yield pd.DataFrame({"slice": range(SLICES), "salt": TaskContext.get().partitionId() % SALTS, "like": [like] + [0.0] * (SLICES - 1), "seen": pack(seen), "expected": pack(expected)})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"slice": [int(rows["slice"].iloc[0])], "like": [rows["like"].sum()]}
        for name in ("seen", "expected"):
            total = 0.0
            for d in rows[name]:
                total = total + np.frombuffer(zstandard.decompress(d), "<f4").astype(np.float64)
            out[name] = [zstandard.compress(total.astype("<f4").tobytes(), 1)]
        return pd.DataFrame(out)

    schema = "slice int, like double, seen binary, expected binary"
    part = classified.select("learn", "sizes", "classes", "codes").mapInPandas(partial, "slice int, salt long, like double, seen binary, expected binary")
    rows = part.groupBy("slice", "salt").applyInPandas(whole, schema).groupBy("slice").applyInPandas(whole, schema).collect()  # SLICES rows: the model's size
    shared.destroy()
    rows.sort(key=lambda r: r["slice"])
    join = lambda name: np.concatenate([np.frombuffer(zstandard.decompress(bytes(r[name])), "<f4") for r in rows]) if rows else np.zeros(0)
    return sum(r["like"] for r in rows), join("seen"), join("expected")


def train_words(classified: DataFrame, weights: Weights, lex: Lexicon, passes: int = PASSES) -> tuple[Words, list[float]]:
    """Updates along the slope (observed less expected counts), each weight's step scaled by the larger of the two."""
    model, likes, seen = Words.start(weights, lex), [], None
    for k in range(passes if lex.tokens else 0):
        like, first, expected = _word_sums(classified, model, k == 0)
        seen = first if k == 0 else seen
        likes.append(like / lex.tokens)
        at = 0
        for t in model.tables():
            s, e = (x[at : at + t.size].reshape(t.shape) for x in (seen, expected))
            t += STEP * (s - e - WORD_RIDGE * t) / (np.maximum(s, e) + CALM)
            at += t.size
    return model, likes


def _log_p(model: Words, sizes: np.ndarray, classes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Natural logs of each token's class and group; tokens of one context are taken together for the class."""
    context, one, two = _context_words(sizes, classes, codes)
    out = np.empty(len(classes))
    near, far = model.row(one.astype(np.int64)), model.row(two.astype(np.int64))
    order, first = _alike(context, near, far)
    numbers = np.append(first, len(order))
    for a in range(0, len(first), SCORED):
        heads = first[a : a + SCORED]
        ends = numbers[a + 1 : a + 1 + len(heads)]
        at, tokens = order[heads], order[heads[0] : ends[-1]]
        z = model.class_logits(context[at], near[at], far[at])
        own = np.repeat(np.arange(len(heads)), ends - heads)
        log_p = z[own, classes[tokens]].astype(np.float64)
        out[tokens] = log_p - _log_sums(z)[own]
    middle, subs = np.flatnonzero(classes > TOP), group(codes)
    for a in range(0, len(middle), 4 * SCORED):
        at = middle[a : a + 4 * SCORED]
        kind, sub, u, v = (x[at].astype(np.int64) for x in (classes, subs, one, two))
        z = model.group_logits(kind, model.row_in(u, kind), model.row_in(v, kind))
        log_p = z[np.arange(len(z)), sub].astype(np.float64)
        out[at] += log_p - _log_sums(z)
    return out


def score_blocks(classified: DataFrame, model: Words, tokens: int) -> DataFrame:
    shared = classified.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            for r in b.itertuples(index=False):
                sizes, classes, codes = _unblock(r)
                score = np.minimum(0.0, _ragged_sums(_log_p(model, sizes, classes, codes), sizes) / math.log(10) + np.frombuffer(r.share, "<f8"))
                learn = np.frombuffer(r.learn, np.uint8)
                yield pd.DataFrame({"doc_id": pd.array(json.loads(r.ids), dtype="Int64"), "held_out": learn == 0, "n_tokens": sizes, "n_known": np.frombuffer(r.known, "<i8"), "train_tokens": tokens, "base_score": np.frombuffer(r.base, "<f8"), "score": score})

    return classified.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(documents: DataFrame, learn: Column) -> DataFrame:
    """Learn from the rows that ``learn`` allows; score all."""
    buckets = max(8, documents.count() // ROWS_PER_BUCKET)
    numbered = materialize(number(documents, learn, buckets), "numbered")
    counted = materialize(numbered.where("kind = 'word'").groupBy("bucket").applyInPandas(_count_bucket, "kind string, key long, word binary, data binary, n long, types long"), "counted")
    lex = lexicon(counted)
    classified = materialize(classify(numbered, counted, lex), "classified")
    weights, _ = train(triples(classified))
    model, _ = train_words(classified, weights, lex)
    return score_blocks(classified, model, lex.tokens)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 7) != 2)
