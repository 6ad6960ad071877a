"""Token counts without token ids.

A byte-level tokenizer merges within pre-tokens only, so a text has as many tokens as its
pre-tokens have pieces. Pieces are counted once for each distinct pre-token and joined
to the pre-token frequencies of the texts:

1. a task counts the pre-tokens of its texts. Those that are common in its block of texts it
   counts on the spot; of the others it sends each text's frequencies to the bucket of
   the pre-token, packed by block;
2. a bucket has all there is of its pre-tokens: it counts each once and returns to each block what
   it adds to its texts;
3. a block adds up.

So a pre-token that a third of all texts hold never meets in one task, and what is shuffled is a
few bytes for each rare pre-token and text.

Defined cases: a null text counts as empty, with 0 tokens; special strings in a text are one
token each, as by the tokenizer's default. Repeated rows are counted each on its own; of extra
columns none is read. A long text is a block of its own and counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

MODEL = "byte_bpe_50k.json"
LIMIT = 512
#: A block ends at so many characters or texts.
BLOCK_CHARS = 16_000_000
BLOCK_TEXTS = 30_000
#: A pre-token in more texts of a block than this share is counted in the block.
COMMON = 0.002
#: Rows of a table that one bucket stands for.
ROWS_PER_BUCKET = 4000

#: Fixed value: the pre-token pattern of byte-level tokenizers, with Unicode's white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Counter:
    """Pre-tokens and their pieces under one tokenizer."""

    def __init__(self, source: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        special = [t["content"] for t in json.loads(source).get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall
        # Three white spaces with a plain space in the middle: how they are cut depends on more than one part.
        self.spaced = regex.compile(r"\p{White_Space} \p{White_Space}").search

    def parts(self, text: str) -> tuple[int, list[str]]:
        """How many special strings a text has, and its parts.

        A part is cut at each plain space and holds the space before it; parts give the
        pre-tokens of the text, one part after the other. A text in which spaces meet
        is cut to pre-tokens at once.
        """
        pieces = [text]
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
        out: list[str] = []
        for p in pieces:
            if not p:
                continue
            if self.spaced(p):
                out.extend(self.find(p))
            else:
                first, *rest = p.split(" ")
                if first:
                    out.append(first)
                out.extend([" " + r for r in rest])
        return len(pieces) - 1, out

    def count(self, pretokens: list[str]) -> np.ndarray:
        self.tokenizer.encode_special_tokens = True
        return np.array([len(e.ids) for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)], dtype=np.int64) if pretokens else np.empty(0, np.int64)


@lru_cache(maxsize=2)
def _counter(source: str) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(source)


#: Before a block's own numbers; counts begin with how many there are, which is never 0.
_HEAD = b"\0\0\0\0"


def _pack(*arrays: np.ndarray) -> bytes:
    """Length, then the arrays, as 32-bit numbers."""
    return np.concatenate([np.array([len(arrays[0])]), *arrays]).astype("<u4").tobytes()


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Block:
    """The texts of a block: what is counted at once, and what goes to the buckets."""

    def __init__(self, counter: Counter, block: int, buckets: int):
        self.counter, self.block, self.buckets = counter, block, buckets
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.bytes: list[int] = []
        self.special: list[int] = []
        self.codes: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        n, parts = self.counter.parts(text or "")
        self.ids.append(doc_id)
        self.bytes.append(len((text or "").encode("utf-8", "surrogatepass")))
        self.special.append(n)
        self.codes.append(np.fromiter(map(self.place.__getitem__, parts), dtype=np.int32, count=len(parts)))
        self.chars += len(text or "") + 50

    def rows(self) -> Iterator[tuple]:
        n, parts = len(self.ids), list(self.place)
        found = [self.counter.find(p) for p in parts]
        name: defaultdict[str, int] = defaultdict(count().__next__)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((name[x] for f in found for x in f), dtype=np.int64, count=int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        lengths = np.fromiter(map(len, self.codes), dtype=np.int64, count=n)
        codes = np.concatenate(self.codes)
        self.codes = []
        owner = np.repeat(np.arange(n), lengths)
        tokens = flat[_ragged(starts[codes], sizes[codes])]
        owner = np.repeat(owner, sizes[codes])
        del codes
        # (pre-token, text) pairs and how often each is.
        pair, times = np.unique(tokens * n + owner, return_counts=True)
        token, doc = pair // n, pair % n
        pretokens = list(name)
        spread = np.bincount(token, minlength=len(pretokens))
        common = spread > COMMON * n
        pieces = np.zeros(len(pretokens), dtype=np.int64)
        at = np.flatnonzero(common)
        pieces[at] = self.counter.count([pretokens[i] for i in at])
        total = np.bincount(doc, times * pieces[token], minlength=n).astype(np.int64) + np.array(self.special, dtype=np.int64)
        yield (self.block % self.buckets, self.block, "", _HEAD + json.dumps([[i, b, int(t)] for i, b, t in zip(self.ids, self.bytes, total, strict=True)]).encode())
        rare = np.flatnonzero(~common)
        if not len(rare):
            return
        bucket = (pd.util.hash_array(np.array([pretokens[i] for i in rare], dtype=object)) % np.uint64(self.buckets)).astype(np.int64)
        first, end = np.searchsorted(token, rare), np.searchsorted(token, rare, side="right")
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0, [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = order[a:b]
            width = (end - first)[some]
            where = _ragged(first[some], width)
            names = [pretokens[i] for i in rare[some]]
            yield (int(bucket[some[0]]), self.block, "".join(names), _pack(np.array(list(map(len, names))), width, doc[where], times[where]))


def _count_bucket(counter: Counter, rows: pd.DataFrame) -> pd.DataFrame:
    """Each pre-token of a bucket is counted once; each block gets what its texts have of them."""
    place: defaultdict[str, int] = defaultdict(count().__next__)
    out, waiting = [], []
    for block, names, data in zip(rows["block"], rows["names"], rows["data"], strict=True):
        if data[:4] == _HEAD:
            out.append((block, data))
            continue
        x = np.frombuffer(data, dtype="<u4").astype(np.int64)
        n = int(x[0])
        ends = np.cumsum(x[1 : 1 + n])
        codes = np.fromiter((place[names[a:b]] for a, b in zip((ends - x[1 : 1 + n]).tolist(), ends.tolist(), strict=True)), dtype=np.int64, count=n)
        waiting.append((block, codes, x[1 + n : 1 + 2 * n], x[1 + 2 * n :]))
    pieces = counter.count(list(place))
    for block, codes, width, rest in waiting:
        doc, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        docs, back = np.unique(doc, return_inverse=True)
        out.append((block, _pack(docs, np.bincount(back, times * np.repeat(pieces[codes], width)).astype(np.int64))))
    return pd.DataFrame(out, columns=["block", "data"])


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    head = next(json.loads(d[4:]) for d in rows["data"] if d[:4] == _HEAD)
    total = np.array([t for _, _, t in head], dtype=np.int64)
    for d in rows["data"]:
        if d[:4] != _HEAD:
            x = np.frombuffer(d, dtype="<u4").astype(np.int64)
            total[x[1 : 1 + x[0]]] += x[1 + x[0] :]
    return pd.DataFrame({"doc_id": pd.array([i for i, _, _ in head], dtype="Int64"), "n_bytes": [b for _, b, _ in head], "n_tokens": total})


def count_tokens(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, as the tokenizer file's library counts them."""
    source = Path(model or default_model()).read_text("utf-8")
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(source)  # a tokenizer file: its size doesn't depend on the documents
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = max(8, rows.count() // ROWS_PER_BUCKET)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, part, turn = _counter(shared.value), TaskContext.get().partitionId(), count()
        names = ["bucket", "block", "names", "data"]
        block = Block(counter, part << 24 | next(turn), buckets)
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                block.add(None if pd.isna(doc_id) else int(doc_id), text)
                if block.chars > BLOCK_CHARS or len(block.ids) >= BLOCK_TEXTS:
                    yield pd.DataFrame(list(block.rows()), columns=names)
                    block = Block(counter, part << 24 | next(turn), buckets)
        if block.ids:
            yield pd.DataFrame(list(block.rows()), columns=names)

    sent = rows.mapInPandas(send, "bucket long, block long, names string, data binary")
    counted = sent.groupBy("bucket").applyInPandas(lambda x: _count_bucket(_counter(shared.value), x), "block long, data binary")
    return counted.groupBy("block").applyInPandas(_add_up, "doc_id long, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
