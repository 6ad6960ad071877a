"""Byte-level byte-pair encoding from a file of ranks, and its decoding.

The file has bytes and ranks, no merges: each token's last merge is found by merging its own bytes with lower ranks only.
In a text the two neighbours that become a token are always these same two, because whatever could have been merged inside
the token's bytes was merged before, as if they stood alone. So the merges in order of rank, with whole matches looked up
first, give the tokens that the ranks themselves give. The tokenizers library works on characters:
each byte has one (printable ones their own, the others the next free ones from U+0100), and a token is spelled in them.

Encoding runs over Arrow batches; a task holds a batch and works on a slice of it at a time. Texts are cut where no token can
go on (``chunks``), and each chunk is encoded once a slice, or not again while a process knows it. Nothing is shuffled. A token's place is given in bytes' characters: ``starts`` and ``ends`` count code points, and a token that
has part of a character only takes it in whole, so neighbours that share a character overlap. Decoding turns
each token's characters to bytes by the reversed table; ids from the middle of a text may begin or end inside a
character, and the bytes of such a one are counted apart (``head``, ``tail``) from the whole characters between.

Defined results: a null text counts as empty and has no ids; null ids decode to null, no ids to no bytes; an id that the file doesn't
have is an error. Text that looks like a special token is ordinary text. Texts of any length are encoded whole. Equal
rows give equal rows, an empty table none. Only the two columns named are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

#: Characters that a call of the library takes, and rows that are worked on at once, but for a longer text.
CALL_CHARS, SLICE_CHARS = 200_000, 1_000_000
#: Chunks of text whose ids a process keeps (twice as many at most), and how long they may be.
KEPT_CHUNKS, KEPT_CHARS = 200_000, 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character of each byte."""
    printable = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def spell(token: bytes) -> str:
    """A token's bytes as characters."""
    return token.decode("latin-1").translate(_SPELLING)


def unspell(token: str) -> bytes:
    return token.translate(_BYTES).encode("latin-1")


_SPELLING = dict(enumerate(byte_characters()))
_BYTES = {ord(c): b for b, c in _SPELLING.items()}


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines()) if token}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that become this one, found with lower ranks only; None if merging doesn't lead to it."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's tokenizer of these ranks, as text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pairs = [last_merge(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in filter(None, pairs)], ignore_merges=True)
    out = Tokenizer(model)
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    out.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out.to_str()


def chunks(text: str, pattern: str) -> list[str]:
    """Parts of a text whose tokens are those of the whole.

    The pattern given has no match that goes on from a character to white space, and none looks back; so a text may be cut
    between a character and a space or line end. Another pattern's texts stay whole.
    """
    return _CUT.split(text) if pattern == default_pattern() else [text]


#: White space of all kinds counts as such on the left, only that which every library takes for it on the right.
_CUT = re.compile(r"(?<=\S)(?=[\x20\x09-\x0D])")


class Codec:
    """One tokenizer in a task's process: texts to ids, ids to bytes. Short chunks that were met lately are kept, up to a number of them."""

    def __init__(self, source: str, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has the cores that Spark gives it
        from tokenizers import Tokenizer

        self.tokenizer, self.pattern = Tokenizer.from_str(source), pattern or default_pattern()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes: list[bytes | None] = [None] * (1 + max(vocabulary.values(), default=-1))
        for token, i in vocabulary.items():
            self.bytes[i] = unspell(token)
        self.sizes = np.array([len(b or b"") for b in self.bytes], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; each new chunk is encoded once."""
        parts = [chunks(t, self.pattern) for t in texts]
        if len(self.known) > KEPT_CHUNKS:  # what wasn't met since the last time goes
            self.before, self.known = self.known, {}
        ids, before = self.known, self.before
        new: list[str] = []
        for chunk in {c for p in parts for c in p}.difference(ids):
            if (kept := before.get(chunk)) is not None:
                ids[chunk] = kept
            else:
                new.append(chunk)
        begin = 0
        while begin < len(new):
            end, chars = begin, 0
            while end < len(new) and (end == begin or chars + len(new[end]) <= CALL_CHARS):
                chars += len(new[end])
                end += 1
            call = new[begin:end]
            for chunk, e in zip(call, self.tokenizer.encode_batch_fast(call, add_special_tokens=False), strict=True):
                ids[chunk] = np.array(e.ids, dtype="<u4").tobytes()
            begin = end
        out = [np.frombuffer(b"".join(map(ids.__getitem__, p)), dtype="<u4") for p in parts]
        for chunk in new:
            if len(chunk) > KEPT_CHARS:
                del ids[chunk]
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each token, and the one after its last; a character that is split belongs to each of its tokens."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.sizes[ids])
        return character[ends - self.sizes[ids]], character[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        try:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        except (IndexError, TypeError):
            raise ValueError("an id that the vocabulary doesn't have") from None


def split_ends(data: bytes) -> tuple[int, int]:
    """Bytes at the beginning and at the end that belong to a character which isn't whole."""
    head = 0
    while head < min(3, len(data)) and data[head] & 0xC0 == 0x80:
        head += 1
    for back in range(1, min(4, len(data) - head + 1)):
        byte = data[-back]
        if byte & 0xC0 != 0x80:
            wanted = 1 if byte < 0x80 else 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
            return head, back if back < wanted else 0
    return head, 0


@cache
def _codec(source: str, pattern: str | None) -> Codec:
    return Codec(source, pattern)


def _source(spark: SparkSession, ranks: str | None, pattern: str | None):
    """The tokenizer for the tasks: as large as the file of ranks, whatever the documents."""
    pattern = pattern or default_pattern()
    return spark.sparkContext.broadcast((tokenizer_json(read_ranks(ranks or default_ranks()), pattern), pattern))


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of a column; a longer value is a part of its own."""
    size = pc.coalesce(pc.binary_length(batch.column(column)) if pa.types.is_string(batch.column(column).type) else pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.concatenate(([0], np.cumsum(size)))[:-1] // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _id_type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str | None = None, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """(id, ids, starts, ends) of every row; without offsets (id, ids)."""
    shared = _source(docs.sparkSession, ranks, pattern)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in (part for b in batches for part in _slices(b, "text", SLICE_CHARS)):
            texts = batch.column("text").to_pylist()
            ids = codec.encode(texts)
            columns = [batch.column("id"), _lists(ids, pa.int32())]
            if offsets:
                found = [codec.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                columns += [_lists([s for s, _ in found], pa.int32()), _lists([e for _, e in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "starts", "ends"][: len(columns)])

    places = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(run, f"id {_id_type(docs, id_column)}, ids array<int>{places}")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.array([])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32), kind))


def decode(encoded: DataFrame, id_column: str = "id", ids_column: str = "ids", ranks: str | None = None) -> DataFrame:
    """(id, ids, bytes, text, head, tail): the bytes of the ids, the whole characters among them, and how many bytes before and after those are parts of one."""
    shared = _source(encoded.sparkSession, ranks, None)
    rows = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in (part for b in batches for part in _slices(b, "ids", SLICE_CHARS)):
            lists = batch.column("ids")
            data = [codec.decode(np.asarray(x.values.to_numpy(zero_copy_only=False))) if x.is_valid else None for x in lists]
            ends = [split_ends(d) if d is not None else (None, None) for d in data]
            text = [d[h : len(d) - t].decode("utf-8", "replace") if d is not None else None for d, (h, t) in zip(data, ends, strict=True)]
            columns = [batch.column("id"), lists, pa.array(data, pa.binary()), pa.array(text, pa.string()), pa.array([h for h, _ in ends], pa.int32()), pa.array([t for _, t in ends], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "bytes", "text", "head", "tail"])

    return rows.mapInArrow(run, f"id {_id_type(encoded, id_column)}, ids array<int>, bytes binary, text string, head int, tail int")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text is encoded and its ids decoded again in one task, and only digests leave it.

    Ids are hashed as little-endian unsigned 32-bit integers.
    """
    shared = _source(docs.sparkSession, ranks, pattern)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in (part for b in batches for part in _slices(b, "text", SLICE_CHARS)):
            ids = codec.encode(batch.column("text").to_pylist())
            hashed = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
            back = [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids]
            columns = [batch.column("id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"id {_id_type(docs, id_column)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
