"""SentencePiece encoding and decoding with the N best segmentations.

The pieces and scores of a model file span a lattice over a text. Forward Viterbi gives for
every position the best score from the start; these scores are the exact heuristic of an
A-star search backwards from the end, which takes out segmentations from the best on.

A space is written as U+2581, which stands at the start of pieces or in runs only. So no
piece crosses into a new run of them, the lattice falls apart there, and a text's best
segmentation is that of its units one after the other. Units are solved once for
each task, all new ones of a batch together; the N best of a text combine those of the units whose second
best costs least.

A model of merges has no likelihoods: the best segmentation by its scores isn't what its merges give.

Defined cases: a null or empty text has no pieces, one segmentation with score 0, and decodes to the empty
text. A character without a piece is written as its bytes. U+2581 in a text decodes to a space. A text of any length
is encoded whole; a million characters without a space take tens of seconds. Segmentations of equal score come in
any order, each once. Repeated rows are encoded each on its own; an empty table gives an empty one. Of extra columns none is read.
"""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import table

SPACE = "▁"
N_BEST = 3
MODEL = "piece_bpe_32k.model"
#: A character without a piece costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Units of more bytes are solved one by one.
LONG_UNIT = 48
#: A task forgets its units beyond this many.
UNITS_KEPT = 250_000
TEXTS_AT_ONCE = 256


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[bytes, int, float], ...]  # text, id, score
    byte_ids: tuple[int, ...]

    @property
    def unknown(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY


def load(path: str) -> Vocabulary:
    """The normal pieces and the byte pieces of a model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, by_byte = [], {}
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            by_byte[int(m.id_to_piece(i)[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            plain.append((m.id_to_piece(i).encode(), i, float(m.get_score(i))))
    return Vocabulary(tuple(plain), tuple(by_byte[b] for b in range(256)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def units(text: str) -> list[str]:
    """The text cut before each run of spaces; a unit is given without its first space (which the first one gets besides)."""
    text = text.replace(SPACE, " ")
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return parts
    # An empty part is a further space of the unit that comes next, or of a last one.
    out, spaces = [], ""
    for p in parts[:-1]:
        if p:
            out.append(spaces + p)
            spaces = ""
        else:
            spaces += " "
    out.append(spaces + parts[-1])
    return out


def unit_bytes(unit: str) -> bytes:
    return (SPACE + unit).replace(" ", SPACE).encode("utf-8", "surrogatepass")


class Lattice:
    """The scalar form, for any text: forward Viterbi and backward A-star."""

    def __init__(self, vocabulary: Vocabulary):
        self.by_text = {p: (i, s) for p, i, s in vocabulary.pieces}
        self.longest = max(map(len, self.by_text), default=1)
        self.byte_ids, self.unknown = vocabulary.byte_ids, vocabulary.unknown
        self.children: list[dict[int, int]] = [{}]
        self.piece: list[tuple[int, float] | None] = [None]
        for text, i, s in vocabulary.pieces:
            at = 0
            for b in text:
                to = self.children[at].get(b)
                if to is None:
                    to = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                at = to
            self.piece[at] = (i, s)

    def ending(self, data: bytes, b: int) -> list[tuple[int, int, float]]:
        """The edges (start, id, score) that end at b, the start ascending; id -1 for a character's bytes."""
        out, get = [], self.by_text.get
        for a in range(max(0, b - max(4, self.longest)), b):
            if data[a] & 0xC0 != 0x80:
                if found := get(data[a:b]):
                    out.append((a, *found))
                elif self.character(data, a) == b:
                    out.append((a, -1, self.unknown))
        return out if b == len(data) or data[b] & 0xC0 != 0x80 else []

    @staticmethod
    def character(data: bytes, a: int) -> int:
        """Where the character that starts at a ends."""
        b = a + 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        return b

    def forward(self, data: bytes) -> array:
        """The best score from the start to each position."""
        n, children, piece = len(data), self.children, self.piece
        best = array("d", [0.0]) + array("d", [float("-inf")]) * n
        for a in range(n):
            if data[a] & 0xC0 == 0x80:
                continue
            own, node, at = best[a], 0, a
            first = self.character(data, a)
            whole = False
            while at < n:
                node = children[node].get(data[at])
                if node is None:
                    break
                at += 1
                if (found := piece[node]) and at >= first:
                    whole |= at == first
                    if own + found[1] > best[at]:
                        best[at] = own + found[1]
            if not whole and own + self.unknown > best[first]:
                best[first] = own + self.unknown
        return best

    def ids(self, data: bytes, edges: list[tuple[int, int, int]]) -> list[int]:
        out = []
        for a, b, i in edges:
            out.extend([i] if i >= 0 else [self.byte_ids[x] for x in data[a:b]])
        return out

    def n_best(self, data: bytes, n: int) -> list[tuple[float, list[int]]]:
        """Up to n segmentations from the best on: A-star from the end, with the forward scores as what remains.

        Each open path has a completion of exactly its estimate, so no more open paths are kept than segmentations are
        still wanted. Of equal ones that nearer to the start is taken first: where scores tie, as in a model of merges,
        the search runs through instead of spreading.
        """
        best, out = self.forward(data), []
        waiting: list[tuple[float, int, float, tuple | None]] = [(-best[-1], len(data), 0.0, None)]  # estimate, position, score so far, path
        while waiting and len(out) < n:
            _, b, score, path = waiting.pop(0)
            if b == 0:
                edges = []
                while path:
                    edges.append(path[0])
                    path = path[1]
                out.append((score, self.ids(data, edges)))
                continue
            for a, i, s in self.ending(data, b):
                if best[a] > float("-inf"):
                    waiting.append((-(best[a] + s + score), a, score + s, ((a, b, i), path)))
            waiting.sort(key=lambda w: w[:2])
            del waiting[n - len(out) :]
        return out


def combine(choices: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n largest sums of one number from each list (each in descending order), from the largest on, and the places taken."""
    start = tuple([0] * len(choices))
    heap, seen, out = [(-sum(c[0] for c in choices), start)], {start}, []
    while heap and len(out) < n:
        total, at = heapq.heappop(heap)
        out.append((-total, at))
        for j, c in enumerate(choices):
            if at[j] + 1 < len(c):
                to = (*at[:j], at[j] + 1, *at[j + 1 :])
                if to not in seen:
                    seen.add(to)
                    heapq.heappush(heap, (total + c[at[j]] - c[at[j] + 1], to))
    return out


class Encoder:
    """Solves units by the batch and puts texts together."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.lattice, self.n, self.unknown = Lattice(vocabulary), n, vocabulary.unknown
        nodes = self.lattice.children
        ids, scores = zip(*[p or (-1, 0.0) for p in self.lattice.piece], strict=True)
        # Rows that are never used stay unmapped memory.
        self.child = np.zeros((len(nodes), 256), dtype=np.int32)
        for at, row in enumerate(nodes):
            for b, to in row.items():
                self.child[at, b] = to
        self.id, self.score = np.array(ids, dtype=np.int32), np.array(scores)
        byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        self.byte_ids = byte_ids
        size = max([int(self.id.max(initial=0)), int(byte_ids.max(initial=0))]) + 1
        self.text_of = [b""] * size
        for text, i, _ in vocabulary.pieces:
            self.text_of[i] = text
        for b, i in enumerate(vocabulary.byte_ids):
            self.text_of[i] = bytes([b])
        self.forget()

    def forget(self) -> None:
        self.places: defaultdict[str, int] = defaultdict(count().__next__)
        self.solved = 0
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.best, self.gap = np.empty(0), np.empty(0)
        self.lists: dict[int, list[tuple[float, list[int]]]] = {}

    def solve(self) -> None:
        """Segment the units that are new since the last call."""
        names = list(self.places)
        new = [unit_bytes(u) for u in names[self.solved :]]
        if not new:
            return
        sizes, starts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        best, gap, flat, end = np.zeros(len(new)), np.zeros(len(new)), [self.flat], len(self.flat)
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        for i in np.flatnonzero(lengths > LONG_UNIT).tolist():
            found = self.lists[self.solved + i] = self.lattice.n_best(new[i], max(2, self.n))
            score, ids = found[0]
            best[i], gap[i] = score, score - found[1][0] if len(found) > 1 else np.inf
            starts[i], sizes[i] = end, len(ids)
            flat.append(np.array(ids, dtype=np.int32))
            end += len(ids)
        short = np.argsort(lengths, kind="stable")
        short = short[lengths[short] <= LONG_UNIT]
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            ids, sizes[part], best[part], gap[part] = self._many([new[i] for i in part.tolist()])
            starts[part] = end + np.cumsum(sizes[part]) - sizes[part]
            flat.append(ids)
            end += len(ids)
        self.flat, self.starts, self.sizes = np.concatenate(flat), np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))
        self.best, self.gap = np.concatenate((self.best, best)), np.concatenate((self.gap, gap))
        self.solved = len(names)

    def _many(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For units of similar length: the best ids one after the other, how many, their score, what the second best costs more."""
        n, width = len(data), max(map(len, data))
        text = np.zeros((n, width + 1), dtype=np.uint8)
        size = np.array([len(d) for d in data])
        text[:, :width] = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), dtype=np.uint8).reshape(n, width)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), dtype=np.int32)  # where the best edge to here starts
        edge = np.full((n, width + 1), -1, dtype=np.int32)  # its id
        edges = []
        inside = (text & 0xC0) == 0x80
        for a in range(width):
            rows = np.flatnonzero((size > a) & ~inside[:, a])
            if not len(rows):
                continue
            state, b, alive = np.zeros(len(rows), dtype=np.int32), a, rows
            while len(alive):
                state = self.child[state, text[alive, b]]
                b += 1
                within = (state > 0) & (b <= size[alive])
                alive, state = alive[within], state[within]
                hit = self.id[state] >= 0
                if hit.any():
                    edges.append(self._relax(best, back, edge, alive[hit], a, b, self.score[state[hit]], self.id[state[hit]]))
                if b > width:
                    break
            # The end of each first character, and whether it is a piece.
            end = np.full(len(rows), a + 1)
            for _ in range(3):
                more = inside[rows, np.minimum(end, width)] & (end < size[rows])
                end = end + more
            for e in np.unique(end):
                at = rows[end == e]
                s = np.zeros(len(at), dtype=np.int32)
                ok = np.ones(len(at), dtype=bool)
                for k in range(a, e):
                    s = np.where(ok, self.child[s, text[at, k]], 0)
                    ok &= s > 0
                at = at[~ok | (self.id[s] < 0)]
                if len(at):
                    edges.append(self._relax(best, back, edge, at, a, int(e), np.full(len(at), self.unknown), np.full(len(at), -1, dtype=np.int32)))
        # Scores from each position to the end, and the best path with another edge in it.
        rest = np.full((n, width + 1), -np.inf)
        every = np.arange(n)
        rest[every, size] = 0
        for rows, a, b, s, _ in sorted(edges, key=lambda e: -e[1]):
            rest[rows, a] = np.maximum(rest[rows, a], rest[rows, b] + s)
        path_start = np.full((n, width + 1), -1, dtype=np.int32)
        path_id = np.full((n, width + 1), -1, dtype=np.int32)
        steps, at = [], size.copy()
        while True:
            rows = np.flatnonzero(at > 0)
            if not len(rows):
                break
            b = at[rows]
            path_start[rows, b], path_id[rows, b] = back[rows, b], edge[rows, b]
            steps.append((rows, back[rows, b].copy(), b, edge[rows, b].copy()))
            at[rows] = back[rows, b]
        second = np.full(n, -np.inf)
        for rows, a, b, s, i in edges:
            through = best[rows, a] + s + rest[rows, b]
            other = (path_start[rows, b] != a) | (path_id[rows, b] != i)
            rows = rows[other]
            second[rows] = np.maximum(second[rows], through[other])
        total = best[every, size]
        # The edges of all best paths in order; an edge of bytes becomes as many ids.
        k = np.zeros(n, dtype=np.int64)
        for rows, *_ in steps:
            k[rows] += 1
        first = np.cumsum(k) - k
        path = np.empty((3, int(k.sum())), dtype=np.int64)
        for step, (rows, starts, ends, ids) in enumerate(steps):
            path[:, first[rows] + k[rows] - 1 - step] = starts, ends, ids
        wide = np.where(path[2] >= 0, 1, path[1] - path[0])
        out, row = np.repeat(path[2], wide), np.repeat(np.repeat(every, k), wide)
        at = np.repeat(path[0] - (np.cumsum(wide) - wide), wide) + np.arange(len(out))
        raw = out < 0
        out[raw] = self.byte_ids[text[row[raw], at[raw]]]
        return out.astype(np.int32), np.add.reduceat(wide, first), total, total - second

    @staticmethod
    def _relax(best, back, edge, rows, a, b, score, ids):
        s = best[rows, a] + score
        up = s > best[rows, b]
        at = rows[up]
        best[at, b], back[at, b], edge[at, b] = s[up], a, ids[up]
        return rows, a, b, score, ids

    def alternatives(self, unit: int, names: list[str]) -> list[tuple[float, list[int]]]:
        """A unit's n best segmentations: scores and ids."""
        found = self.lists.get(unit)
        if found is None:
            found = self.lists[unit] = self.lattice.n_best(unit_bytes(names[unit]), self.n)
        return found

    def texts(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """The n best segmentations of each text, from the best on: scores and ids."""
        if len(self.places) > UNITS_KEPT:
            self.forget()
        codes = []
        for t in texts:
            parts = units(t) if t else []
            codes.append(np.fromiter(map(self.places.__getitem__, parts), dtype=np.int64, count=len(parts)))
        self.solve()
        names, out = list(self.places), []
        for c in codes:
            if not len(c):
                out.append([(0.0, np.empty(0, np.int32))])
                continue
            gap, sizes = self.gap[c], self.sizes[c]
            ends = np.cumsum(sizes)
            ids = self.flat[np.repeat(self.starts[c] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
            # An alternative of the text changes the units whose second best costs least: n - 1 of them at most.
            k = min(self.n - 1, len(c))
            near = np.argpartition(gap, k - 1)[:k] if k else np.empty(0, int)
            near = sorted(int(j) for j in near if np.isfinite(gap[j]))
            lists = [self.alternatives(int(c[j]), names) for j in near]
            base = float(self.best[c].sum()) - sum(x[0][0] for x in lists)
            found = []
            for total, taken in combine([[score for score, _ in x] for x in lists], self.n):
                parts, at = [], 0
                for j, x, place in zip(near, lists, taken, strict=True):
                    if place:
                        parts += [ids[at : ends[j] - sizes[j]], np.array(x[place][1], dtype=np.int32)]
                        at = ends[j]
                found.append((base + total, np.concatenate([*parts, ids[at:]]) if parts else ids))
            out.append(found)
        return out

    def decode(self, ids: list[int]) -> str:
        return decode(self.text_of, ids)


def decode(text_of: list[bytes], ids: list[int]) -> str:
    data = b"".join(map(text_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return data[1:]  # the space that encoding puts first


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


@lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary, n: int) -> Encoder:
    return Encoder(vocabulary, n)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = N_BEST, model: str | None = None) -> DataFrame:
    """The key, n_pieces, ids, nbest_ids and nbest_scores (from the best on, ``ids`` first) and round_trip: whether the ids decode to the text."""
    if n < 1:
        raise ValueError("n must be at least 1")
    source = documents.select(F.col(key), F.col(text).cast("string").alias("_text"))
    ids_type = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField(key, source.schema[key].dataType), T.StructField("n_pieces", T.LongType()), T.StructField("ids", ids_type), T.StructField("nbest_ids", T.ArrayType(ids_type, False)), T.StructField("nbest_scores", T.ArrayType(T.DoubleType(), False)), T.StructField("round_trip", T.BooleanType())])
    vocabulary = source.sparkSession.sparkContext.broadcast(load(model or default_model()))  # 32,000 pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, n)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b = whole.slice(at, TEXTS_AT_ONCE)
                texts = b.column(1).to_pylist()
                found = encoder.texts(texts)
                best = [f[0][1] for f in found]
                same = [encoder.decode(x.tolist()) == (t or "").replace(SPACE, " ") for x, t in zip(best, texts, strict=True)]
                every = [ids for f in found for _, ids in f]
                scores = pa.array([[score for score, _ in f] for f in found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) for x in best], pa.int64()), _lists(best), pa.ListArray.from_arrays(scores.offsets, _lists(every)), scores, pa.array(same)],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def decoder(spark: SparkSession, model: str | None = None):
    """A column function: the text of an array of ids (null for null)."""
    vocabulary = spark.sparkContext.broadcast(load(model or default_model()))

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        text_of = _encoder(vocabulary.value, N_BEST).text_of
        return pa.array([None if x is None else decode(text_of, x) for x in ids.to_pylist()], pa.string())

    return run


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document."""
    return encode(docs)
