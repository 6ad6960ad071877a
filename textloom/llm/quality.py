"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good or bad from features of its own and of its neighbours; transition
weights tie neighbouring labels. The forward-backward marginals of a text's lines,
weighted by their lengths, are its quality.

Features are shares of kinds of characters, word lengths, variety and repetition, cut into
steps, so that weights can follow any shape. Training marks every line of a labelled text
with the text's label and climbs the penalised likelihood of the label sequences.

Defined cases: a null or empty text is one empty line; every line weighs its length plus one.
With labels of one kind only the score is that label's smoothed share. Repeated rows are
scored each on its own; of extra columns none is read. Equal texts have equal scores. A text of any number of lines is
scored whole, in memory of some hundred bytes a line. Empty tables give no rows; without labels every score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import id_bucket, labelled_sample, table

#: Labelled rows that the field is fitted on, at most.
SAMPLE_ROWS = 6000
#: From this score on a text counts as good.
THRESHOLD = 0.3
RIDGE = 0.5
ROUNDS = 150

#: Bounds of the steps of each feature.
STEPS = {
    "upper": (0.02, 0.05, 0.1, 0.3, 0.7),  # of ASCII letters
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.2),  # of bytes: those that aren't letters, digits, stops or space
    "digits": (0.01, 0.05, 0.2),
    "stops": (0.005, 0.015, 0.03, 0.08),  # . , ; : ? of bytes
    "spaces": (0.08, 0.13, 0.17, 0.22, 0.3),
    "word": (2.5, 3.5, 4.5, 5.5, 7.0, 10.0),  # bytes a word
    "variety": (0.1, 0.3, 0.5, 0.7, 0.9),  # distinct words of all
    "twins": (0.02, 0.1, 0.4),  # words equal to the word before
    "length": (1, 30, 100, 300, 1000),
    "repeat": (0.5,),  # the same line stood before
}
_LETTERS_UPPER = bytes(range(65, 91))
_LETTERS = _LETTERS_UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_STOPS = b".,;:?"
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + _STOPS)
_BOUNDS = [np.asarray(b) for b in STEPS.values()]
OWN = sum(len(b) + 1 for b in _BOUNDS)
#: Bias, own steps, those of the line before and after, and no line before or after.
WIDTH = 1 + 3 * OWN + 2


def line_values(lines: list[bytes]) -> np.ndarray:
    """The raw features of the lines of one text."""
    seen: set[bytes] = set()
    out = np.zeros((len(lines), len(STEPS)), dtype=np.float64)
    for i, line in enumerate(lines):
        n = len(line)
        out[i, 9] = line in seen
        if not n:
            continue
        seen.add(line)
        words = line.split()
        upper, letters = n - len(line.translate(None, _LETTERS_UPPER)), n - len(line.translate(None, _LETTERS))
        k = len(words) or 1
        out[i, :9] = (
            upper / letters if letters else 0.0,
            (n - len(line.translate(None, _SYMBOLS))) / n,
            (n - len(line.translate(None, _DIGITS))) / n,
            (n - len(line.translate(None, _STOPS))) / n,
            line.count(b" ") / n,
            sum(map(len, words)) / k,
            len(set(words)) / k,
            sum(map(bytes.__eq__, words, words[1:])) / k,
            n,
        )
    return out


def own_columns(values: np.ndarray) -> np.ndarray:
    """For each line the active column of each feature."""
    out, base = np.empty(values.shape, dtype=np.int64), 0
    for j, bounds in enumerate(_BOUNDS):
        out[:, j] = base + np.searchsorted(bounds, values[:, j], side="right")
        base += len(bounds) + 1
    return out


def columns(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The active columns of each line, and the lines' weights."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    own = own_columns(line_values(lines))
    n, k = own.shape
    edge = np.full((1, k), -1)
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    none_before, none_after = 1 + 3 * OWN, 2 + 3 * OWN
    parts = [
        np.zeros((n, 1), dtype=np.int64),
        1 + own,
        np.where(before >= 0, 1 + OWN + before, none_before),
        np.where(after >= 0, 1 + 2 * OWN + after, none_after),
    ]
    return np.hstack(parts), np.array([len(x) + 1 for x in lines], dtype=np.float64)


@dataclass
class Field:
    weights: np.ndarray  # of a good line over a bad one, by column
    same: float  # of a label like the one before over another one

    def marginals(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line of all texts together, the starts of the texts, and P(a line's label is like the one before)."""
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        score = self.weights[np.concatenate(texts)].sum(axis=1)
        return (*_forward_backward(score, starts, sizes, self.same), starts)

    def quality(self, text: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        good, _, starts = self.marginals(text)
        by_line = np.concatenate(weights)
        return np.clip(np.add.reduceat(good * by_line, starts) / np.add.reduceat(by_line, starts), 0, 1)


def _forward_backward(score: np.ndarray, starts: np.ndarray, sizes: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds recursions over all chains at once, one step a line.

    With two labels a message is one number, its log-odds; a step through the
    transition is f(x) = log((e^(x+s) + 1) / (e^x + e^s)).
    """
    order = np.argsort(-sizes, kind="stable")
    by_size, first = sizes[order], starts[order]
    ahead, back = np.zeros_like(score), np.zeros_like(score)

    def through(x: np.ndarray) -> np.ndarray:
        return np.logaddexp(x + same, 0) - np.logaddexp(x, same)

    longest = int(by_size[0])
    # How many chains have a line t.
    alive = np.searchsorted(-by_size, -np.arange(longest), side="left")
    for t in range(1, longest):
        at = first[: alive[t]] + t
        ahead[at] = through(ahead[at - 1] + score[at - 1])
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        back[at] = through(back[at + 1] + score[at + 1])
    good = 1 / (1 + np.exp(-np.clip(ahead + score + back, -60, 60)))
    alike = np.ones_like(score)
    inner = np.ones(len(score), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    left, right = ahead[at - 1] + score[at - 1], score[at] + back[at]
    equal = np.logaddexp(left + right, 0) + same
    alike[at] = 1 / (1 + np.exp(np.clip(np.logaddexp(left, right) - equal, -60, 60)))
    return good, alike


def fit_rows(texts: list[str], labels: list[int]) -> Field:
    """Gradient ascent with a step for each weight (RMS of its gradients)."""
    weights, same = np.zeros(WIDTH), 0.0
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        weights[0] = np.log(share / (1 - share))
        return Field(weights, same)
    made = [columns(t) for t in texts]
    cols = [c for c, _ in made]
    sizes = np.array([len(c) for c in cols])
    # A text counts as one, however many lines it has.
    share = np.repeat(1 / sizes, sizes)
    flat, target = np.concatenate(cols), np.repeat(y, sizes)
    inner = np.ones(len(flat), dtype=bool)
    inner[np.concatenate(([0], np.cumsum(sizes)))[:-1]] = False
    square, mean = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for k in range(1, ROUNDS + 1):
        good, alike, _ = Field(weights, same).marginals(cols)
        slope = np.bincount(flat.ravel(), np.repeat((target - good) * share, flat.shape[1]), minlength=WIDTH) - RIDGE * weights
        both = np.append(slope, ((1 - alike) * share)[inner].sum() - RIDGE * same * 10)
        mean = 0.9 * mean + 0.1 * both
        square = 0.99 * square + 0.01 * both * both
        step = 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        weights, same = weights + step[:-1], float(np.clip(same + step[-1], 0.0, 3.0))
    return Field(weights, same)


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, keep: Column | None = None) -> Field:
    """Fit on at most ``bound`` labelled rows that ``keep`` (of doc_id) allows."""
    rows = labelled_sample(documents, labels, "quality", bound, keep).toPandas().sort_values("text", kind="stable")
    return fit_rows(rows["text"].tolist(), rows["label"].tolist())


def scorer(field: Field):
    """A column function: the quality of a text, from 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.empty(len(texts))
            for at in range(0, len(texts), 512):
                made = [columns(t) for t in texts.iloc[at : at + 512]]
                out[at : at + len(made)] = field.quality([c for c, _ in made], [w for _, w in made])
            yield pd.Series(out)

    return lambda text: run(text.cast("string"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(documents, table(spark, sf_dir, "labels"), keep=id_bucket(F.col("doc_id"), 5) != 0)
    scored = documents.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), scorer(field)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
