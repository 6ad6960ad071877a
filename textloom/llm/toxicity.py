"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each is a logistic regression over word stems
and the probabilities of the categories before it. A later link is trained with
out-of-fold probabilities of the earlier ones, so that it sees them as they are on new texts.
The last category is the label itself.

The labels have one column, so the categories are learned too: the toxic training texts are clustered by the
stems they share, in KINDS groups, from the largest on. No word is listed anywhere.

Defined cases: a null or empty text has no stems, so its probabilities are those of the
intercepts; without labels of both kinds every probability is the share of positive labels, and without any label
no text is rejected.
Texts are scored whole, however long; a probability equal to the threshold rejects. Repeated rows are scored each on its own,
an empty table gives an empty one. Other columns are passed through ``score`` unless they
have the name of an output column.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import labelled_sample, table

#: Labelled rows that the chain is fitted on, at most.
SAMPLE_ROWS = 8000
STEMS = 200
STEM_CHARS = range(4, 9)
FOLDS = 3
RIDGE = 1.0
#: A text is rejected from this probability of the last category on.
THRESHOLD = 0.5

#: Groups of toxic training texts: the chain's first categories.
KINDS = 3
CATEGORIES = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxicity")

_PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})
_CACHE_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().translate(_PUNCTUATION).split()


def stems(word: str) -> list[str]:
    """Prefixes of some lengths, and the word itself with an end mark."""
    return [word[:k] for k in STEM_CHARS if k <= len(word)] + [f"{word[:24]}$"]


@dataclass
class Chain:
    columns: dict[str, int]  # stem -> place
    weights: list[np.ndarray] = field(default_factory=list)  # by category: intercept, stems, earlier categories
    threshold: float = THRESHOLD

    def features(self, counted: list[tuple[list[int], int]]) -> np.ndarray:
        """For each text: 1 for the intercept; whether a stem occurs; how often it does for the length."""
        k = len(self.columns)
        x = np.zeros((len(counted), 1 + 2 * k), dtype=np.float64)
        x[:, 0] = 1
        for row, (found, n) in enumerate(counted):
            for place, times in Counter(found).items():
                x[row, 1 + place] = 1
                x[row, 1 + k + place] = min(3.0, times * 100 / (n + 50))
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for i, w in enumerate(self.weights):
            out[:, i] = _sigmoid(x @ w[: x.shape[1]] + _logits(out[:, :i]) @ w[x.shape[1] :])
        return out

    def found(self, cache: dict[str, tuple[int, ...]], text: str | None) -> tuple[list[int], int]:
        words = words_of(text)
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        got: list[int] = []
        for w in words:
            places = cache.get(w)
            if places is None:
                places = cache[w] = tuple(self.columns[s] for s in stems(w) if s in self.columns)
            if places:
                got.extend(places)
        return got, len(words)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the intercept isn't penalised."""
    w = np.zeros(x.shape[1])
    mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w[0] = math.log(mean / (1 - mean))
    if y.min() == y.max():
        return w
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-2
    for _ in range(12):
        p = _sigmoid(x @ w)
        hessian = np.zeros((x.shape[1], x.shape[1]))
        for at in range(0, len(x), 1024):  # a part of the rows at a time, so that no copy of all is made
            part = x[at : at + 1024]
            hessian += (part * (p * (1 - p))[at : at + 1024, None]).T @ part
        hessian[np.diag_indices_from(hessian)] += ridge
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        largest = np.abs(step).max()
        w += step * min(1.0, 2.0 / max(largest, 1e-9))  # a long step overshoots where the classes can be told apart
        if largest < 1e-3:
            break
    return w


def select_stems(texts: list[str], toxic: np.ndarray) -> dict[str, int]:
    """The stems that tell the two kinds apart best, by chi-squared of their presence."""
    both = [(t, y) for t, y in zip(texts, toxic, strict=True)]
    df: Counter[str] = Counter()
    for text, y in both:
        if y:
            df.update({s for w in set(words_of(text)) for s in stems(w)})
    # Only stems that some toxic texts share are counted in the others.
    often = {s: a for s, a in df.items() if a >= 4}
    del df
    clean: Counter[str] = Counter()
    for text, y in both:
        if not y:
            clean.update({s for w in set(words_of(text)) for s in stems(w) if s in often})
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    ranked = []
    for s, a in often.items():
        b = clean.get(s, 0)
        if a * n0 <= b * n1:
            continue
        c, d = n1 - a, n0 - b
        ranked.append((-((a * d - b * c) ** 2) * len(toxic) / max(1, (a + b) * (c + d) * n1 * n0), s))
    return {s: i for i, (_, s) in enumerate(sorted(ranked)[:STEMS])}


def clusters(presence: np.ndarray, k: int = KINDS) -> np.ndarray:
    """A group for each row, by cosine similarity to the groups' means; the first centre is the mean, each further one the row least like those before.

    Rows without any stem are of the first group. Groups are numbered from the largest on.
    """
    x = presence / np.maximum(np.sqrt(presence.sum(axis=1, keepdims=True)), 1)
    centres = [x.mean(axis=0)]
    while len(centres) < k:
        unit = np.stack([c / max(np.linalg.norm(c), 1e-9) for c in centres])
        centres.append(x[int((x @ unit.T).max(axis=1).argmin())])
    group = np.zeros(len(x), dtype=int)
    for _ in range(30):
        unit = np.stack([c / max(np.linalg.norm(c), 1e-9) for c in centres])
        now = (x @ unit.T).argmax(axis=1)
        if (now == group).all():
            break
        group = now
        centres = [x[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(k)]
    order = np.argsort(-np.bincount(group, minlength=k), kind="stable")
    return np.argsort(order)[group]


def out_of_fold(inputs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row's probability by a regression on the other folds' rows; row i is of fold i mod FOLDS."""
    fold, held = np.arange(len(y)) % FOLDS, np.empty(len(y))
    for f in range(FOLDS):
        away = fold == f
        if away.any():
            held[away] = _sigmoid(inputs[away] @ _regress(inputs[~away], y[~away])) if (~away).any() else y.mean()
    return held


def fit_rows(texts: list[str], labels: list[int]) -> Chain:
    toxic = np.asarray(labels, dtype=int)
    chain = Chain(select_stems(texts, toxic) if len(texts) else {})
    if not len(texts):
        chain.weights = [np.array([0.0] * (1 + 2 * len(chain.columns) + i)) for i in range(len(CATEGORIES))]
        chain.threshold = np.inf  # nothing is known, so nothing is rejected
        return chain
    cache: dict[str, tuple[int, ...]] = {}
    x = chain.features([chain.found(cache, t) for t in texts])
    group = np.full(len(texts), -1)
    if toxic.any():
        group[toxic == 1] = clusters(x[toxic == 1, 1 : 1 + len(chain.columns)])
    marks = [group == g for g in range(KINDS)] + [toxic == 1]
    earlier = np.empty((len(texts), 0))
    for mark in marks:
        y = mark.astype(float)
        inputs = np.hstack([x, _logits(earlier)])
        chain.weights.append(_regress(inputs, y))
        earlier = np.column_stack([earlier, out_of_fold(inputs, y)])
    return chain


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Chain:
    """Fit on at most ``bound`` labelled rows; only these texts reach the driver."""
    rows = labelled_sample(documents, labels, "toxic", bound).toPandas().sort_values("text", kind="stable")
    # An order by hash, not by text, so that folds mix.
    rows = rows.iloc[np.argsort(pd.util.hash_array(rows["text"].to_numpy(dtype=object)), kind="stable")] if len(rows) else rows
    return fit_rows(rows["text"].tolist(), rows["label"].tolist())


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """The columns given, with p_<category>, toxicity (the last category) and toxic (whether it is rejected)."""
    names = [f"p_{c}" for c in CATEGORIES[:-1]] + ["toxicity"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names) + ", toxic boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            p = chain.probabilities(chain.features([chain.found(cache, t) for t in texts]))
            yield pd.DataFrame(dict(zip(names, p.T, strict=True)) | {"toxic": p[:, -1] >= chain.threshold})

    kept = [c for c in documents.columns if c not in (*names, "toxic", "_scores")]
    return documents.select(*kept, run(F.col("text").cast("string")).alias("_scores")).select(*kept, "_scores.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chain = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents.select("doc_id", "text"), chain).drop("text")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the chain doesn't reject, with their columns."""
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).where(~F.col("toxic")).select(*docs.columns)
