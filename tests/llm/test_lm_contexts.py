"""Tokens of one context share their softmax, when scored as when learned from."""

import numpy as np

from textloom.llm import lm


def test_scoring_works_out_each_context_once(monkeypatch):
    rng = np.random.default_rng(3)
    bits, rows = 8, 256
    random = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    inner = rows * lm.CLASSES // lm.GROUPS
    model = lm.Words(bits, random(lm.CLASSES**2, lm.CLASSES), random(lm.CLASSES, lm.GROUPS), random(rows, lm.CLASSES), random(rows, lm.CLASSES), random(inner, lm.GROUPS), random(inner, lm.GROUPS))
    codes = np.array([5, 70, 300, 9000, lm.END_CODE], dtype=np.uint16)
    kinds = np.array([3, 70, 90, 120, lm.END_CLASS], dtype=np.uint8)
    # The same text 500 times has six contexts at most.
    at = np.tile([0, 1, 2, 0, 3, 4], 500)
    sizes = np.full(500, 6, dtype=np.int64)
    asked = []
    logits = lm.Words.class_logits
    monkeypatch.setattr(lm.Words, "class_logits", lambda self, context, one, two: asked.append(len(context)) or logits(self, context, one, two))
    found = lm._log_p(model, sizes, kinds[at], codes[at])
    assert sum(asked) <= 6
    context, one, two = (x.astype(np.int64) for x in lm._context_words(sizes, kinds[at], codes[at]))
    for i in range(6):
        z = (model.classes[context[i]] + model.near[model.row(one[i])] + model.far[model.row(two[i])]).astype(float)
        want = z[kinds[at[i]]] - np.log(np.exp(z).sum())
        if kinds[at[i]] > lm.TOP:
            kind = np.int64(kinds[at[i]])
            z = (model.groups[kind] + model.near_in[model.row_in(one[i], kind)] + model.far_in[model.row_in(two[i], kind)]).astype(float)
            want += z[lm.group(codes[at[i]])] - np.log(np.exp(z).sum())
        assert np.allclose(found[i::6], want, atol=1e-5)


def test_rows_add_up_however_often_they_repeat():
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.integers(0, 50, 300), np.full(lm.LONG_RUN, 7), np.full(3 * lm.LONG_RUN, 9), [60]])
    values = rng.normal(size=(len(at), 8)).astype(np.float32)
    total = np.zeros((64, 8), np.float32)
    lm._add_rows(total, at, values)
    want = np.zeros((64, 8))
    np.add.at(want, at, values.astype(float))
    assert np.allclose(total, want, atol=1e-4)
