"""How the language model works on batches, and its choice of classes against a plain loop."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cohortry.llm import lm


def _encoded(sizes):
    ids = np.concatenate([np.append(np.arange(n - 1) % 3, 3) for n in sizes]).astype(np.uint32)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(sizes)))})
    return lm._with_numbers(batch, ids, np.concatenate([[0], np.cumsum(sizes)]))


def _score(batch):
    of = SimpleNamespace(value=np.array([0, 1, 1, 3, 2], dtype=np.uint8))
    often = SimpleNamespace(value=np.array([4, 3, 2, 5, 0], dtype=np.uint8))
    large = SimpleNamespace(value=(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
    transition = -1 - np.arange(16.0).reshape(4, 4) / 10
    score = lm._scorer(of, often, large, transition, np.array([4.0, 5.0, 1.0, 5.0]), 14, 3)
    return [row for part in score([batch]) for row in part.to_pylist()]


def test_a_wide_batch_is_worked_on_in_parts(monkeypatch):
    sizes = [3, 9, 1, 40, 5, 5, 2] * 30
    batch = _encoded(sizes)
    want = _score(batch)
    monkeypatch.setattr(lm, "AT_ONCE", 16, raising=False)
    seen = []
    read = lm._sequences
    monkeypatch.setattr(lm, "_sequences", lambda part, end: seen.append(part) or read(part, end))
    assert _score(batch) == want
    assert [r["n_tokens"] for r in want] == sizes
    list(lm._lister(3, 2)([batch]))
    assert len(seen) > 2
    assert all(part.num_rows == 1 or len(lm._numbers(part)[0]) <= 16 for part in seen)


def _logs(monkeypatch):
    done = []
    real = lm._xlogx
    monkeypatch.setattr(lm, "_xlogx", lambda x: done.append(np.size(x)) or real(x))
    return done


def test_like_contexts_share_their_terms(monkeypatch):
    """Logarithms are taken for different counts of a class, not for each word that has them."""
    classes, size, words = 8, 10, 400
    draw = np.random.default_rng(3)
    table = draw.integers(20, 90, (size, size)).astype(float)
    contexts = np.zeros((words, 2 * size + 1))
    for row in contexts:
        row[draw.integers(0, 2 * size, 6)] += 1
    of = np.full(words, classes)
    done = _logs(monkeypatch)
    lm.best_classes(table, classes, of, contexts)
    assert sum(done) < np.count_nonzero(contexts) * classes


def test_best_classes_raise_the_likelihood_most():
    """Each word is taken out of its class and put into every other one, in a table of single words."""
    words, classes = 14, 4
    size = classes + 2
    draw = np.random.default_rng(9)
    pairs = draw.integers(0, 6, (words + 2, words + 2)).astype(float)
    of = np.concatenate([draw.integers(0, classes, words), [classes, classes + 1]])
    of[:2] = classes

    def likelihood(of):
        member = np.eye(size)[of]
        table = member.T @ pairs @ member
        return sum(x * math.log(x) for x in table.ravel() if x) - sum(
            x * math.log(x) for axis in (0, 1) for x in table.sum(axis=axis) if x
        )

    member = np.eye(size)[of]
    contexts = np.zeros((words, 2 * size + 1))
    for w in range(words):
        own = pairs[w, w]
        by, to = pairs[:, w] @ member, pairs[w] @ member
        by[of[w]] -= own
        to[of[w]] -= own
        contexts[w] = np.concatenate([by, to, [own]])
    best = lm.best_classes(member.T @ pairs @ member, classes, of[:words], contexts)
    for w in range(words):
        reached = []
        for c in range(classes):
            moved = of.copy()
            moved[w] = c
            reached.append(likelihood(moved))
        assert reached[best[w]] == pytest.approx(max(reached), rel=1e-12)
