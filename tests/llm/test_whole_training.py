"""The language model's trainers meet every trigram of the training texts."""

import numpy as np
import pyarrow as pa
import pytest

from relplan.llm import lbl
from relplan.llm.substrings import loosened, squeezed


class Model:
    def __init__(self, value):
        self.value = value


def test_a_trainer_meets_every_trigram(monkeypatch):
    """60,000 words that occur once each: the vector of every one is met as a context and as a word."""
    n = 60_000
    words = [b"w%d" % i for i in range(n)]
    classes = lbl.Classes(top=n)
    layout = lbl.Layout.of(np.ones(classes.start))
    begun = lbl.started(layout)
    monkeypatch.setattr(lbl, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    block = {"words": np.array([n], np.int64).tobytes(), "held": [False], "keys": squeezed(b" ".join(words) + b" "), "tokens": squeezed(np.arange(n, dtype=np.uint32).tobytes())}
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in block.values()], list(block))
    model = Model({"top": {w: i for i, w in enumerate(words)}, "layout": layout, "p": begun})
    # of many trainers, so that the least number of samples plays no part
    (found,) = lbl._trained(model, classes, 10**6, 1)(iter([batch]))
    flat, at, met = np.frombuffer(loosened(found.column("body")[0].as_py()), np.float32), 0, {}
    for k in sorted(begun):
        rows, width = begun[k].shape
        met[k] = flat[at : at + rows * (width + 1)].reshape(rows, width + 1)[:, -1]
        at += rows * (width + 1)
    assert at == len(flat)
    assert (met["r"][:n] > 0).all() and (met["q"][:n] > 0).all()


def test_passes_are_whole_and_even():
    grams = np.arange(7)
    assert np.bincount(lbl.passes(grams.copy(), 30, 1)).tolist() == [5] * 7
    assert sorted(lbl.passes(grams.copy(), 3, 1)) == grams.tolist() and len(lbl.passes(grams[:0], 3, 1)) == 0


def test_sums_of_gradients():
    rng = np.random.default_rng(2)
    rows = np.repeat(np.arange(40), rng.integers(0, 20, 40))
    rng.shuffle(rows)
    grads = rng.normal(size=(len(rows), 5))
    found, sums = lbl._summed(rows, grads)
    assert found.tolist() == sorted(set(rows.tolist()))
    assert np.allclose(sums, [grads[rows == r].sum(0) for r in found])


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_norms_beyond_the_range_of_floats(scale):
    rng = np.random.default_rng(3)
    h, v = (rng.normal(size=(n, 5)).astype(np.float32) for n in (1300, 9))
    h *= scale
    s = (h @ v.T).astype(float)
    assert np.allclose(lbl._norms(h, v), np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1), rtol=1e-5, atol=1e-4)
