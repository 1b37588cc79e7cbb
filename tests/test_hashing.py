"""The hashing encoder works through its words in pieces."""

import random
import tracemalloc

import numpy as np
import pytest

from relevance_spark.operators import encoders
from tests.test_surface import embedded


def made(n, size, seed=3):
    draw = random.Random(seed)
    return [" ".join(f"{draw.choice('abcdefgh')}{draw.randrange(9000)}x" for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("at_once", [1, 2, 7, 100_000])
def test_pieces_do_not_show(monkeypatch, at_once):
    texts = ["", None, "One two. Straße", *made(3, 20), "one"]
    monkeypatch.setattr(encoders, "AT_ONCE", at_once)
    monkeypatch.setattr(encoders, "KEPT_WORDS", 5)
    got = encoders.HashingEncoder(native_dim=32)._encode(texts)
    got /= np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
    assert np.allclose(got, [embedded(t, 32) for t in texts])


def test_memory_does_not_grow_with_the_batch():
    texts = [*made(800, 400), " ".join(made(1, 100_000))]
    tracemalloc.start()
    encoders.HashingEncoder(native_dim=64)._encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
