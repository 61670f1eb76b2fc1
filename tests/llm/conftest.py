import numpy as np
import pytest


@pytest.fixture()
def rng():
    return np.random.default_rng(7)


def make_words(rng, n, vocab=400):
    return [f"w{int(i)}" for i in rng.integers(0, vocab, n)]
