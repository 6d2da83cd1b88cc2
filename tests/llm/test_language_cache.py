from __future__ import annotations

import numpy as np
import pytest

from tallyscope.llm import language_id


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_more_words_than_the_cache_holds(limit):
    """A group with more distinct words than the limit, on a cache that isn't empty, scores as with room for all."""
    pieces = [language_id.SPACE, *"abcdefgh", "ab", "cde"]
    probs = np.random.default_rng(4).random((len(pieces) + 2, 3))
    probs[0] = 0
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghx"), rng.integers(1, 60)))
    groups = [["ab cd", None, "1 2"], [" ".join(word() for _ in range(200)), "", "ab ab cd", word()], ["cd", "x"], [" ".join(word() for _ in range(12))] * 2]
    small, large = language_id.Scorer(pieces, probs, limit), language_id.Scorer(pieces, probs, 10**6)
    for texts in groups:
        for got, want in zip(small.score(texts), large.score(texts), strict=True):
            assert (got is None) == (want is None) and (got is None or np.allclose(got, want, rtol=1e-6))
        assert len(small.place) <= limit
