"""Windows of words that occur earlier, against a comparison of all places."""

import numpy as np
import pytest

from relplan.llm import substrings


@pytest.mark.parametrize("seed", range(40))
def test_late_windows(seed):
    rng, units = np.random.default_rng(seed), substrings.Units(words=True, span=4, k=2, within=True)
    n = int(rng.integers(0, 8))
    count, doc, begin, ends = rng.integers(1, 9, n), rng.integers(0, 4, n), np.zeros(n, np.int64), {}
    for i in range(n):
        begin[i] = ends.get(doc[i], 0) + rng.integers(0, 3)
        ends[doc[i]] = begin[i] + count[i]
    codes = rng.integers(0, rng.integers(1, 4), int((count + 3).sum())).astype(np.uint32)
    places, at = [], 0
    for i in range(n):
        places += [(doc[i], begin[i] + j, tuple(codes[at + j : at + j + 4])) for j in range(count[i])]
        at += count[i] + 3
    wanted = [any(y[2] == x[2] and y[:2] < x[:2] for y in places) for x in places]
    assert substrings.late_windows(units, codes, doc, begin, count).tolist() == wanted
