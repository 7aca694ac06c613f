"""Words that a polynomial hash modulo a power of two can't tell apart are different words."""

import numpy as np
import pytest
from brute import base_scores, fold, near, removed
from test_contracts import frame

from relplan.llm import kernels, lbl, minhash, substrings


def twins(size):
    """A Thue-Morse word of a and b, and the same with both exchanged."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


SIZES = pytest.mark.parametrize("size", [1024, 4096])


@SIZES
def test_words_are_told_apart_by_their_bytes(size):
    data = np.frombuffer(" ".join([*twins(size), *twins(size), "x", ""]).encode(), np.uint8)
    starts, ends, _ = kernels.words(data, np.array([0, len(data)]))
    for codes in (None, np.zeros(len(starts), np.uint64)):  # also if all hashes were equal
        number, sample = kernels.distinct(data, starts, ends, codes)
        assert len(sample) == 3 and number[0] == number[2] != number[1] == number[3]
    assert len(set(kernels.hashes(data, starts, ends).tolist())) == 3


@SIZES
def test_near_copies(spark, size):
    docs = list(enumerate(["", *twins(size), *twins(size)]))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(frame(spark, docs)).collect()}
    assert found == near(docs) and found[2][1] == 2


@SIZES
def test_repeats(spark, size):
    common = " ".join(f"c{i}" for i in range(19))
    docs = [(i + 1, f"{w} {common}") for i, w in enumerate(twins(size))] + [(9, f"{twins(size)[1]} {common} more")]
    want = removed(docs, True)
    found = substrings.remove_repeats(frame(spark, docs), substrings.WORDS).selectExpr("rest.doc_id", "n_removed").collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: w[1] for i, w in want.items()} == {1: 0, 2: 0, 9: 20}


@SIZES
def test_counts(spark, size):
    one, two = twins(size)
    learn, held = ([i for i in range(60) if (fold(i, 10) == 0) == x][:3] for x in (False, True))
    docs = [(i, one) for i in learn] + [(i, two) for i in held]
    want = base_scores(docs)
    found = {r.doc_id: r for r in lbl.score(frame(spark, docs)).collect()}
    assert all((found[i].n_tokens, found[i].n_known, found[i].train_tokens) == w[:3] and found[i].base_score == pytest.approx(w[3]) for i, w in want.items())
    assert all(want[i][1] == 1 for i in held)


@pytest.mark.parametrize("units", [substrings.BYTES, substrings.WORDS], ids=["bytes", "words"])
def test_repeats_in_rows_without_id_and_of_one_id(spark, units):
    """Rows without id come last and are one document, as rows of one id are; places are compared by (document, start)."""
    import random

    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(40)}" for _ in range(45))
    tail = " ".join(f"t{rng.randrange(40)}" for _ in range(45))
    rows = [(None, f"a b {passage}"), (None, f"c {passage} {tail}"), (5, f"x y z {tail} {passage}"), (5, f"{passage} q"), (5, f"{passage} q"), (9, f"{tail} {passage}"), (7, None), (None, None), (8, "long" * 5000 + " " + tail)]
    span = units.span
    cut = [(2**63 - 1 if i is None else i, (t or "").encode().split() if units.words else (t or "").encode()) for i, t in rows]
    places = {}
    for i, u in cut:
        for j in range(len(u) - span + 1):
            places.setdefault(tuple(u[j : j + span]), []).append((i, j) if units.words else i)
    want = []
    for (i, u), (doc, _) in zip(cut, rows):
        gone = [False] * len(u)
        for j in range(len(u) - span + 1):
            if min(places[tuple(u[j : j + span])]) < ((i, j) if units.words else i):
                gone[j : j + span] = [True] * span
        want.append((doc, len(u), sum(gone)))
    found = substrings.remove_repeats(frame(spark, rows), units, least=5).selectExpr("rest.doc_id", "n_units", "n_removed").collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)
