"""The language model's vocabulary and samples grow with the corpus."""

import random

import pytest
from oracle import DATA
from test_contracts import frame

from relplan.llm import lbl


def test_frequent_words_beyond_64_are_told_by_their_contexts(spark):
    """300 equally frequent words, each followed by its own successor: only vectors of their own can tell it."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        at = rng.randrange(300)
        rows.append((i, " ".join(f"{(at + j) * 7919 % 300}xx" for j in range(150))))
    held = lbl.score(frame(spark, rows)).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > 0.5 * held[1]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_held_out_score_is_better_than_base(spark):
    held = lbl.score(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text")).where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    print("held-out log10 a token: score", held[0] / held[2], "base", held[1] / held[2])
    assert held[0] > held[1]


def test_scores_against_plain_softmax(spark):
    """Every token's probability from the fitted vectors by loops over all groups and members, summed over a text."""
    import math

    from brute import WORD, fold, lower

    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["the", "THE", "cat", "dog", "sat", "ran", f"rare{i}", "ü"], [9, 3, 5, 5, 4, 4, 1, 2], k=rng.randint(0, 30)))) for i in range(60)]
    docs += [(60, None), (61, ""), (None, "the cat"), (5, docs[5][1])]
    rows = frame(spark, docs)
    _, _, model, classes = lbl.prepared(rows)
    train = [[*WORD.findall(lower(t)), None] for i, t in docs if fold(i, 10) != 0]
    counts = {}
    for w in (w for ws in train for w in ws):
        counts[w] = counts.get(w, 0) + 1
    z = sum(counts.values()) + 0.1 * (len(counts) + 1)
    p, layout, width = model["p"], model["layout"], model["p"]["r"].shape[1]

    def kind(w):
        return classes.end if w is None else model["top"].get(w, classes.top + int(lbl._TAIL[w[-1] + (w[-2] << 8 if len(w) > 1 else 0)] % classes.tails))

    def share(vectors, h, units, unit):
        e = {u: math.exp(sum(float(a) * float(b) for a, b in zip(vectors[u][:width], h)) + float(vectors[u][width])) for u in units}
        return e[unit] / sum(e.values())

    def token(two, last, w):
        x = [*p["r"][two], *p["r"][last]]
        h = [sum(float(x[i]) * float(p["c"][i][j]) for i in range(2 * width)) for j in range(width)]
        unit = kind(w)
        group = int(layout.group[unit])
        value = share(p["g"], h, range(len(p["g"])), group) * share(p["q"], h, [u for u in range(len(layout.group)) if layout.group[u] == group], unit)
        if classes.top <= unit < classes.end:
            inside = [v for v in counts if v is not None and kind(v) == unit]
            value *= (counts.get(w, 0) + 0.1) / (sum(counts[v] for v in inside) + 0.1 * len(inside) + 0.1)
        return math.log10(value)

    want = {}
    for i, t in docs:
        seen = [classes.start, classes.start]
        total = 0.0
        for w in [*WORD.findall(lower(t)), None]:
            total += token(seen[-2], seen[-1], w)
            seen.append(kind(w))
        want[i] = total
    found = lbl.score(rows).collect()
    assert len(found) == len(docs) and len(model["top"]) >= 5 and z > 0
    for r in found:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-4)
