"""The fit of the quality classifier against the risk in plain loops, and its prior against planted shares."""

import numpy as np
import pytest

from relplan.llm import pu_quality as P


def risk(w, positive, unlabelled, prior, ridge=P.RIDGE):
    """The non-negative risk, row by row."""

    def loss(rows, y):
        return sum((1 - y * (sum(a * b for a, b in zip(r, w)) + w[-1])) ** 2 / 4 for r in rows) / len(rows)

    return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1)) + ridge * sum(a * a for a in w[:-1])


@pytest.mark.parametrize("rows", [12, 300])
@pytest.mark.parametrize("ridge", [1e-3, 0.1])
def test_no_step_lowers_the_risk(rows, ridge):
    rng = np.random.default_rng(rows)
    positive = rng.normal(0.7, 1, (rows, 6))
    unlabelled = np.concatenate([rng.normal(0.7, 1, (60, 6)), rng.normal(-0.7, 1, (40, 6))])
    w = P.fit(P.moments(positive), P.moments(unlabelled), 0.6, ridge)
    least = risk(w, positive, unlabelled, 0.6, ridge)
    for size in (1e-3, 1e-2, 0.1, 1):
        for _ in range(25):
            assert risk(w + size * rng.normal(0, 1, 7), positive, unlabelled, 0.6, ridge) > least - 1e-6


def test_few_positives_meet_the_bound_of_zero():
    rng = np.random.default_rng(5)
    p, u = P.moments(rng.normal(1, 1, (8, 6))), P.moments(rng.normal(0, 1, (100, 6)))
    w = P.fit(p, u, 0.9, 1e-3)
    assert abs(P.negative_part(w, p / p[-1, -1], u / u[-1, -1], 0.9)) < 1e-3


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_and_curve_of_planted_shares(prior):
    rng = np.random.default_rng(1)
    n = 40_000
    good = rng.random(n) < prior
    u = P.histogram(np.where(good, rng.normal(1, 0.3, n), rng.normal(-1, 0.3, n)))
    p = P.histogram(rng.normal(1, 0.3, n))
    assert P.estimated_prior(P.shares_above(u, p), n) == pytest.approx(prior, abs=0.03)
    a, b = P.calibrate(u, p, prior)
    curve = 1 / (1 + np.exp(-(a * P.centres() + b)))
    assert (u * curve).sum() / n == pytest.approx(prior, abs=0.01) and curve[P.centres() > 0.6].min() > 0.9 and curve[P.centres() < -0.6].max() < 0.1


def test_negative_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, " ".join(["good words here"] * 9) if i % 3 else "!!! $$$ " * 9) for i in range(120)], "doc_id long, text string")
    some = [(i, 1, None) for i in range(120) if i % 3]
    labels = spark.createDataFrame(some, "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([*some, *[(i, 0, None) for i in range(0, 120, 3)]], "doc_id long, quality int, toxic int")
    one, two = ({r.doc_id: r for r in P.classify(docs, x).collect()} for x in (labels, more))
    assert one == two and all(one[i].predicted == int(i % 3 > 0) for i in one)
