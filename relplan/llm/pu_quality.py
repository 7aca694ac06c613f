"""Quality classifier by positive-unlabelled learning.

A linear model over text statistics and hashed words is fitted by minimising the
non-negative unbiased risk  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))  under the
squared loss, with trusted positives P, unlabelled text U and a class prior pi.

U is every text of the table: under that loss its part of the risk needs only
second moments, which all tasks add up, so nothing of U is sampled.  P is a
sample of bounded size (``bound``).  The prior is estimated from U: classifiers
fitted to all but one eighth of P score U and that eighth, each positive gets the
share of U above it, and the prior is the least ratio of such a share and the
share of P above it, bounds for chance included (best bin estimation).  Scores become probabilities by
the logistic curve whose mean over U is the prior and whose mean of margins
weighs what P says.  No negative label is used anywhere.

Defined cases: null and empty texts get the score of an empty text; tables
without positives give every row 0.5; with one positive or all in one eighth the prior is 0.5;
repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relplan.sources import shared

from . import kernels as K

BINS = 256
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.int64)  # 0: other control
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[0x20], _CLASS[0x0A], _CLASS[0xC0:], _CLASS[0x80:0xC0] = 4, 5, 6, 7
for _i, _c in enumerate(_PUNCT):
    _CLASS[_c] = 8 + _i
CLASSES = 8 + len(_PUNCT)
FEATURES = CLASSES + 9 + BINS


def features(texts: pa.Array) -> np.ndarray:
    """One float32 row of FEATURES per text."""
    data, offsets = K.buffers(texts)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for lo, hi in K.slices(offsets):
        _fill(out[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
    return out


def _fill(out: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    rows, size = len(out), np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row * CLASSES + _CLASS[data], minlength=rows * CLASSES).reshape(rows, CLASSES)
    share = kinds / np.maximum(size, 1)[:, None]
    out[:, :CLASSES] = np.sqrt(share)
    starts, ends, counts = K.words(data, offsets)
    n = np.diff(counts)
    of = np.repeat(np.arange(rows), n)
    some = np.maximum(n, 1)
    code = K.hashes(K.LOWER[data], starts, ends)
    length = ends - starts
    x = out[:, CLASSES:]
    x[:, 0] = np.log1p(n)
    x[:, 1] = np.log1p(size)
    x[:, 2] = np.bincount(of, length, rows) / some
    x[:, 3] = np.bincount(of, length > 20, rows) / some
    x[:, 4] = np.bincount(of[1:], (code[1:] == code[:-1]) & (of[1:] == of[:-1]), rows) / some
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 2)])
    x[:, 5] = np.bincount(of, (upper[ends] - upper[starts] > 1), rows) / some
    last = data[ends - 1] if len(ends) else data[:0]
    x[:, 6] = np.bincount(of, _CLASS[last] >= 8, rows) / some
    key = np.sort((of.astype(K.U64) << K.U64(40)) | (code >> K.U64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(key)))
    at = (key[first] >> K.U64(40)).astype(np.int64)
    x[:, 7] = np.bincount(at, minlength=rows) / some
    top = np.zeros(rows)
    np.maximum.at(top, at, run)
    x[:, 8] = top / some
    bags = np.bincount(of * BINS + (code >> K.U64(56)).astype(np.int64), minlength=rows * BINS).reshape(rows, BINS)
    x[:, 9:] = np.sqrt(bags / some[:, None])


#: Weight of the squares of the weights for very many positives, and what few of them add to it.
RIDGE, RIDGE_FEW = 0.1, 50
FLOOR, BINS_OF, REACH, TURNS = 0.05, 1 << 14, 4.0, 8


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def moments(x: np.ndarray) -> np.ndarray:
    """Sums of products of the columns and a last one of ones; the last entry is the number of rows."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    return a.T @ a


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the bias last, that minimise the non-negative risk plus ridge * |w|^2; both sides as moments.

    Where the negative part of the risk is positive that is one linear system.
    Otherwise the least risk lies where that part is zero, at the subgradient s in
    [0, 1] found by halving.
    """
    p, u = positive / positive[-1, -1], unlabelled / unlabelled[-1, -1]
    reg = 4 * ridge * np.eye(len(p))
    reg[-1, -1] = 1e-9

    def at(s: float) -> np.ndarray:
        return np.linalg.solve((1 - s) * prior * p + s * u + reg, prior * (1 + s) * p[-1] - s * u[-1])

    lo, hi = 0.0, 1.0
    if negative_part(at(hi), p, u, prior) >= 0:
        return at(hi)
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if negative_part(at(mid), p, u, prior) >= 0 else (lo, mid)
    return at(lo)


def negative_part(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """R_U(-) - pi * R_P(-) from mean moments."""
    return float((1 + 2 * w @ u[-1] + w @ u @ w) / 4 - prior * (1 + 2 * w @ p[-1] + w @ p @ w) / 4)


def shares_above(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For every positive of the histogram p, the share of the histogram u in its bin and those above."""
    return np.repeat(u[::-1].cumsum()[::-1] / u.sum(), p)


def estimated_prior(above: np.ndarray, n: int, gamma: float = 0.01, delta: float = 0.1) -> float:
    """Best bin estimation from the shares of U, which has n rows, above each of some positives that its scorer hasn't seen."""
    v = np.sort(above)
    q = np.arange(1, len(v) + 1) / len(v)
    chance = np.sqrt(np.log(4 / delta) / 2 / n) + np.sqrt(np.log(4 / delta) / 2 / len(v))
    best = np.argmin((v + (1 + gamma) * chance) / q)
    return float(np.clip(v[best] / q[best], 0.01, 0.98))


def calibrate(u: np.ndarray, p: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve with mean(curve) = prior and mean(z * curve) = prior * mean of z over P, over the histogram u (Newton steps)."""
    z = centres()
    share, target = u / u.sum(), prior * np.array([(z * p).sum() / p.sum(), 1.0])
    spread = max(1e-3, float(np.sqrt((share * z * z).sum() - (share * z).sum() ** 2)))
    x = z / spread
    target[0] /= spread
    a, b = 1.0, 0.0
    for _ in range(200):
        c = _sigmoid(a * x + b)
        g = np.array([(share * c * x).sum() + 1e-3 * a, (share * c).sum()]) - target
        q = share * c * (1 - c)
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        d /= max(1.0, abs(d).max() / 2)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a / spread), float(b)


def centres() -> np.ndarray:
    return (np.arange(BINS_OF) + 0.5) * (2 * REACH / BINS_OF) - REACH


def histogram(z: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(((z + REACH) * (BINS_OF / (2 * REACH))).astype(np.int64), 0, BINS_OF - 1), minlength=BINS_OF)


def margin(model: dict[str, np.ndarray], x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    # summed row by row, so that a text's score doesn't depend on its batch
    w = model["w"] if w is None else w
    return ((x - model["centre"]) / model["scale"] * w[:-1]).sum(1) + w[-1]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the features of every text as halves of floats, as a table of its own."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = features(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return shared.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, x binary"), "features")


def _rows(column: pa.Array) -> np.ndarray:
    """Features of a batch of the table."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).astype(np.float32).reshape(-1, FEATURES)


def _all_moments(table: DataFrame, fan_in: int = 64) -> np.ndarray | None:
    """Moments of every row of the table, added up in a tree."""

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in it:
            for lo in range(0, len(batch), 4096):
                total, n = total + moments(_rows(batch.column("x").slice(lo, 4096))), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    def added(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["part"].to_pylist(), group["m"].to_pylist(), strict=True))
        total = np.sum([np.frombuffer(m) for _, m in rows], axis=0)
        return pa.table([pa.array([rows[0][0]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    sums = shared.keep(table.select("x").mapInArrow(own, "part long, m binary"), "moments")
    while (n := sums.count()) > fan_in:
        sums = shared.keep(sums.groupBy(F.pmod(F.xxhash64("part"), F.lit(n // fan_in + 1))).applyInArrow(added, "part long, m binary"), "moments")
    got = sorted((r.part, bytes(r.m)) for r in sums.collect())
    return np.sum([np.frombuffer(m) for _, m in got], axis=0).reshape(FEATURES + 1, -1) if got else None


def _histograms(table: DataFrame, model: dict, weights: list[np.ndarray]) -> list[np.ndarray]:
    """The histogram of every row's margin for each of some weights."""
    sent = table.sparkSession.sparkContext.broadcast((model, weights))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ws = sent.value
        counts = np.zeros((len(ws), BINS_OF), np.int64)
        for batch in it:
            for lo in range(0, len(batch), 4096):
                x = _rows(batch.column("x").slice(lo, 4096))
                for i, w in enumerate(ws):
                    counts[i] += histogram(margin(m, x, w))
        which, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[which, place])], ["which", "place", "n"])

    out = np.zeros((len(weights), BINS_OF), np.int64)
    for r in table.select("x").mapInArrow(batches, "which int, place int, n long").groupBy("which", "place").agg(F.sum("n").alias("n")).collect():
        out[r.which, r.place] = r.n
    return list(out)


def learned(table: DataFrame, labels: DataFrame, bound: int = 20_000, parts: int = 4, held_out: int = 2) -> dict:
    """A model from a table of :func:`featured` and the positive labels outside the held-out fold."""
    learn = fold(F.col("doc_id"), parts) != held_out
    good = labels.where(learn & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n = good.count()
    if not n:
        return {"prior": 0.5}
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    turn = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(TURNS)).alias("turn")
    got = table.where(hashed < bound / n).join(good.where(hashed < bound / n), "doc_id").select(turn, "x").toArrow()
    # rows arrive in any order; sums of them shouldn't depend on it
    found = sorted(zip(got["turn"].to_pylist(), got["x"].to_pylist(), strict=True))
    if not found:
        return {"prior": 0.5}
    x, side = _rows(pa.array([r[1] for r in found], pa.binary())), np.array([r[0] for r in found])
    raw = _all_moments(table)
    mean = raw[-1, :-1] / raw[-1, -1]
    scale = np.sqrt(np.maximum(0, np.diag(raw)[:-1] / raw[-1, -1] - mean**2)) + FLOOR
    to = np.diag(np.append(1 / scale, 1.0))
    to[:-1, -1] = -mean / scale
    u = to @ raw @ to.T
    model = {"centre": mean, "scale": scale}
    z = (x - mean) / scale
    prior, ridge = 0.5, RIDGE + RIDGE_FEW / len(x)
    turns = [i for i in range(TURNS) if 0 < (side == i).sum() < len(side)]
    if turns:
        each = [fit(moments(z[side != i]), u, 0.5, ridge) for i in turns]
        above = [shares_above(h, histogram(margin(model, x[side == i], w))) for i, w, h in zip(turns, each, _histograms(table, model, each), strict=True)]
        prior = estimated_prior(np.concatenate(above), int(raw[-1, -1]))
    model["w"], model["prior"] = fit(moments(z), u, prior, ridge), prior
    model["a"], model["b"] = calibrate(_histograms(table, model, [model["w"]])[0], histogram(margin(model, x)), prior)
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, parts: int = 4, held_out: int = 2) -> dict:
    """A model for ``docs`` (doc_id, text); about ``bound`` labelled positives are read at most, chosen by a hash of their id."""
    return learned(featured(docs), labels, bound, parts, held_out)


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "w" not in model:
        return np.full(len(x), model["prior"])
    return _sigmoid(model["a"] * margin(model, x) + model["b"]).astype(np.float64)


def score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """All columns of ``docs`` but text, and the score of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            p = probability(sent.value, features(batch.column("text")).astype(np.float16).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p)], [*batch.schema.names[:-1], column])

    table = docs.select(*[f"`{c}`" for c in docs.columns if c != "text"], "text")
    return table.mapInArrow(batches, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[:-1]) + f", `{column}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    table = featured(docs)
    sent = docs.sparkSession.sparkContext.broadcast(learned(table, labels, bound))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(sent.value, _rows(batch.column("x"))))], ["doc_id", "score"])

    scored = table.mapInArrow(batches, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
