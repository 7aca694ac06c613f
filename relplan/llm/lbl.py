"""Scoring texts by a log-bilinear language model trained with noise-contrastive estimation.

The model predicts the class of a token from the classes of the two before it:
each class has a vector, the context is a linear map of two of them, and its
inner product with the vector of the next class, plus a bias, is the log of the
probability up to a constant.  Each word of the training corpus that is met often
enough is a class; the threshold grows as the root of the corpus, so the
vocabulary grows with it.  ``tails`` more hold all other words by their last two
bytes, and one is the end of a text.  Classes lie in groups of about the root of
their number; the probability is that of the group times that inside the group,
which makes it cheap to normalise.  Inside a class of many words the smoothed counts
share the probability, one unknown word in each class included, so the
probabilities of all tokens add up to one.

1. every block of documents (about ``block_bytes``) is tokenised once; its distinct
   words go with their counts to the words' parts, the tokens to a table;
2. a part adds up the counts of its words and answers every block;
3. trainers of about 16 million words each train in numpy on all their trigrams,
   each of which is met once (in a small corpus several times), from the same start;
4. their vectors are averaged in a tree, by how often each was met;
5. every block is scored by that model and the counts its words were answered.

Defined cases: null and empty texts have the end as their only token; a null id
counts as empty text for the fold, which is held out; repeated rows are scored
alike; without training rows every count is 0; extra columns take no part; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relplan.sources import shared

from . import kernels as K
from .pu_quality import fold
from .kernels import runs, spread
from .substrings import joined, loosened, squeezed

ALPHA = 0.1
#: Trigrams to train on at least, a small corpus being passed several times, and tokens of one trainer.
LEAST_SAMPLES, TRAINER = 2_048_000, 16_000_000
_CODED = "block long, part int, keys binary, counts binary, ids array<long>, held array<boolean>, words binary, tokens binary"
_TAIL = np.random.Generator(np.random.PCG64(55)).integers(0, 1 << 30, 65536)


@dataclass(frozen=True)
class Classes:
    top: int = 64
    tails: int = 31

    @property
    def end(self) -> int:
        return self.top + self.tails

    @property
    def start(self) -> int:
        return self.end + 1

    @property
    def size(self) -> int:
        return self.end + 2


def tails_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tails: int) -> np.ndarray:
    """The tail of each word, by its last two bytes."""
    pair = data[ends - 1].astype(np.int64)
    pair += np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64) << 8
    return _TAIL[pair] % tails


def _encode(parts: int, classes: Classes, block_bytes: int):
    """Step 1."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().taskAttemptId(), 0
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 2, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in _CODED.split(", ")]
        for batch in it:
            data, offsets = K.buffers(batch.column("text"))
            held = np.asarray(batch.column("held")).astype(bool)
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in K.slices(offsets, block_bytes):
                text = K.LOWER[data[offsets[lo] : offsets[hi]]]
                codes, firsts, lasts, counts = [], [], [], [np.zeros(1, np.int64)]
                for a, b in K.slices(offsets[lo : hi + 1] - offsets[lo]):
                    at = offsets[lo + a : lo + b + 1] - offsets[lo]
                    starts, ends, n = K.words(text[at[0] : at[-1]], at - at[0])
                    codes.append(K.hashes(text[at[0] : at[-1]], starts, ends))
                    firsts.append(starts + at[0])
                    lasts.append(ends + at[0])
                    counts.append(n[1:] + counts[-1][-1])
                code, starts, ends, n = np.concatenate(codes), np.concatenate(firsts), np.concatenate(lasts), np.diff(np.concatenate(counts))
                del codes, firsts, lasts
                number, sample = K.distinct(text, starts, ends, code)
                part = (code[sample] % K.U64(parts)).astype(np.int64)
                place = np.argsort(part, kind="stable")
                rank = np.empty(len(place), np.int64)
                rank[place] = np.arange(len(place))
                sample, part = sample[place], part[place]
                learn = np.repeat(~held[lo:hi], n)
                token = rank[number]
                seen = np.bincount(token[learn], minlength=len(sample)).astype(np.uint32)
                block, serial = (task << 24) + serial, serial + 1
                letters = joined(text, starts[sample], ends[sample])
                byte = np.concatenate([[0], np.cumsum((ends - starts)[sample] + 1)])
                first = runs(part[1:] != part[:-1]) if len(part) else np.zeros(0, np.int64)
                cut = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)) if len(part) else []
                null = [None] * len(cut)
                columns = [[block] * len(cut), part[first].tolist(), [letters[byte[a] : byte[b]].tobytes() for a, b in cut], [seen[a:b].tobytes() for a, b in cut], null, null, null, null]
                own = [block, -1, squeezed(letters.tobytes()), None, ids[lo:hi], held[lo:hi].tolist(), n.astype(np.int64).tobytes(), squeezed(token.astype(np.uint32).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([*c, x], t) for c, x, t in zip(columns, own, kinds, strict=True)], names)

    return batches


_ANSWER = "block long, part int, counts binary, top_word array<binary>, top_count array<long>, top_tail array<int>, tail_counts array<long>, tail_types array<long>"


def _answer(classes: Classes, least: int):
    """Step 2; words met ``least`` times get vectors of their own."""
    names = [x.split()[0] for x in _ANSWER.split(", ")]

    def part_of(group: pa.Table) -> pa.Table:
        raw = group["keys"].to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, _ = K.words(data, np.array([0, len(data)]))
        seen = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint32).astype(np.int64)
        number, sample = K.distinct(data, starts, ends)
        total = np.zeros(len(sample), np.int64)
        np.add.at(total, number, seen)
        each = total[number]
        kinds = tails_of(data, starts[sample], ends[sample], classes.tails)
        known = total > 0
        best = np.flatnonzero(total >= least)
        word = [data[starts[i] : ends[i]].tobytes() for i in sample[best]]
        ends = np.searchsorted(starts, np.cumsum([0, *(len(x) for x in raw)]))
        n, part = len(raw), group["part"][0].as_py()
        wide = np.uint32 if not len(total) or total.max() < 1 << 32 else np.uint64
        counts = [squeezed(np.array([np.dtype(wide).itemsize], np.uint8).tobytes() + each[a:b].astype(wide).tobytes()) for a, b in zip(ends, ends[1:])]
        stats = [word, total[best].tolist(), kinds[best].tolist(), np.bincount(kinds, total, classes.tails).astype(np.int64).tolist(), np.bincount(kinds, known, classes.tails).astype(np.int64).tolist()]
        lists = [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [pa.array([*group["block"].to_pylist(), -1], pa.int64()), pa.array([part] * (n + 1), pa.int32()), pa.array([*counts, None], pa.binary())]
        return pa.table(columns + [pa.array([None] * n + [x], t) for x, t in zip(stats, lists, strict=True)], names)

    return part_of


def _class_of(words: bytes, top: dict[bytes, int], classes: Classes) -> np.ndarray:
    """Class of each of some words with blanks between them; top: numbers of the words with a class of their own."""
    data = np.frombuffer(words, np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    own = np.array([top.get(w, -1) for w in words.split()], np.int64)
    return np.where(own >= 0, own, classes.top + tails_of(data, starts, ends, classes.tails))


def _context(word_class: np.ndarray, n: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of (class before last, last class, class) for every token, document of each, position of the end tokens)."""
    rows = len(n)
    length = n + 3  # two starts, the words, the end
    at = np.cumsum(length) - length
    seq = np.full(int(length.sum()), classes.start, np.int64)
    row = np.repeat(np.arange(rows), n + 1)
    where = np.arange(len(row)) + 2 * (row + 1)
    ends = at + n + 2
    is_word = np.ones(len(seq), bool)
    is_word[at], is_word[at + 1], is_word[ends] = False, False, False
    seq[is_word] = word_class
    seq[ends] = classes.end
    return (seq[where - 2] * classes.size + seq[where - 1]) * classes.size + seq[where], row, ends - 2 * (np.arange(rows) + 1)


@dataclass(frozen=True)
class Layout:
    """Groups of the factored softmax: units by falling count, the same number in each."""

    group: np.ndarray  # of each unit
    order: np.ndarray  # units, group after group
    start: np.ndarray  # of each group in the order, and the end
    cum: np.ndarray  # counts up to each place of the order, from 0
    inside: np.ndarray  # log share of each unit in its group
    share: np.ndarray  # of each group

    @staticmethod
    def of(counts: np.ndarray) -> Layout:
        n = len(counts)
        width = max(1, math.isqrt(n))
        order = np.argsort(-counts, kind="stable")
        start = np.append(np.arange(0, n, width), n)
        group = np.empty(n, np.int64)
        group[order] = np.arange(n) // width
        cum = np.concatenate([[0.0], np.cumsum(counts[order])])
        mass = np.diff(cum[start])
        return Layout(group, order, start, cum, np.log(counts / mass[group]), mass / cum[-1])


def started(layout: Layout, width: int = 24, seed: int = 11) -> dict[str, np.ndarray]:
    """Vectors to begin with; without contexts they give the unigram shares.  The last column of q and g is the bias."""
    rng, n = np.random.default_rng(seed), len(layout.group)
    q, g = rng.normal(0, 0.1, (n, width + 1)), rng.normal(0, 0.1, (len(layout.share), width + 1))
    q[:, width], g[:, width] = layout.inside, np.log(layout.share)
    p = {"r": rng.normal(0, 0.3, (n + 1, width)), "q": q, "g": g, "c": np.concatenate([np.eye(width) * 0.25, np.eye(width) * 0.5])}
    return {k: x.astype(np.float32) for k, x in p.items()}


def _summed(rows: np.ndarray, grads: np.ndarray, few: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of the gradients of each; those of up to ``few`` are added up side by side."""
    key = np.sort((rows << 32) | np.arange(len(rows)))
    rows, order = key >> 32, key & 0xFFFFFFFF
    first = runs(rows[1:] != rows[:-1])
    n = np.diff(np.append(first, len(rows)))
    out = grads.take(order[first], 0)
    for j in range(1, few):
        more = np.flatnonzero((n > j) & (n <= few))
        out[more] += grads.take(order[first[more] + j], 0)
    many = np.flatnonzero(n > few)
    if len(many):
        out[many] = np.add.reduceat(grads.take(order[spread(first[many], n[many])], 0), np.cumsum(n[many]) - n[many])
    return rows[first], out


def passes(grams: np.ndarray, least: int, seed: int) -> np.ndarray:
    """All of ``grams`` in a random order, every one equally often, ``least`` in sum or more; a large array is shuffled in place."""
    if 0 < len(grams) < least:
        grams = np.tile(grams, -(-least // len(grams)))
    np.random.default_rng(seed).shuffle(grams)
    return grams


def fitted(p: dict[str, np.ndarray], layout: Layout, grams: np.ndarray, size: int, seed: int, batch: int = 32768, least_steps: int = 500, noise: int = 32, own: int = 32, rate: float = 0.1) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Step 3: vectors after NCE on every one of ``grams``, in their order, and how often each was met.

    A gram is (two before * size + last) * size + word.  Groups are told from noise
    groups, and words from noise words of their group; tokens of a batch share them.
    """
    p, rng = {k: x.copy() for k, x in p.items()}, np.random.default_rng(seed)
    width, f32 = p["r"].shape[1], np.float32
    acc = {k: np.ones_like(x) for k, x in p.items()}
    met = {k: np.zeros(len(x), f32) for k, x in p.items()}
    edge, short = np.cumsum(layout.share), layout.group.astype(np.uint16)
    share, inside = (np.log(layout.share) + np.log(noise)).astype(f32), (layout.inside + np.log(own)).astype(f32)

    def unlike(x):
        with np.errstate(over="ignore"):  # one over infinity is 0
            np.exp(x, out=x)
        x += 1
        return np.reciprocal(x, out=x)

    batch = min(batch, max(4096, len(grams) // least_steps))
    steps = -(-len(grams) // batch)
    for t in range(steps):
        gram = grams[t * batch : (t + 1) * batch]
        gram = gram[np.argsort(short[gram % size], kind="stable")]  # group after group
        word, context = gram % size, gram // size
        two, last, grp = context // size, context % size, layout.group[word]
        begin = runs(grp[1:] != grp[:-1])
        end, here = np.append(begin[1:], len(grp)), grp[begin]
        x = np.concatenate([p["r"].take(two, 0), p["r"].take(last, 0)], 1)
        h = np.ones((len(x), width + 1), f32)
        np.matmul(x, p["c"], out=h[:, :width])
        fake = np.minimum(np.searchsorted(edge, rng.random(noise), "right"), len(edge) - 1)
        near, far = np.repeat(p["g"][here], end - begin, axis=0), p["g"][fake]
        up = unlike(np.einsum("ij,ij->i", h, near) - share[grp])[:, None]
        down = -unlike(share[fake] - h @ far.T)
        near *= up
        gh = near + down @ far
        g_rows, g_grads = np.concatenate([here, fake]), np.concatenate([np.add.reduceat(up * h, begin), down.T @ h])
        lo, hi = layout.cum[layout.start[here]], layout.cum[layout.start[here + 1]]
        at = np.searchsorted(layout.cum, lo[:, None] + rng.random((len(lo), own)) * (hi - lo)[:, None], "right") - 1
        other = layout.order[np.clip(at, layout.start[here][:, None], layout.start[here + 1][:, None] - 1)]
        far, down, push = p["q"].take(other, 0), np.empty((len(h), own), f32), np.empty((len(here), own, width + 1), f32)
        cuts = list(zip(begin.tolist(), end.tolist(), strict=True))
        for (a, b), vectors, shift in zip(cuts, far, inside[other], strict=True):
            np.subtract(shift, h[a:b] @ vectors.T, out=down[a:b])
        np.negative(unlike(down), out=down)
        for (a, b), vectors, pushed in zip(cuts, far, push, strict=True):
            gh[a:b] += down[a:b] @ vectors
            np.matmul(down[a:b].T, h[a:b], out=pushed)
        near = p["q"].take(word, 0)
        up = unlike(np.einsum("ij,ij->i", h, near) - inside[word])[:, None]
        near *= up
        gh += near
        h *= up
        q_rows, q_grads = np.concatenate([word, other.reshape(-1)]), np.concatenate([h, push.reshape(-1, width + 1)])
        gh = np.ascontiguousarray(gh[:, :width])
        gx = gh @ p["c"].T
        r_rows, r_grads = np.concatenate([two, last]), np.concatenate([gx[:, :width], gx[:, width:]])
        c_grads = x.T @ gh
        pace = f32(rate * min(1.0, 2 * (1 - t / steps)))
        for k, (rows, grads) in {"g": _summed(g_rows, g_grads), "q": _summed(q_rows, q_grads), "r": _summed(r_rows, r_grads), "c": (np.arange(2 * width), c_grads)}.items():
            seen = acc[k].take(rows, 0)
            seen += grads * grads
            acc[k][rows] = seen
            np.divide(grads, np.sqrt(seen, out=seen), out=seen)
            seen *= pace
            seen += p[k].take(rows, 0)
            p[k][rows] = seen
            met[k][rows] += 1
    return p, met


def _norms(h: np.ndarray, vectors: np.ndarray, piece: int = 512) -> np.ndarray:
    """Log of the sum of exp(h . vector) over all vectors, for each h; a piece's values stay in the cache."""
    found, turned, one = np.empty(len(h), np.float32), np.ascontiguousarray(vectors.T), np.ones(len(vectors), np.float32)
    room = np.empty((min(piece, len(h)), len(vectors)), np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        for i in range(0, len(h), piece):
            part = h[i : i + piece]
            s = np.matmul(part, turned, out=room[: len(part)])
            np.matmul(np.exp(s, out=s), one, out=found[i : i + piece])
        np.log(found, out=found)
    wild = np.flatnonzero(~np.isfinite(found))
    for i in range(0, len(wild), piece):  # beyond the range of floats: around the largest
        s = h[wild[i : i + piece]] @ turned
        most = s.max(1)
        found[wild[i : i + piece]] = np.log(np.exp(s - most[:, None]).sum(1)) + most
    return found


def logs(p: dict[str, np.ndarray], layout: Layout, two: np.ndarray, last: np.ndarray, word: np.ndarray, piece: int = 1 << 19) -> np.ndarray:
    """log10 P(unit | two units before it), normalised over groups and inside the group; each trigram and context once."""
    width, n, rows = p["r"].shape[1], len(layout.order), len(p["r"])
    one, other, short = p["r"] @ p["c"][:width], p["r"] @ p["c"][width:], layout.group.astype(np.uint16)
    trigram, inverse = np.unique((two * rows + last) * n + word, return_inverse=True)
    out = np.empty(len(trigram))
    for lo in range(0, len(trigram), piece):
        part = trigram[lo : lo + piece]
        context, w = part // n, part % n
        first = runs(context[1:] != context[:-1])
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(part))))
        h, grp = np.ones((len(first), width + 1), np.float32), layout.group[w]
        np.add(one.take(context[first] // rows, 0), other.take(context[first] % rows, 0), out=h[:, :width])
        each = h.take(of, 0)
        value = np.einsum("ij,ij->i", each, p["g"].take(grp, 0)) - _norms(h, p["g"])[of]
        value += np.einsum("ij,ij->i", each, p["q"].take(w, 0))
        order = np.argsort(short[w], kind="stable")
        ends = np.searchsorted(grp[order], np.arange(len(layout.start)))
        for g in np.flatnonzero(np.diff(ends)):
            at = order[ends[g] : ends[g + 1]]
            context = of[at]  # rising
            begin = runs(context[1:] != context[:-1])
            found = _norms(h.take(context[begin], 0), p["q"][layout.order[layout.start[g] : layout.start[g + 1]]])
            value[at] -= np.repeat(found, np.diff(np.append(begin, len(context))))
        out[lo : lo + piece] = value / np.log(10)
    return out[inverse]


def train(counts: np.ndarray, classes: Classes, samples: int = LEAST_SAMPLES) -> np.ndarray:
    """The model of a table of trigram counts, as the table of all its log10 P(unit | two units before it)."""
    size = classes.size
    layout = Layout.of(counts.sum((0, 1))[: classes.start] + 0.5)
    flat = np.flatnonzero(counts)
    p = started(layout)
    if len(flat):
        p, _ = fitted(p, layout, passes(np.repeat(flat, counts.reshape(-1)[flat]), samples, 11), size, 11)
    out = np.full((size,) * 3, -50.0, np.float32)
    two, last, word = (x.reshape(-1) for x in np.indices((size, size, classes.start)))
    out[..., : classes.start] = logs(p, layout, two, last, word).reshape(size, size, classes.start)
    return out


_PARTS = "range int, salt long, body binary"


def _trained(model, classes: Classes, trainers: int, ranges: int):
    """Step 3 in one task, over all its trigrams: vectors times how often they were met, and that number."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n_grams, top = np.empty(0, np.int64), 0, model.value["top"]
        for batch in it:
            for words, held, keys, tokens in zip(*(batch.column(c) for c in ("words", "held", "keys", "tokens")), strict=True):
                n = np.frombuffer(words.as_py(), np.int64)
                learn = ~np.array(held.as_py(), bool)
                kind = _class_of(loosened(keys.as_py()), top, classes)
                used = kind[np.frombuffer(loosened(tokens.as_py()), np.uint32)[np.repeat(learn, n)]]
                more = _context(used, n[learn], classes)[0]
                if n_grams + len(more) > len(grams):
                    grams.resize(max(n_grams + len(more), len(grams) * 5 // 4), refcheck=False)  # in place, never two of them
                grams[n_grams : n_grams + len(more)] = more
                n_grams += len(more)
        if not n_grams:
            return
        task = TaskContext.get().partitionId()
        grams = passes(grams[:n_grams], LEAST_SAMPLES // trainers, 11 + task)
        p, met = fitted(model.value["p"], model.value["layout"], grams, classes.size, 11 + task)
        del grams
        flat = np.concatenate([np.concatenate([p[k] * met[k][:, None], met[k][:, None]], 1).reshape(-1) for k in sorted(p)])
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([task] * ranges, pa.int64()), pa.array([squeezed(x.tobytes()) for x in np.array_split(flat, ranges)], pa.binary())], ["range", "salt", "body"])

    return batches


def _added(group: pa.Table) -> pa.Table:
    total = 0
    for x in group["body"]:
        total = total + np.frombuffer(loosened(x.as_py()), np.float32)
    return pa.table([group["range"].slice(0, 1), group["salt"].slice(0, 1), pa.array([squeezed(total.tobytes())], pa.binary())], ["range", "salt", "body"])


def learned(texts: DataFrame, model: dict, classes: Classes, trainers: int, ranges: int = 8, fan_in: int = 8) -> dict[str, np.ndarray]:
    """Step 4: means of the trainers' vectors, each weighed by how often it was met; ``fan_in`` are added up at a time."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    spread = texts.select("words", "held", "keys", "tokens").coalesce(trainers)
    table = shared.keep(spread.mapInArrow(_trained(sent, classes, trainers, ranges), _PARTS), "trained")
    while (n := table.where("range = 0").count()) > 1:
        table = table.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(n // fan_in)) if n > fan_in else F.lit(0).cast("long"))
        table = shared.keep(table.groupBy("range", "salt").applyInArrow(_added, _PARTS), "trained")
    got = dict(table.select("range", "body").collect())
    if not got:
        return model["p"]
    flat = np.concatenate([np.frombuffer(loosened(bytes(got[r])), np.float32) for r in range(ranges)])
    out, at = {}, 0
    for k in sorted(model["p"]):
        rows, width = model["p"][k].shape
        body = flat[at : at + rows * (width + 1)].reshape(rows, width + 1)
        at += body.size
        out[k] = np.where(body[:, width:] > 0, body[:, :width] / np.maximum(body[:, width:], 1), model["p"][k]).astype(np.float32)
    return out


def _score(fitted, classes: Classes):
    """Step 5."""

    def block_of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        model = fitted.value
        out = []
        for words, held, keys, tokens, ids in zip(*(left[c] for c in ("words", "held", "keys", "tokens", "ids")), strict=True):
            n = np.frombuffer(words.as_py(), np.int64)
            answers = [loosened(x) for _, x in sorted(zip(right["part"].to_pylist(), right["counts"].to_pylist(), strict=True))]
            seen = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint32 if x[0] == 4 else np.uint64, -1, 1).astype(np.int64) for x in answers)])
            kind = _class_of(loosened(keys.as_py()), model["top"], classes)
            base = np.log10((seen + ALPHA) / model["z"])
            inside = np.where(kind < classes.top, 0.0, base - model["log_mass"][kind])
            token = np.frombuffer(loosened(tokens.as_py()), np.uint32).astype(np.int64)
            index, row, ends = _context(kind[token], n, classes)
            is_word = np.ones(len(row), bool)
            is_word[ends] = False
            value = logs(model["p"], model["layout"], index // classes.size**2, index // classes.size % classes.size, index % classes.size)
            value[is_word] += inside[token]
            plain = np.full(len(row), np.log10((model["ends"] + ALPHA) / model["z"]))
            plain[is_word] = base[token]
            known = np.full(len(row), float(model["ends"] > 0))
            known[is_word] = seen[token] > 0
            rows = len(n)
            sums = [np.bincount(row, x, rows) for x in (known, plain, value)]
            out.append(pa.table([pa.array(ids.as_py(), pa.int64()), pa.array(held.as_py(), pa.bool_()), pa.array(n + 1), pa.array(sums[0].astype(np.int64)), pa.array(np.full(rows, model["n"], np.int64)), pa.array(sums[1]), pa.array(sums[2])], names))
        if out:
            return pa.concat_tables(out)
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)

    return block_of


def prepared(docs: DataFrame, classes: Classes = Classes(), folds: int = 10, held_out: int = 0, block_bytes: int = 8 << 20, part_bytes: int = 64 << 20, least: int = 16) -> tuple[DataFrame, DataFrame, dict, Classes]:
    """(blocks of texts, answers to them, the model, its classes) of ``docs`` (doc_id, text): steps 1 to 4."""
    spark = docs.sparkSession
    held = (fold(F.col("doc_id"), folds) == held_out).alias("held")
    total, ends = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(~held, 1))).first()
    parts = int(max(least, (total or 0) // part_bytes + 1))
    about = (total or 0) // 6  # words
    frequent = max(8, math.isqrt(about) // 100)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.coalesce("text", F.lit("")).alias("text"))
    coded = shared.keep(plain.mapInArrow(_encode(parts, classes, block_bytes), _CODED), "coded")
    sent = coded.where("part >= 0").select("block", "part", "keys", "counts")
    answers = shared.keep(sent.groupBy("part").applyInArrow(_answer(classes, frequent), _ANSWER), "answers")
    stats = answers.where("block = -1")
    tops = stats.select(F.explode(F.arrays_zip("top_word", "top_count", "top_tail")).alias("x")).select("x.*").where("top_count > 0")
    tops = sorted((bytes(r.top_word), r.top_count, r.top_tail) for r in tops.collect())
    classes = replace(classes, top=len(tops))
    tails = stats.select(F.posexplode(F.arrays_zip("tail_counts", "tail_types")).alias("tail", "x")).groupBy("tail").agg(F.sum("x.tail_counts"), F.sum("x.tail_types")).collect()
    counts, types = np.zeros(classes.tails), np.zeros(classes.tails)
    for tail, c, n in tails:
        counts[tail], types[tail] = c, n
    n, distinct = int(counts.sum()) + ends, int(types.sum()) + (ends > 0)
    z = n + ALPHA * (distinct + 1)
    for _, c, tail in tops:
        counts[tail], types[tail] = counts[tail] - c, types[tail] - 1
    log_mass = np.zeros(classes.size)
    log_mass[classes.top : classes.end] = np.log10((counts + ALPHA * types + ALPHA) / z)
    top = {t[0]: i for i, t in enumerate(tops)}
    texts = coded.where("part = -1")
    layout = Layout.of(np.concatenate([[t[1] for t in tops], counts, [ends]]) + 0.5)
    trainers = about // TRAINER + 1
    begun = {"top": top, "layout": layout, "p": started(layout)}
    model = {"top": top, "z": z, "n": n, "ends": ends, "log_mass": log_mass, "layout": layout, "p": learned(texts, begun, classes, trainers)}
    return texts, answers.where("block <> -1").select("block", "part", "counts"), model, classes


def score(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text)."""
    texts, told, model, classes = prepared(docs, **options)
    fitted = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    own = texts.select("block", "words", "held", "keys", "tokens", "ids")
    return own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(fitted, classes), kinds)
