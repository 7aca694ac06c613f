"""Exact removal of long repeated strings, of bytes or of words, over a whole corpus.

A unit is a byte or a word; a window is ``span`` consecutive units of a document.
The smallest hash among the k-grams of a window is its anchor: equal windows have
equal anchors wherever they stand.  The work goes in five steps, all of them
plain shuffles of bounded groups:

Copies of whole texts are found first, by SHA-256: all but the first go without
further work.

1. every batch of documents sends its distinct anchors to the anchors' parts;
2. a part returns the anchors seen twice to the document buckets they came from;
3. a bucket holds the windows with such anchors against each other first, so that
   of a passage which many of its documents share only one copy is sent on; the
   rest travels in runs of windows with one anchor;
4. a part decides which of those windows occur earlier in another bucket;
5. each bucket removes what steps 3 and 4 found.

Hashes only bring windows together.  Equal windows of bytes are found by
bucket-pointer refinement (:func:`classes`): positions fall into buckets by their
first eight bytes, and every pass refines a bucket by the bucket numbers found as
many bytes further on as the last one had settled, until the span is covered.
Windows of words are found by suffix automata (:mod:`.automata`): of those that
have come together, windows whose hash stands alone leave; the runs of the others
are dealt into bounded reference shards, and all later runs stream through each
shard's automaton.  Words are numbered by their bytes.

Defined cases: null and empty texts have no units and nothing removed; documents
shorter than the span stay; rows without id come after all others; rows of equal
ids are one document for the comparison and each give a row; other columns are
carried along in ``rest``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relplan.sources import shared

from . import automata
from . import kernels as K
from .kernels import groups, runs, sizes, spread

LOW = np.uint64(32)
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Units:
    """What a string is made of, and how long a repeated one must be."""

    words: bool
    span: int
    k: int
    within: bool  # a repetition inside one document counts

    @property
    def width(self) -> int:
        return self.span - self.k + 1

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the units, hashes if they are words, and how many come before each row."""
        if not self.words:
            return data, offsets
        starts, ends, counts = K.words(data, offsets)
        return K.hashes(data, starts, ends), counts

    def grams(self, codes: np.ndarray, k: int) -> np.ndarray:
        if self.words:
            return K.grams(codes, k)
        n = len(codes) - k + 1
        if n <= 0:
            return np.zeros(0, K.U64)
        out, step = np.empty(n, K.U64), K.CHUNK
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            part = codes[lo : hi + k - 1]
            pow_, inv = K.powers(len(part))
            total = np.empty(len(part) + 1, K.U64)
            total[0] = 0
            np.cumsum(K.BYTE_VALUE[part] * pow_, out=total[1:])
            out[lo:hi] = (total[k:] - total[: hi - lo]) * inv[: hi - lo]
        return K.mix(out)

    def anchors(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows, their anchors, and the hashes of all k-grams."""
        if len(codes) < self.span:
            return np.zeros(0, np.int64), np.zeros(0, K.U64), np.zeros(0, K.U64)
        grams = self.grams(codes, self.k)
        at = K.within(counts, self.span)
        return at, K.sliding_min(grams, self.width)[at], grams


BYTES = Units(words=False, span=50, k=20, within=False)
WORDS = Units(words=True, span=20, k=5, within=True)


def classes(units: Units, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups (order, first) of equal windows codes[start:start+span]; codes are bytes or numbers of words.

    Buckets of eight bytes or one word come first; then bucket numbers are refined
    by those at later offsets, each pass reusing the numbers of the last and
    reaching about twice as far, until the span is covered.  A window with a bucket
    of its own at any of these offsets equals no other and leaves.
    """
    steps, depth = [], 1 if units.words else 8
    while depth < units.span:
        steps.append(min(depth, units.span - depth))
        depth += steps[-1]
    reach = [[0]]  # offsets at which a pass needs the numbers of the one before it, from the last pass back
    for step in reversed(steps):
        reach.insert(0, sorted({*reach[0], *(r + step for r in reach[0])}))
    index = np.int32 if len(codes) < 2**31 - units.span else np.int64
    bucket = np.zeros(len(codes) + 1, np.uint32)
    alive = np.arange(len(starts))
    for i, offsets in enumerate(reach[:-1]):
        need = np.zeros(len(codes) + 1, bool)
        at = starts[alive]
        for offset in offsets:
            need[at + offset] = True
        where = np.flatnonzero(need).astype(index)
        if i == 0:
            key = codes[where] if units.words else K.eights(codes)[where]
        else:
            key = bucket[where].astype(K.U64)
            key <<= K.U64(32)
            key |= bucket[where + steps[i - 1]]
        order, first = groups(key)
        del key
        size = sizes(first, len(order))
        finer = np.zeros_like(bucket)
        finer[where[order]] = np.repeat(np.arange(len(first), dtype=np.uint32), size)
        bucket = finer
        need[:] = False
        need[where[order[first[size == 1]]]] = True
        lone = np.zeros(len(at), bool)
        for offset in offsets:
            lone |= need[at + offset]
        alive = alive[~lone]
    at = starts[alive]
    key = bucket[at].astype(K.U64)
    key <<= K.U64(32)
    key |= bucket[at + steps[-1]]
    order, first = groups(key)
    left = np.ones(len(starts), bool)
    left[alive] = False
    alone = np.flatnonzero(left)
    return np.concatenate([alive[order], alone]), np.concatenate([first, len(order) + np.arange(len(alone))])


def later(units: Units, found: tuple[np.ndarray, np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one that comes earlier; found: groups of equal windows."""
    order, first = found
    out = np.zeros(len(order), bool)
    if not len(order):
        return out
    size = sizes(first, len(order))
    d = doc[order]
    lowest = np.repeat(np.minimum.reduceat(d, first), size)
    late = d > lowest
    if units.within:
        s = start[order]
        late |= s > np.repeat(np.minimum.reduceat(np.where(late, LAST, s), first), size)
    out[order] = late
    return out


def late_windows(units: Units, codes: np.ndarray, doc: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which windows of some runs have an equal one that comes earlier.

    Run i has ``count[i]`` windows from unit ``begin[i]`` of document ``doc[i]`` on; their units follow each other in ``codes``.
    """
    length = count + units.span - 1
    where = np.cumsum(length) - length
    order = np.lexsort((begin, doc))
    d, b, n = doc[order], begin[order], count[order]
    if units.words and not ((d[1:] == d[:-1]) & (b[1:] < b[:-1] + n[:-1])).any():
        found = np.zeros(int(count.sum()), bool)
        place, at, run = spread((np.cumsum(count) - count)[order], n), spread(where[order], n), np.repeat(np.arange(len(n)), n)
        # a window whose hash stands alone here equals no other; the rest goes on in runs
        by, head = groups(K.grams(codes.astype(K.U64), units.span)[at])
        size = sizes(head, len(by))
        left = np.sort(by[np.repeat(size > 1, size)])
        if len(left):
            place, at, run = place[left], at[left], run[left]
            first = runs((at[1:] != at[:-1] + 1) | (run[1:] != run[:-1]))
            found[place] = automata.repeated(codes, at[first], np.diff(np.append(first, len(at))), units.span)
        return found
    # rows of one id overlap: places are compared one by one
    return later(units, classes(units, codes, spread(where, count)), np.repeat(doc, count), spread(begin, count))


def _key(anchor: np.ndarray, parts: int) -> np.ndarray:
    """A part and 32 bits; parts grow with the corpus, so few anchors ever share a key, and those only add candidates."""
    return ((anchor % K.U64(parts)) << LOW) | (anchor >> LOW)


def _short(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).tobytes()


def _long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(K.U64)


def _send(units: Units, parts: int):
    """Step 1."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = K.buffers(batch.column("text"))
            bucket = np.asarray(batch.column("bucket")).astype(np.uint32)
            found, where = [], []
            for lo, hi in K.slices(offsets, 2 * K.CHUNK):
                codes, counts = units.cut(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at, anchor, grams = units.anchors(codes, counts)
                if not len(at):
                    continue
                first = runs(anchor[1:] != anchor[:-1], at[1:] != at[:-1] + 1)
                row = np.searchsorted(counts, at[first], "right") - 1
                value = anchor[first]
                if units.within:  # a run of windows may hold its anchor more than once
                    length = np.diff(np.append(first, len(at))) + units.width - 1
                    same = grams[spread(at[first], length)] == np.repeat(value, length)
                    again = np.add.reduceat(same.astype(np.int32), np.cumsum(length) - length) > 1
                    value, row = np.concatenate([value, value[again]]), np.concatenate([row, row[again]])
                else:
                    order, once = groups(value ^ K.mix(row.astype(K.U64)))
                    value, row = value[order[once]], row[order[once]]
                found.append(_key(value, parts))
                where.append(bucket[lo + row])
            if not found:
                continue
            key, own = np.concatenate(found), np.concatenate(where)
            order, first = groups(key * K.U64(0x9E3779B97F4A7C15) ^ K.mix(own.astype(K.U64)))
            many = sizes(first, len(order)) > 1
            twice = order[np.concatenate([first, first[many]])]  # seen twice here: say so
            key, own = key[twice], own[twice]
            part = (key >> LOW).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            key, own, part = key[order], own[order], part[order].astype(np.int64)
            first = runs(part[1:] != part[:-1])
            cut = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))
            for lo in range(0, len(cut), 4096):
                these = cut[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part[first[lo : lo + 4096]].astype(np.int32)), pa.array([_short(key[a:b]) for a, b in these], pa.binary()), pa.array([own[a:b].tobytes() for a, b in these], pa.binary())], ["part", "keys", "buckets"])

    return batches


def _return(group: pa.Table) -> pa.Table:
    """Step 2."""
    part = group["part"][0].as_py()
    key = np.concatenate([_long(x) for x in group["keys"].to_pylist()])
    own = np.concatenate([np.frombuffer(x, np.uint32) for x in group["buckets"].to_pylist()])
    order, first = groups(key)
    size = sizes(first, len(key))
    order = order[np.repeat(size > 1, size)]
    key, own = key[order], own[order]
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    if not len(key):
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "part", "keys"])
    once = runs((key[1:] != key[:-1]) | (own[1:] != own[:-1]))
    key, own = key[once], own[once]
    first = runs(own[1:] != own[:-1])
    ends = np.append(first, len(own))
    return pa.table([pa.array(own[first].astype(np.int32)), pa.array(np.full(len(first), part, np.int32)), pa.array([_short(key[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())], ["bucket", "part", "keys"])


MOVED = ["target", "uid", "rest", "body", "marks", "n", "sha"]


def squeezed(raw: bytes) -> bytes:
    """The bytes compressed, after their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loosened(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _squeeze(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = K.buffers(batch.column("text"))
        raw = data.tobytes()
        body = pa.array([squeezed(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], body], [*batch.schema.names[:-1], "body"])


def _head(raw: bytes) -> np.ndarray:
    """(doc, uid, begin, count) of the runs that a bucket sent."""
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, uid = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    index, begin, count = np.frombuffer(raw, np.uint32, -1, 8 + 16 * n).reshape(3, -1).astype(np.int64)
    return np.stack([doc[index], uid[index], begin, count])


def _rows(rest_type: pa.DataType, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    kinds = {"target": pa.int32(), "uid": pa.int64(), "rest": rest_type, "body": pa.binary(), "marks": pa.binary(), "n": pa.int64(), "sha": pa.string()}
    return pa.table([columns[c] if isinstance(columns.get(c), (pa.Array, pa.ChunkedArray)) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], MOVED)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of some words, a blank behind each."""
    n = ends - starts + 1
    out = data[np.minimum(spread(starts, n), len(data) - 1)]
    out[np.cumsum(n) - 1] = 0x20
    return out


def _plain(units: Units, body: bytes) -> bytes:
    return b" ".join(body.split()) if units.words else body


def _local(units: Units, buckets: int, parts: int, texts_wanted: bool):
    """Step 3."""

    def bucket_of(left: pa.Table, right: pa.Table) -> pa.Table:
        K.give_back()
        if not len(left):
            return _rows(left.schema.field("rest").type, target=[])
        anchors_in = right.filter(pa.compute.is_valid(right["keys"]))
        known = np.sort(np.concatenate([np.zeros(0, K.U64), *((K.U64(p) << LOW) | _long(x) for p, x in zip(anchors_in["part"].to_pylist(), anchors_in["keys"].to_pylist(), strict=True))]))
        copies_in = right.filter(pa.compute.is_valid(right["doc"]))
        copies = set(zip(copies_in["doc"].to_pylist(), copies_in["hash"].to_pylist(), strict=True))
        bucket = left["bucket"][0].as_py()
        rest = left["rest"].combine_chunks()
        doc = np.asarray(left["doc"])
        packed = left["body"].to_pylist()
        raws = [loosened(x) for x in packed]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        copied = np.array([x in copies for x in zip(left["doc"].to_pylist(), left["hash"].to_pylist(), strict=True)], bool)
        n_units = np.zeros(len(doc), np.int64)
        uid = K.mix(doc.view(K.U64) + np.uint64(1)) ^ K.hashes(data, offsets[:-1], offsets[1:])
        pieces, begins, lengths, rows, anchors, hashed, sizes_ = [], [], [], [], [], [], []
        for lo, hi in K.slices(offsets, 2 * K.CHUNK):
            piece = data[offsets[lo] : offsets[hi]]
            codes, counts = units.cut(piece, offsets[lo : hi + 1] - offsets[lo])
            n_units[lo:hi] = np.diff(counts)
            at, anchor, _ = units.anchors(codes, counts)
            if not len(at) or not len(known):
                continue
            first = runs(anchor[1:] != anchor[:-1], at[1:] != at[:-1] + 1)
            size = sizes(first, len(at))
            key = _key(anchor[first], parts)
            spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
            owner = lo + np.searchsorted(counts, at[first], "right") - 1
            hit = np.repeat((known[spot] == key) & ~copied[owner], size)
            if not hit.any():
                continue
            at, key = at[hit], np.repeat(key, size)[hit]
            row = np.searchsorted(counts, at, "right") - 1
            first = runs((at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))
            size = np.diff(np.append(first, len(at)))
            used = spread(at[first], size + units.span - 1)
            if units.words:
                starts, ends, _ = K.words(piece, offsets[lo : hi + 1] - offsets[lo])
                pieces.append(joined(piece, starts[used], ends[used]))
                hashed.append(codes[used])
                sizes_.append((ends - starts)[used])
            else:
                pieces.append(codes[used])
            begins.append(at - counts[row])
            rows.append(row + lo)
            anchors.append(key)
            lengths.append(size)
        out = []
        marks: dict[int, bytes] = {}
        pending = np.zeros(len(doc), bool)
        if rows:
            codes, start, row, key, size = (np.concatenate(x) for x in (pieces, begins, rows, anchors, lengths))
            del pieces, begins, rows, anchors, lengths, data
            if units.words:
                letters, hashed, long = codes, np.concatenate(hashed), np.concatenate(sizes_)
                ends = np.cumsum(long + 1) - 1
                codes = K.distinct(letters, ends - long, ends, hashed)[0].astype(np.uint32)
            before = np.cumsum(size + units.span - 1) - (size + units.span - 1)
            where = spread(before, size)
            head = np.cumsum(size) - size
            late = late_windows(units, codes, doc[row[head]], start[head], size)
            pending[row] = True
            flagged = np.flatnonzero(late)
            if len(flagged):
                s, r = start[flagged], row[flagged]
                first = runs((s[1:] != s[:-1] + 1) | (r[1:] != r[:-1]))
                last = np.append(first[1:], len(s)) - 1
                pair = np.stack([s[first], s[last] + units.span], 1)
                owner = r[first]
                cut = np.append(runs(owner[1:] != owner[:-1]), len(owner))
                marks = {int(owner[a]): pair[a:b].tobytes() for a, b in zip(cut, cut[1:])}
            open_ = np.flatnonzero(~late)
            if len(open_):
                s, r, k, w = start[open_], row[open_], key[open_], where[open_]
                first = runs((w[1:] != w[:-1] + 1) | (r[1:] != r[:-1]) | (k[1:] != k[:-1]))
                count = np.diff(np.append(first, len(w)))
                part = (k[first] >> LOW).astype(np.int64)
                order = np.argsort(part, kind="stable")
                first, count, part = first[order], count[order], part[order]
                cut = np.append(runs(part[1:] != part[:-1]), len(part))
                begin, row_of = s[first], r[first]
                for a, b in zip(cut, cut[1:]):
                    own_rows, index = np.unique(row_of[a:b], return_inverse=True)
                    used = spread(w[first[a:b]], count[a:b] + units.span - 1)
                    body = (joined(letters, (ends - long)[used], ends[used]) if units.words else codes[used]).tobytes()
                    head = np.array([len(own_rows)]).tobytes() + doc[own_rows].tobytes() + uid[own_rows].tobytes() + index.astype(np.uint32).tobytes() + begin[a:b].astype(np.uint32).tobytes() + count[a:b].astype(np.uint32).tobytes()
                    out.append((int(buckets + part[a]), squeezed(body), head, bucket))
        shas, bodies = [], []
        for i, raw in enumerate(raws):
            gone = copied[i] and n_units[i] >= units.span  # a copy of an earlier document goes as a whole
            if gone:
                marks[i] = np.array([0, n_units[i]]).tobytes()
            shas.append(None if pending[i] else hashlib.sha256(b"" if gone else _plain(units, raw)).hexdigest())
            bodies.append(packed[i] if pending[i] or (texts_wanted and not gone) else None)
        own = _rows(rest.type, target=np.full(len(doc), bucket, np.int32), uid=uid.view(np.int64), rest=rest, body=bodies, marks=[marks.get(i, b"") for i in range(len(doc))], n=n_units, sha=shas)
        if not out:
            return own
        target, body, head, source = zip(*out, strict=True)
        return pa.concat_tables([own, _rows(rest.type, target=target, body=body, marks=head, n=source)])

    return bucket_of


def _resolve(units: Units, buckets: int):
    """Step 4; documents pass through."""

    def part_of(group: pa.Table) -> pa.Table:
        K.give_back()
        if group["target"][0].as_py() < buckets:
            return group
        heads = [_head(x) for x in group["marks"].to_pylist()]
        source = np.repeat(group["n"].to_pylist(), [h.shape[1] for h in heads])
        doc, uid, begin, count = np.concatenate(heads, axis=1)
        codes = np.concatenate([np.frombuffer(loosened(x.as_py()), np.uint8) for c in group["body"].chunks for x in c])
        if units.words:
            starts, ends, _ = K.words(codes, np.array([0, len(codes)]))
            codes = K.distinct(codes, starts, ends)[0].astype(np.uint32)
        seg = np.repeat(np.arange(len(doc)), count)
        start = spread(begin, count)
        late = late_windows(units, codes, doc, begin, count)
        seg, start = seg[late], start[late]
        rest_type = group.schema.field("rest").type
        if not len(seg):
            return _rows(rest_type, target=[])
        first = runs((seg[1:] != seg[:-1]) | (start[1:] != start[:-1] + 1))
        last = np.append(first[1:], len(seg)) - 1
        order = np.argsort(source[seg[first]], kind="stable")
        owner, lo, hi = (x[order] for x in (uid[seg[first]], start[first], start[last] + units.span))
        to = source[seg[first]][order]
        cut = np.append(runs(to[1:] != to[:-1]), len(to))
        return _rows(rest_type, target=to[cut[:-1]].astype(np.int32), marks=[_spans(owner[a:b], lo[a:b], hi[a:b]) for a, b in zip(cut, cut[1:])])

    return part_of


def _spans(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Removed ranges of some documents, packed: the ids once, then an index, a begin and a length each."""
    own, index = np.unique(uid, return_inverse=True)
    order = np.lexsort((lo, index))
    return squeezed(np.array([len(own)]).tobytes() + own.tobytes() + b"".join(x.astype(np.uint32).tobytes() for x in (np.diff(index[order], prepend=0), lo[order], (hi - lo)[order])))


def _from_spans(packed: bytes) -> np.ndarray:
    raw = loosened(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    own = np.frombuffer(raw, np.int64, n, 8)
    index, lo, length = np.frombuffer(raw, np.uint32, -1, 8 + 8 * n).reshape(3, -1).astype(np.int64)
    return np.stack([own[np.cumsum(index)], lo, lo + length], 1)


def _cover(pairs: np.ndarray) -> np.ndarray:
    """Union of half-open ranges, sorted and apart from each other."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = runs(pairs[1:, 0] > reach[:-1])
    return np.stack([pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1]], 1)


def _finish(units: Units, texts: bool):
    """Step 5."""

    def bucket_of(group: pa.Table) -> pa.Table:
        K.give_back()
        is_doc = pa.compute.is_valid(group["uid"])
        docs = group.filter(is_doc)
        far = [_from_spans(x) for x in group.filter(pa.compute.invert(is_doc))["marks"].to_pylist()]
        spans = np.concatenate([np.zeros((0, 3), np.int64), *far])
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        removed, n_spans, shas, kept, cuts = [], [], [], [], []
        for uid, packed, marks, sha in zip(docs["uid"].to_pylist(), docs["body"].to_pylist(), docs["marks"].to_pylist(), docs["sha"].to_pylist(), strict=True):
            body = loosened(packed) if packed is not None else b""
            if sha is None:
                a, b = np.searchsorted(spans[:, 0], uid, "left"), np.searchsorted(spans[:, 0], uid, "right")
                pairs = np.concatenate([np.frombuffer(marks, np.int64).reshape(-1, 2), spans[a:b, 1:]])
            else:
                pairs = np.frombuffer(marks, np.int64).reshape(-1, 2)
            if len(pairs):
                pairs = _cover(pairs)
            if len(pairs) and packed is not None:
                pieces = body.split() if units.words else body
                keep, at = [], 0
                for lo, hi in [*pairs.tolist(), (len(pieces), len(pieces))]:
                    keep += pieces[at:lo] if units.words else [pieces[at:lo]]
                    at = hi
                body = b" ".join(keep) if units.words else b"".join(keep)
                sha = hashlib.sha256(body).hexdigest()
            removed.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
            n_spans.append(len(pairs))
            shas.append(sha or hashlib.sha256(_plain(units, body)).hexdigest())
            if texts:
                kept.append(body)
                cuts.append(pairs.reshape(-1).tolist())
        columns = [docs["rest"], docs["n"], pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
        names = ["rest", "n_units", "n_removed", "n_spans", "kept_sha256"]
        if texts:
            columns += [pa.array(kept, pa.binary()), pa.array(cuts, pa.list_(pa.int64()))]
            names += ["kept", "cuts"]
        return pa.table(columns, names)

    return bucket_of


def remove_repeats(docs: DataFrame, units: Units, texts: bool = False, bucket_bytes: int = 8 << 20, least: int = 64) -> DataFrame:
    """(rest, n_units, n_removed, n_spans, kept_sha256 and, with ``texts``, kept, cuts) for every document.

    ``rest`` holds all columns but text; ``kept`` is what remains, as bytes, and
    ``cuts`` are the removed ranges, flattened, in units of the input.
    """
    spark_text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(spark_text))).first()[0] or 0
    buckets = max(least, total // bucket_bytes + 1)
    parts = int(min(1 << 30, max(least, total // bucket_bytes + 1)))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(buckets)).cast("int")
    content = F.unhex(F.sha2("text", 256))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    own = docs.select(rest.alias("rest"), doc.alias("doc"), content.alias("hash"), bucket.alias("bucket"), spark_text.alias("text"))
    sent = own.select("text", "bucket").mapInArrow(_send(units, parts), "part int, keys binary, buckets binary")
    known = sent.groupBy("part").applyInArrow(_return, "bucket int, part int, keys binary")
    whole = docs.where(F.octet_length("text") >= units.span).select(doc.alias("doc"), bucket.alias("bucket"), content.alias("hash"))
    firsts = whole.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("hash", "first")
    firsts = shared.keep(firsts, "firsts")  # a table of its own, so that Spark can split the join at a large group of copies
    copies = whole.join(firsts, "hash").where("doc > first").select("bucket", "doc", "hash")
    told = known.select("bucket", "part", "keys", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("hash")).unionByName(copies, allowMissingColumns=True)
    rest_type = own.schema["rest"].dataType.simpleString()
    moved = f"target int, uid long, rest {rest_type}, body binary, marks binary, n long, sha string"
    packed = own.mapInArrow(_squeeze, f"rest {rest_type}, doc long, hash binary, bucket int, body binary")
    local = packed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_local(units, buckets, parts, texts), moved)
    resolved = local.groupBy("target").applyInArrow(_resolve(units, buckets), moved)
    final = f"rest {rest_type}, n_units long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, cuts array<long>" if texts else "")
    return resolved.groupBy("target").applyInArrow(_finish(units, texts), final)


WORDS_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS late FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE late),
k AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
r AS (SELECT k.doc_id, count(*) FILTER (c.j IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY k.j) FILTER (c.j IS NULL) AS kept
      FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.j = k.j GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

BYTES_ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - 49 AS BIGINT))) AS i FROM d WHERE len(h) >= 100),
x AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS late FROM x),
e AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM f WHERE late),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e),
s AS (SELECT doc_id, n, min(i) AS lo, max(i) + 50 AS hi, lag(max(i) + 50, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM g GROUP BY doc_id, n),
r AS (SELECT s.doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS last,
        string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (lo - prev) AS BIGINT)), '' ORDER BY n) AS kept FROM s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
