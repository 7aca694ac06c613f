"""Near-duplicate groups: fast similarity sketches, banding, and exact verification.

A document's set of word shingles is sketched into ``coordinates`` bins by rounds
of hashed placement: in round i every shingle falls into one random bin with a
value in [i, i+1), and a bin keeps its least value; after as many rounds as there
are bins, round i fills bin i - bins with the least value of all.  Every bin is
filled then, and equal bins of two sketches estimate the similarity with strong
concentration.  Bins are grouped into bands; documents that share a band are
candidates, and every candidate pair that matters is verified on full sets.

First every document is verified against one other, the leader of its buckets
that it shares most bands with; the leader of a bucket is the member that meets
most others over all its buckets.  Linked documents merge.  Of buckets that still
hold two components, members first meet by size and by one byte of each bin: who
has no likely partner in another component leaves.  A pair at the threshold
passes but with a chance below 1e-7, less than that of sharing no band.  The
others are compared in full, in blocks: a block has a bounded number of members
and bytes, every pair of blocks of a bucket is one task's group, and a group
sends on at most one link for each merger it sees.  Only pairs inside one
component are skipped, so no link between components is lost otherwise.

Hashes of shingles only reject; what they accept is confirmed on the words
themselves.  Documents of equal words (by SHA-256) are one class from the start.

Defined cases: null and empty texts, and texts without words, have no shingles
and link with nothing; fewer than five words are one shingle; equal ids count as
one document; rows without id link with nothing, have no component and are kept;
an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relplan.sources import shared

from . import kernels as K
from .substrings import loosened, runs, squeezed

SHINGLE, COORDINATES, BAND = 5, 192, 6
EMPTY = K.U64(2**64 - 1)
_rng = np.random.Generator(np.random.PCG64(8171))
_SEED = _rng.integers(1, 2**63, 4096, dtype=np.uint64)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * K.U64(2) + K.U64(1)


def sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and how many come before each row."""
    starts, ends, counts = K.words(data, offsets)
    codes = K.hashes(K.LOWER[data], starts, ends)
    at, n = K.within(counts, k), np.diff(counts)
    value, row = [K.grams(codes, k)[at]], [np.searchsorted(counts, at, "right") - 1]
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):
            value.append(K.mix(K.grams(codes, m)[counts[few]] + K.U64(m)))
            row.append(few)
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        once = runs((value[1:] != value[:-1]) | (row[1:] != row[:-1]))
        value, row = value[once], row[once]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def sketch(values: np.ndarray, counts: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of t filled bins for each non-empty set; EMPTY throughout for the others."""
    n = len(counts) - 1
    out = np.full(n * t, EMPTY, K.U64)
    row, x = np.repeat(np.arange(n), np.diff(counts)), values
    missing = np.full(n, t)
    for i in range(2 * t):
        if not len(x):
            break
        h = K.mix(x + _SEED[i])
        bins = ((h & K.U64(0xFFFFFFFF)) * K.U64(t) >> K.U64(32)).astype(np.int64) if i < t else i - t
        at = row * t + bins
        fresh = at[out[at] == EMPTY]
        np.minimum.at(out, at, K.U64(i << 32) | (h >> K.U64(32)))
        fresh = np.unique(fresh)
        missing -= np.bincount(fresh // t, minlength=n)
        keep = missing[row] > 0
        row, x = row[keep], x[keep]
    return out.reshape(n, t)


def bands(bins: np.ndarray, width: int = BAND) -> np.ndarray:
    """One key for each ``width`` bins."""
    n, t = bins.shape
    parts = bins.reshape(n, t // width, width)
    total = np.broadcast_to(_SEED[: t // width], (n, t // width)).copy()
    for j in range(width):
        total += parts[:, :, j] * _MIX[j]
    return K.mix(total)


def _sketched(k: int, t: int, width: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            K.give_back()
            data, offsets = K.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in K.slices(offsets):
                value, counts = sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                n = np.diff(counts)
                some = n > 0
                bins = sketch(value, counts, t)[some]
                keys = bands(bins, width)
                ends = np.concatenate([[0], np.cumsum(np.where(some, keys.shape[1], 0))]).astype(np.int32)
                low = iter(np.ascontiguousarray((bins & K.U64(255)).astype(np.uint8)))
                short = [next(low).tobytes() if x else None for x in some]
                same = [hashlib.sha256(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().lower().split())).digest() if some[i - lo] else None for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(same, pa.binary()), pa.array(short, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))], ["doc_id", "n_shingles", "same", "short", "bands"])

    return batches


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = K.buffers(batch.column("text"))
        raw = data.tobytes()
        body = [squeezed(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(body, pa.binary())], ["node", "body"])


def full_set(body: bytes, k: int) -> np.ndarray:
    raw = np.frombuffer(loosened(body), np.uint8)
    return sets(raw, np.array([0, len(raw)]), k)[0]


def word_set(body: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = loosened(body).lower().split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def surely(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(k: int, percent: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        spelt: dict[bytes, set] = {}

        def kept(body: bytes, table: dict, make, most: int):
            if body not in table:
                if len(table) >= most:
                    table.clear()
                table[body] = make(body, k)
            return table[body]

        for batch in it:
            ok = []
            for a, b in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
                a, b = a.as_py(), b.as_py()
                x, y = (kept(z, known, full_set, 64) for z in (a, b))
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small < percent * large:
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                both_have = int((both[1:] == both[:-1]).sum())
                ok.append(100 * both_have >= percent * (len(both) - both_have) and surely(*(kept(z, spelt, word_set, 4) for z in (a, b)), percent))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return batches


def verified(edges: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``edges`` whose full sets are similar enough; texts: (node, body)."""
    one = edges.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    return shared.keep(two.select("a", "b", "body_a", "body_b").mapInArrow(_confirmed(k, percent), "a long, b long"), "links")


def relabelled(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` replaced by what ``mapping`` (node, comp) has for it, if it has."""
    m = mapping.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    joined = df.join(m, F.col(column) == F.col("_node"), "left")
    return joined.select(*[F.coalesce("_comp", column).alias(c) if c == column else F.col(c) for c in df.columns])


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after the links join components; comp is the least id.  Each pass hooks to the least neighbour and shortens paths by halves."""
    spark = links.sparkSession

    def contracted(e: DataFrame) -> DataFrame:
        apart = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return shared.keep(apart, "edges")

    edges = contracted(relabelled(relabelled(links.select("a", "b"), "a", labels), "b", labels))
    total = labels
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        hooks = shared.keep(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("comp")), "hooks")
        while True:
            jump = hooks.join(hooks.select(F.col("node").alias("_n"), F.col("comp").alias("_c")), F.col("comp") == F.col("_n")).select("node", F.col("_c").alias("comp"), (F.col("_c") != F.col("comp")).alias("moved"))
            further = shared.keep(jump, "hooks")
            hooks = further.select("node", "comp")
            if further.where("moved").isEmpty():
                break
        fresh = hooks.join(total.select("node"), "node", "left_anti")
        total = shared.keep(relabelled(total, "comp", hooks).unionByName(fresh), "labels")
        edges = contracted(relabelled(relabelled(edges, "a", hooks), "b", hooks))
    return total


def _compared(k: int, percent: int):
    """Links between components inside the group of two blocks."""

    def group_of(group: pa.Table) -> pa.Table:
        K.give_back()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        node, comp, block = (np.asarray(group[c]) for c in ("node", "comp", "block"))
        bodies = group["body"].to_pylist()
        values = [full_set(x, k) for x in bodies]
        n = np.array([len(v) for v in values])
        row, value = np.repeat(np.arange(len(n)), n), np.concatenate(values)
        order = np.argsort(value)
        value, row = value[order], row[order]
        first = runs(value[1:] != value[:-1])
        many = np.diff(np.append(first, len(value)))
        column = np.repeat(np.cumsum(many > 1) - 1, many)[np.repeat(many > 1, many)]
        row = row[np.repeat(many > 1, many)]
        common = np.zeros((len(n), len(n)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [lo, lo + 8192])
            part = np.zeros((len(n), 8192), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            common += part @ part.T
        close = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (comp[:, None] != comp[None, :])
        if i != j:
            close &= block[:, None] != block[None, :]
        label = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while label[c] != c:
                label[c] = label[label[c]]
                c = label[c]
            return c

        found = []
        for x, y in np.argwhere(np.triu(close, 1)).tolist():
            one, two = root(int(comp[x])), root(int(comp[y]))
            if one != two and surely(word_set(bodies[x], k), word_set(bodies[y], k), percent):
                label[max(one, two)] = min(one, two)
                found.append((node[x], node[y]))
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    return group_of


def _likely(percent: int, t: int):
    """Members of two blocks that may have a partner in another component, by their sizes and short sketches."""
    share = percent / 100
    need = t * share - 8 * (t * share * (1 - share)) ** 0.5

    def group_of(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        node, comp, block, n = (np.asarray(group[c]) for c in ("node", "comp", "block", "n_shingles"))
        short = np.frombuffer(b"".join(group["short"].to_pylist()), np.uint8).reshape(len(node), t)
        close = np.zeros(len(node), bool)
        for lo in range(0, len(node), 64):
            part = slice(lo, lo + 64)
            may = (comp[part, None] != comp) & (100 * np.minimum(n[part, None], n) >= percent * np.maximum(n[part, None], n))
            if i != j:
                may &= block[part, None] != block
            x, y = np.nonzero(may)
            for a in range(0, len(x), 1 << 15):
                u, v = x[a : a + (1 << 15)] + lo, y[a : a + (1 << 15)]
                hit = (short[u] == short[v]).sum(1) >= need
                close[u[hit]], close[v[hit]] = True, True
        return pa.table([group["key"].filter(pa.array(close)), pa.array(node[close]), pa.array(comp[close])], ["key", "node", "comp"])

    return group_of


def _dealt(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every pair of blocks (i, j) of a bucket with their members; blocks: (key, blocks)."""
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", "block")


def groups(docs: DataFrame, percent: int = 85, k: int = SHINGLE, coordinates: int = COORDINATES, band: int = BAND, block_rows: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = shared.keep(plain.mapInArrow(_sketched(k, coordinates, band), "doc_id long, n_shingles long, same binary, short binary, bands array<long>"), "sketches")
    same = ["same"]
    classes = shared.keep(table.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    first = table.select("doc_id", "n_shingles", *same, "short", "bands").join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", *same], "left_semi")
    keyed = shared.keep(first.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node")), "keys")
    crowded = shared.keep(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    buckets = shared.keep(keyed.join(crowded, "key"), "buckets")
    met = shared.keep(buckets.groupBy("node").agg(F.sum("size").alias("met")), "met")
    texts = shared.keep(plain.withColumnRenamed("doc_id", "node").join(met.select("node"), "node", "left_semi").select("node", "text").mapInArrow(_packed, "node long, body binary"), "texts")
    labels = spark.createDataFrame([], "node long, comp long")

    ranked = buckets.select("key", "node").join(met, "node")
    leaders = shared.keep(ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("x")).select("key", (-F.col("x.least")).alias("leader"), F.col("x.met").alias("most")), "leaders")
    pairs = buckets.join(leaders, "key").where("node <> leader")
    counted = pairs.groupBy("node", "leader", "most").agg(F.count("*").alias("n"))
    best = counted.groupBy("node").agg(F.max(F.struct("n", "most", (-F.col("leader")).alias("least"))).alias("x"))
    edges = shared.keep(best.select((-F.col("x.least")).alias("a"), F.col("node").alias("b")), "pairs")
    labels = merged(labels, verified(edges, texts, k, percent))

    open_ = shared.keep(relabelled(buckets.select("key", "node", F.col("node").alias("comp")), "comp", labels), "open")
    several = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = shared.keep(open_.join(shared.keep(several, "several"), "key"), "open")
    if not open_.isEmpty():
        short = shared.keep(first.select(F.col("doc_id").alias("node"), "n_shingles", "short").join(open_.select("node").distinct(), "node", "left_semi"), "short")
        extent = open_.groupBy("key").agg(F.ceil(F.count("*") / (4 * block_rows)).cast("int").alias("blocks"))
        met_again = _dealt(open_, shared.keep(extent, "extent")).join(short, "node").groupBy("key", "i", "j").applyInArrow(_likely(percent, coordinates), "key long, node long, comp long")
        left = shared.keep(met_again.distinct(), "likely")
        weighed = left.join(texts.select("node", F.octet_length("body").alias("bytes")), "node")
        extent = weighed.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("bytes") / block_bytes)).cast("int").alias("blocks"))
        links = _dealt(left, shared.keep(extent, "extent")).join(texts, "node").groupBy("key", "i", "j").applyInArrow(_compared(k, percent), "a long, b long")
        labels = merged(labels, shared.keep(links, "links"))

    named = table.select("doc_id", "n_shingles", *same).join(classes, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("component_id"))
    named = relabelled(shared.keep(named, "named"), "component_id", labels)
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, all columns; of rows with equal ids and texts one stays, rows without id all."""
    gone = shared.keep(groups(docs.select("doc_id", "text"), **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    again = shared.keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "again")
    if again.isEmpty():
        return left
    same = F.col("doc_id") == F.col("_again")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # columns may be of any type, so they are carried and not compared
    one = left.join(again, same, "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("_text")).agg(F.any_value(row).alias("row"))
    return left.join(again, same, "left_anti").unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
x AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, c.doc_id AS b, count(*) AS shared FROM x a JOIN x c ON a.s = c.s AND a.doc_id <> c.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
r AS (SELECT a AS doc_id, a AS to_id FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id),
m AS (SELECT doc_id, min(to_id) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, coalesce(m.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
