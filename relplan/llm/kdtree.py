"""Exact top-k search by integer inner product: a KD-tree per shard of the vectors.

A shard's tree splits at medians of the widest dimension and keeps a tight box for
every node.  It is built once and stored with its vectors.  The highest product a
box can hold with a query bounds everything below it: each query visits nodes
best-first from the root, opens an inner one or searches a leaf, and stops at the
first bound below its kth score.

Queries come in blocks of a bounded number, which all shards get.  Shards take
part in waves, each about four times as large as the one before, and every query
carries the kth score found so far from wave to wave; the first wave is one small
shard.  Vectors stay where they are, and only k rows per query and shard travel.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without id; only vectors of equal length
are compared; a row never meets rows of its own id; repeated query ids are asked
once; ties go to the smaller id; products beyond 64 bits stop at the limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relplan.sources import shared

LEAF = 256
_EXACT = 2.0**53
_FOUND = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Tree:
    """Node i holds the rows lo[i] .. hi[i]-1 of the ordered vectors inside its box; leaves have no left child."""

    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """(order of the vectors, tree over them in that order)."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        part = x[order[lo:hi]]
        low, high = part.min(0), part.max(0)
        me = len(nodes)
        nodes.append([lo, hi, -1, -1, low, high])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if hi - lo <= leaf:
            continue
        mid = (hi - lo) // 2
        if (high > low).any():  # equal vectors are split anywhere
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, int((high - low).argmax())], mid)]
        todo += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]
    return order, Tree(*(np.array([n[i] for n in nodes]) for i in range(6)))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; exact, by Python integers where doubles are not."""
    if len(q) and len(x) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= _EXACT:
        big = [[int(v) for v in row] for row in x]
        out = [[min(max(sum(int(a) * b for a, b in zip(row, y, strict=True)), -(2**63)), 2**63 - 1) for y in big] for row in q]
        return np.array(out, dtype=object).reshape(len(q), len(x))
    return q @ x.T


def _merge(s1, i1, s2, i2, k):
    """The k best of two lists of (score, id) per row; best first, ties to the smaller id."""
    s, i = np.concatenate([s1, s2], 1), np.concatenate([i1, i2], 1)
    pick = np.stack([np.lexsort((i[r], -s[r])) for r in range(len(s))])[:, :k] if s.dtype == object else np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)


def _merge(s1, i1, s2, i2, k):
    """The k best of two lists of (score, id) per row; best first, ties to the smaller id."""
    s, i = np.concatenate([s1, s2], 1), np.concatenate([i1, i2], 1)
    pick = np.stack([np.lexsort((i[r], -s[r])) for r in range(len(s))])[:, :k] if s.dtype == object else np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)


def search(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, tree: Tree, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best rows of one shard (-inf, -1 where fewer); floor: a kth score known before."""
    exact = not len(q) or np.abs(q).max() * max(np.abs(tree.low[0]).max(), np.abs(tree.high[0]).max()) * q.shape[1] < _EXACT
    above, below = np.maximum(q, 0), np.minimum(q, 0)
    score = np.full((len(q), k), -np.inf, dtype=float if exact else object)
    ident = np.full((len(q), k), -1, np.int64)
    kth, active = floor.copy(), np.arange(len(q))
    bound = np.full((len(q), len(tree.lo)), -np.inf)

    def reach(rows: np.ndarray, node: int) -> np.ndarray:
        b = above[rows] @ tree.high[node] + below[rows] @ tree.low[node]
        return b if exact else b * (1 + np.sign(b) * 1e-9)  # above rounding

    bound[:, 0] = reach(active, 0)
    while len(active):
        best = bound[active].argmax(1)
        b = bound[active, best]
        keep = (b >= kth[active]) & (b > -np.inf)
        active, best = active[keep], best[keep]
        order = np.argsort(best, kind="stable")
        for rows in np.split(active[order], np.flatnonzero(np.diff(best[order])) + 1) if len(active) else ():
            node = int(bound[rows[0]].argmax())
            bound[rows, node] = -np.inf
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    bound[rows, child] = reach(rows, child)
                continue
            inside = slice(tree.lo[node], tree.hi[node])
            got = products(q[rows], x[inside])
            near = np.broadcast_to(ids[inside], got.shape).copy()
            got = np.where(near == qid[rows][:, None], -np.inf, got)
            score[rows], ident[rows] = _merge(score[rows], ident[rows], got, near, k)
            kth[rows] = np.maximum(kth[rows], score[rows, k - 1].astype(float))
    return score, ident


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.float64).reshape(len(flat), -1)


_STORED = "dim int, shard int, ids binary, x binary, lo binary, hi binary, left binary, right binary, low binary, high binary"


def _planted(scale: float):
    """A shard's tree and its vectors in the tree's order, as one row."""

    def shard_of(group: pa.Table) -> pa.Table:
        x = np.floor(scale * _matrix(group["v"]))
        order, tree = build(x)
        parts = [np.asarray(group["vec_id"]).astype(np.int64)[order], x[order], *(np.asarray(a, np.int64) for a in (tree.lo, tree.hi, tree.left, tree.right)), tree.low, tree.high]
        return pa.table([group["dim"].slice(0, 1), group["shard"].slice(0, 1), *(pa.array([a.tobytes()], pa.binary()) for a in parts)], [c.split()[0] for c in _STORED.split(", ")])

    return shard_of


def _searched(sent, k: int, block: int = 2048):
    """The k best of every query in each shard of a batch."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in it:
            for row in batch.to_pylist():
                if row["dim"] not in asked:
                    continue
                qid, q, floor = asked[row["dim"]]
                ids, (lo, hi, left, right) = np.frombuffer(row["ids"], np.int64), (np.frombuffer(row[c], np.int64) for c in ("lo", "hi", "left", "right"))
                x, low, high = (np.frombuffer(row[c]).reshape(-1, row["dim"]) for c in ("x", "low", "high"))
                for a in range(0, len(q), block):
                    part = slice(a, a + block)
                    score, ident = search(qid[part], q[part], ids, x, Tree(lo, hi, left, right, low, high), k, floor[part])
                    at, column = np.nonzero(score != -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[part][at]), pa.array(ident[at, column]), pa.array([int(v) for v in score[at, column]], pa.int64())], ["query_id", "vec_id", "score"])

    return batches


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, shard_rows: int = 16_384, query_rows: int = 8_192, seed_rows: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    real = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    table = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & real)
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, lambda v: v.cast("double")).alias("v"))
    asked = F.col("vec_id") % every == 0
    n, nq = table.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(nq / query_rows))
    hashed = F.xxhash64("vec_id")
    first = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(min(1.0, seed_rows / max(1, n)) * (1 << 20))
    dealt = table.withColumn("shard", F.when(first, 0).otherwise(F.pmod(hashed, F.lit(shards)) + 1).cast("int"))
    trees = shared.keep(dealt.groupBy("dim", "shard").applyInArrow(_planted(scale), _STORED), "trees")
    queries = shared.keep(table.where(asked).dropDuplicates(["vec_id"]).withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int")), "queries")
    waves = [(0, 1)]
    while waves[-1][1] <= shards:
        waves.append((waves[-1][1], min(shards + 1, max(8, 4 * waves[-1][1]))))
    every_found = []
    for block in range(blocks):
        some = queries.where(F.col("block") == block).select("vec_id", "dim", "v").toArrow()
        own = []
        for lo, hi in waves:
            kth = {}
            if own:
                all_ = own[0]
                for other in own[1:]:
                    all_ = all_.unionByName(other)
                best = all_.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # k rows a shard and query
                kth = {r.query_id: float(r.s) for r in best.select("query_id", F.get("s", F.lit(k - 1)).alias("s")).where("s is not null").collect()}
            by_dim = {}
            for dim in set(some["dim"].to_pylist()):
                part = some.filter(pa.compute.equal(some["dim"], dim))
                ids = np.asarray(part["vec_id"])
                by_dim[dim] = (ids, np.floor(scale * _matrix(part["v"])), np.array([kth.get(i, -np.inf) for i in ids.tolist()]))
            sent = spark.sparkContext.broadcast(by_dim)  # at most about query_rows queries
            own.append(shared.keep(trees.where((F.col("shard") >= lo) & (F.col("shard") < hi)).mapInArrow(_searched(sent, k), _FOUND), "found"))
        every_found += own
    found = every_found[0]
    for other in every_found[1:]:
        found = found.unionByName(other)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
