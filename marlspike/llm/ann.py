"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue, then exact reranking.

The forest is fitted on a sample of at most ``SAMPLE`` vectors and split down to leaves of ``LEAF`` sample rows, so its size
has a bound whatever the table's. Every vector is indexed; a leaf's rows are estimated from its share of the sample. A query's
queue holds nodes of all trees by the cost of the way to them: each step adds ln(1 + exp(-z)), z being the query's margin on
the side taken over the node's spread, which is high for the wrong side of a clear split and low on either side of a close
one. Leaves are taken from the queue until those taken hold ``want`` rows over all trees. Rows and queries meet by leaf, rows
of a large leaf dealt into parts, and a task streams rows past the leaf's queries and keeps the best for each. Scores are
cosines of the original vectors in double precision.

Of rows with the same vector only the k + 1 smallest ids can be an answer (they tie), so the others are queries only.
Vectors that are null, zero, hold null or non-finite components, or have another length than most (ties: the longer),
take no part. Rows that repeat an id count as one candidate with the best of their scores; a query never finds its own
id. Empty tables give an empty result. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import by_batch, mix64, stored

SAMPLE = 20_000
TREES = 16
#: Sample rows in a leaf.
LEAF = 8
#: Rows that a query's leaves hold, over all trees: so many at least, and this share of the table.
SEARCH, SHARE = 4_000, 0.2
PART = 4096


class Tree(NamedTuple):
    normal: np.ndarray  # (nodes, d)
    offset: np.ndarray
    spread: np.ndarray
    child: np.ndarray  # (nodes, 2); a negative value -1 - j is leaf j
    size: np.ndarray  # sample rows of each leaf


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int) -> Tree:
    """A tree over the sample ``x``: nodes are split at the median between two of their rows down to ``leaf`` rows."""
    normals, offsets, spreads, children, sizes = [], [], [], [], []
    todo = [(np.arange(len(x)), None)]
    while todo:
        rows, above = todo.pop()
        n = np.zeros(x.shape[1], x.dtype)
        if len(rows) >= 2 * leaf:
            a, b = x[rng.choice(rows, 2, replace=False)]
            n = a - b
        if not n.any():  # small enough, or two equal rows were drawn
            me = -1 - len(sizes)
            sizes.append(len(rows))
        else:
            me = len(normals)
            n /= np.linalg.norm(n)
            side = x[rows] @ n
            off = float(np.median(side))
            right = side > off
            normals.append(n)
            offsets.append(off)
            spreads.append(max(1e-6, float(side.std())))
            children.append([0, 0])
            todo += [(rows[~right], (me, 0)), (rows[right], (me, 1))]
        if above:
            children[above[0]][above[1]] = me
    if not normals:  # a single leaf
        return Tree(np.zeros((1, x.shape[1]), np.float32), np.zeros(1), np.ones(1), np.array([[-1, -1]]), np.array(sizes))
    return Tree(np.array(normals, np.float32), np.array(offsets), np.array(spreads), np.array(children), np.array(sizes))


class Forest(NamedTuple):
    trees: list[Tree]
    share: float  # rows of the table for each of the sample

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf numbers."""
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, tree in enumerate(self.trees):
            node = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while len(live):
                at = node[live]
                right = np.einsum("ij,ij->i", x[live], tree.normal[at]) > tree.offset[at]
                node[live] = tree.child[at, right.astype(int)]
                live = live[node[live] >= 0]
            out[:, t] = -1 - node
        return out

    def parts(self, t: int) -> np.ndarray:
        """Into how many parts each leaf's rows are dealt."""
        return np.maximum(1, np.ceil(self.trees[t].size * self.share / PART)).astype(np.int64)

    def search(self, q: np.ndarray, want: float) -> list[tuple[int, int]]:
        """(tree, leaf), least cost first over all trees, until they hold about ``want`` rows."""
        cost = []
        for t in self.trees:
            z = (q @ t.normal.T - t.offset) / t.spread
            cost.append(np.stack([np.logaddexp(0, z), np.logaddexp(0, -z)], axis=1).tolist())
        child = [t.child.tolist() for t in self.trees]
        heap = [(0.0, t, 0) for t in range(len(self.trees))]
        got, out = 0.0, []
        while heap and got < want:
            p, t, node = heapq.heappop(heap)
            if node < 0:
                out.append((t, -1 - node))
                got += self.trees[t].size[-1 - node] * self.share
            else:
                for c, own in zip(child[t][node], cost[t][node], strict=True):
                    heapq.heappush(heap, (p + own, t, c))
        return out


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (an array of float or double), of rows that take part."""
    kind = table.schema["embedding"].dataType
    v = F.col("embedding")
    if not isinstance(kind.elementType, FloatType):
        v = v.cast("array<double>")
    ok = table.select("vec_id", v.alias("v")).filter(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    sizes = [(r["n"], r["d"]) for r in ok.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    return ok.filter(F.size("v") == max(sizes)[1]) if sizes else ok


def matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise, in double precision and the same whatever else is in the arrays."""
    a, b = a.astype(float), b.astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    if not np.isfinite(out).all():
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        out = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return out


def build(rows: DataFrame, n: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 11) -> Forest:
    if n > sample:
        cut = int(1.2 * sample / n * 2**31)
        rows = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(2**31)) < cut)
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    x = unit(matrix(got))
    rng = np.random.default_rng(seed)
    return Forest([grow(x, rng, leaf) for _ in range(trees)], n / max(1, len(x)))


def search(table: DataFrame, queries: str, k: int, trees: int = TREES, leaf: int = LEAF, want: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row that the SQL predicate ``queries`` picks."""
    spark = table.sparkSession
    valid = stored(vectors(table), "vectors")
    # The window's group limit keeps k + 1 rows of a vector in each task before any shuffle.
    same = Window.partitionBy("v").orderBy("vec_id")
    held = stored(valid.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k + 1).drop("_r"), "candidates")
    n = held.count()
    want = max(SEARCH, int(SHARE * n)) if want is None else want
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    forest = spark.sparkContext.broadcast(build(held, n, trees, leaf))  # TREES * SAMPLE / LEAF nodes at most
    kind = held.schema["v"].dataType
    place_schema = f"tree int, leaf int, part int, kind int, vec_id long, v {kind.simpleString()}"

    def flat(x, dtype):
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel().astype(dtype))

    def place(batches):
        f = forest.value
        for b in batches:
            x = matrix(b["v"])
            if not len(x):
                continue
            at, ids = f.leaves(unit(x)), b["vec_id"].to_numpy(zero_copy_only=False)
            for t in range(len(f.trees)):
                part = (mix64(ids.astype(np.uint64)) % f.parts(t)[at[:, t]].astype(np.uint64)).astype(np.int32)
                yield {"tree": np.full(len(x), t), "leaf": at[:, t], "part": part, "kind": np.ones(len(x), int), "vec_id": ids, "v": flat(x, x.dtype)}

    def probe(batches):
        f = forest.value
        dealt = [f.parts(t) for t in range(len(f.trees))]
        for b in batches:
            x = matrix(b["v"])
            for q, u, v in zip(b["vec_id"].to_pylist(), unit(x) if len(x) else (), x, strict=True):
                to = np.array([(t, leaf, part) for t, leaf in f.search(u, want) for part in range(dealt[t][leaf])])
                yield {"tree": to[:, 0], "leaf": to[:, 1], "part": to[:, 2], "kind": np.zeros(len(to), int), "vec_id": np.full(len(to), q), "v": flat(np.broadcast_to(v, (len(to), len(v))), x.dtype)}

    asked = by_batch(valid.filter(queries).select("vec_id", "v"), place_schema, probe)
    both = asked.unionByName(by_batch(held.select("vec_id", "v"), place_schema, place))

    def meet(batches):
        now, ids, qs = None, [], []
        for b in batches:
            out = {"query_id": [], "vec_id": [], "score": []}
            tree, leaf_, part, kind = (b[c].to_numpy(zero_copy_only=False) for c in ("tree", "leaf", "part", "kind"))
            vec, x = b["vec_id"].to_numpy(zero_copy_only=False), matrix(b["v"])
            cut = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (leaf_[1:] != leaf_[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), True]) if len(vec) else [0]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if (tree[lo], leaf_[lo], part[lo]) != now:
                    now, ids, qs = (tree[lo], leaf_[lo], part[lo]), [], []
                if kind[lo] == 0:
                    ids += vec[lo:hi].tolist()
                    qs += list(x[lo:hi])
                elif ids:
                    rows_ = x[lo:hi]
                    near = unit(np.array(qs)).astype(float) @ unit(rows_).astype(float).T
                    near[np.array(ids)[:, None] == vec[lo:hi][None, :]] = -2
                    # A margin over float32 error keeps all that might be among the k best.
                    take = min(k + 8, near.shape[1])
                    top = np.argpartition(-near, take - 1, axis=1)[:, :take]
                    level = np.sort(np.take_along_axis(near, top, 1), axis=1)[:, max(0, take - k)] - 1e-5
                    for i, q in enumerate(ids):
                        own = np.flatnonzero((near[i] >= level[i]) & (near[i] > -2))
                        s = cosine(np.broadcast_to(qs[i], (len(own), x.shape[1])), rows_[own])
                        best = np.lexsort((vec[lo:hi][own], -s))[:k]
                        out["query_id"] += [q] * len(best)
                        out["vec_id"] += vec[lo:hi][own[best]].tolist()
                        out["score"] += s[best].tolist()
            yield out

    met = by_batch(both.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", "kind"), "query_id long, vec_id long, score double", meet)
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(table: DataFrame) -> DataFrame:
    return search(table, "vec_id % 50 = 0", 5)
