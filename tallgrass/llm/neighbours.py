"""Most similar vectors by vantage-point trees.

A node of a tree has a vantage point and a radius: nearer vectors go to its inside,
the others to its outside. By the triangle inequality two vectors at distance r
can't differ by more than r in their distance to the vantage point, so a search
within r may skip a side that is further away than r. With many dimensions the
distances to one point hardly spread and nearly nothing can be skipped; but two
near vectors differ there by far less than r (by about r / sqrt(dimensions)). So r
is divided by a factor ``relax``. With a factor of 1 the search is exact.

There are two searches:

* ``similar_pairs`` finds every vector's partners within a fixed distance. The top
  of the tree, fitted on a bounded sample, cuts all vectors into shards; a vector
  that lies within half of the relaxed distance of a boundary goes to both sides,
  so that every pair which the relaxed rule doesn't skip meets in a shard. Inside a
  shard the tree goes on down to small leaves.
* ``nearest`` finds the k nearest of a set of queries. The top of the tree cuts the
  vectors into shards with a tree each. A query first looks in its own shard; the
  distance of the k-th best there tells which other shards it may skip.

Vectors travel as one byte per number with a factor of their own; what is found is
checked against the original numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.session import cut_lineage

#: Vectors on which the top of the tree is fitted. A parameter of the fit only; all vectors are indexed.
SAMPLE = 16384
#: Vectors that a shard should own, and how many may at most meet in one task.
SHARD, BLOCK = 6144, 24576
#: Vectors in a leaf of a shard's own tree.
LEAF = 768
RELAX = 5.0
#: Candidates may miss the threshold by this much before they are checked, for the rounding to bytes.
ROUNDING = 0.015


# -- vectors as bytes -----------------------------------------------------------
def pack(vectors: np.ndarray) -> list[bytes]:
    """Directions of the rows as signed bytes, each scaled by its largest number."""
    scaled = vectors * (127.0 / np.abs(vectors).max(axis=1, keepdims=True))
    rows = np.rint(scaled).astype(np.int8)
    return [r.tobytes() for r in rows]


def unpack(packed, dimensions: int) -> np.ndarray:
    """Rows of length 1 from packed vectors."""
    out = np.frombuffer(b"".join(packed), dtype=np.int8).reshape(-1, dimensions).astype(np.float32)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def packed_vectors(points: DataFrame, dimensions: int, key: str, column: str) -> DataFrame:
    """``(key, v)`` of the usable vectors: the right length, finite, not all zero. Each key once.

    If a key comes with different vectors, the smallest packed one counts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(1)
            lengths = np.asarray(vectors.value_lengths().fill_null(0))
            ok = np.flatnonzero(lengths == dimensions)
            if len(ok):
                flat = vectors.take(pa.array(ok)).flatten()
                matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
                good = np.isfinite(matrix).all(axis=1) & (np.abs(matrix).max(axis=1) > 0)
                keys = batch.column(0).take(pa.array(ok[good]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(pack(matrix[good]), pa.binary())], names=[key, "v"])

    kind = points.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("v", T.BinaryType())])
    usable = points.where(F.col(key).isNotNull() & (F.size(column) == dimensions)).select(key, F.col(column).cast("array<double>").alias(column))
    return usable.mapInArrow(run, schema).groupBy(key).agg(F.min("v").alias("v"))


# -- trees ----------------------------------------------------------------------
@dataclass
class Tree:
    """Nodes in an array: vantage points, radii, children (negative: leaf number - 1)."""

    points: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    n_leaves: int

    def route(self, vectors: np.ndarray, margin: float) -> list[np.ndarray]:
        """For each leaf the rows that belong there or lie within ``margin`` of it at every node on the way."""
        return [rows for rows, _ in self.descend(vectors, np.full(len(vectors), margin, np.float32))]

    def descend(self, vectors: np.ndarray, margins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``route`` with a margin per row, and beside the rows of each leaf how far they are from it at most at the nodes on the way.

        A row is compared only with the vantage points on its own ways down.
        """
        out = [(np.empty(0, np.int64), np.empty(0, np.float32))] * self.n_leaves
        everything = np.arange(len(vectors)), np.zeros(len(vectors), np.float32)
        if not len(self.radii):
            return [everything]
        stack = [(0, *everything)]
        while stack:
            node, rows, gaps = stack.pop()
            if node < 0:
                out[-node - 1] = rows, gaps
                continue
            if not len(rows):
                continue
            off = distances(vectors[rows], self.points[node : node + 1])[:, 0] - self.radii[node]
            inside, outside = off <= margins[rows], off > -margins[rows]
            stack.append((self.children[node, 0], rows[inside], np.maximum(gaps[inside], off[inside])))
            stack.append((self.children[node, 1], rows[outside], np.maximum(gaps[outside], -off[outside])))
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def fit(sample: np.ndarray, depth: int, seed: int = 7) -> Tree:
    """A tree of at most ``depth`` levels. Of some candidates the point whose distances spread most is taken.

    A node is not cut if its vectors are all equally far from every candidate, as
    are copies of one vector.
    """
    rng = np.random.default_rng(seed)
    points, radii, children = [], [], []
    leaves = 0

    def grow(rows: np.ndarray, level: int) -> int:
        nonlocal leaves
        if level > 0 and len(rows) > 1:
            tried = sample[rng.choice(rows, min(len(rows), 24), replace=False)]
            some = rows if len(rows) <= 1024 else rng.choice(rows, 1024, replace=False)
            spread = distances(sample[some], tried).std(axis=0)
            best = int(np.argmax(spread))
            if spread[best] > 1e-4:
                d = distances(sample[rows], tried[best : best + 1])[:, 0]
                radius = float(np.median(d))
                inside = d <= radius
                if not inside.all():
                    node = len(points)
                    points.append(tried[best])
                    radii.append(radius)
                    children.append([0, 0])
                    children[node][0] = grow(rows[inside], level - 1)
                    children[node][1] = grow(rows[~inside], level - 1)
                    return node
        leaves += 1
        return -leaves

    grow(np.arange(len(sample)), depth)
    shape = (len(points), sample.shape[1] if sample.ndim == 2 else 0)
    return Tree(np.array(points, np.float32).reshape(shape), np.array(radii, np.float32), np.array(children, np.int64).reshape(-1, 2), max(1, leaves))


def reach(min_cosine: float) -> float:
    """Distance of two vectors of length 1 with that cosine."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * min_cosine))


# -- pairs within a distance ----------------------------------------------------
def close_pairs(left: np.ndarray, right: np.ndarray | None, min_cosine: float, relax: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs with at least that cosine: inside ``left``, or between ``left`` and ``right``.

    A tree is fitted on the vectors, and pairs are looked for in its leaves, with
    vectors near a boundary in both. A leaf is compared in strips, so that memory
    stays bounded however large it is.
    """
    both = left if right is None else np.concatenate([left, right])
    n = len(left)
    depth = max(0, math.ceil(math.log2(max(1, len(both)) / leaf)))
    rng = np.random.default_rng(11)
    sample = both if len(both) <= 4096 else both[rng.choice(len(both), 4096, replace=False)]
    tree = fit(sample, depth)
    found_a, found_b, found_c = [], [], []
    for rows in tree.route(both, reach(min_cosine) / relax / 2):
        if len(rows) < 2:
            continue
        a, b = (rows, rows) if right is None else (rows[rows < n], rows[rows >= n])
        others = both[b].T
        for i in range(0, len(a), 1024):
            part = both[a[i : i + 1024]] @ (others if right is not None else others[:, i:])
            x, y = np.nonzero(part >= min_cosine)
            shift = i if right is None else 0
            keep = (y + shift > x + i) if right is None else slice(None)
            x, y = x[keep], y[keep]
            found_a.append(a[x + i])
            found_b.append(b[y + shift])
            found_c.append(part[x, y])
    if not found_a:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.float32),)
    a, b, c = map(np.concatenate, (found_a, found_b, found_c))
    _, first = np.unique(a * len(both) + b, return_index=True)
    return a[first], b[first], c[first]


def _keep_top(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Mask of the pairs that are among the ``k`` best (with ties) of one of their ends."""
    keep = np.zeros(len(a), bool)
    for ends in (a, b):
        order = np.lexsort((-c, ends))
        starts = np.r_[True, ends[order][1:] != ends[order][:-1]]
        first = np.maximum.accumulate(np.where(starts, np.arange(len(a)), 0))
        rank = np.arange(len(a)) - first
        cut = c[order][np.minimum(first + k - 1, len(a) - 1)]
        same = ends[order][np.minimum(first + k - 1, len(a) - 1)] == ends[order]
        keep[order[(rank < k) | same & (c[order] >= cut)]] = True
    return keep


def similar_pairs(
    points: DataFrame, min_cosine: float, k: int | None = 10, key: str = "point_id", column: str = "dense", dimensions: int = 64, relax: float = RELAX, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """``(a, b, cosine)`` with a < b: each vector's ``k`` most similar vectors of at least ``min_cosine``.

    With ``k=None`` no link is left out: the result then has all pairs between different
    vectors, each by the smallest key of its class of copies, and for each further copy the pair
    with that key, which is its membership.

    A pair is returned if it is among the ``k`` best of one of its ends. Vectors that
    are null, all zero, not finite or of another length have no partners; repeated
    rows count once. Copies of one packed vector are collapsed to a class first, whose
    first k + 1 keys stand for it: a larger group of copies gives the pairs among
    these keys, and between each further copy and the first k, which is every copy's
    k best, without all pairs of the group.

    A shard that has become larger than ``block`` is cut into blocks, and its pairs of
    blocks are separate tasks, so a dense place in space neither overfills a task nor
    loses a pair.
    """
    packed = cut_lineage(packed_vectors(points, dimensions, key, column))
    classes, members = _classes(packed, key, 0 if k is None else k)
    n = packed.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / shard)))
    tree = _fitted(packed, n, depth, dimensions)
    margin = reach(min_cosine) / relax / 2
    routed = _route(classes.select(key, "v"), key, tree, margin, dimensions)
    routed = _blocks(routed, key, block)
    loose = min_cosine - ROUNDING
    kind = T.StructField(key, packed.schema[key].dataType)
    out_schema = T.StructType([T.StructField("a", kind.dataType), T.StructField("b", kind.dataType), T.StructField("rough", T.FloatType())])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["part"].to_numpy() == 0
        keys = pdf[key].to_numpy()
        vectors = unpack(pdf["v"], dimensions)
        order = np.argsort(~first, kind="stable")
        keys, vectors, n_left = keys[order], vectors[order], int(first.sum())
        if n_left == len(keys) or n_left == 0:
            a, b, c = close_pairs(vectors, None, loose, relax)
        else:
            a, b, c = close_pairs(vectors[:n_left], vectors[n_left:], loose, relax)
        keep = slice(None) if k is None else _keep_top(a, b, c, k)
        return pd.DataFrame({"a": keys[a[keep]], "b": keys[b[keep]], "rough": c[keep]})

    rough = routed.groupBy("shard", "pair").applyInPandas(search, out_schema)
    ordered = rough.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    if k is None:
        copies = packed.join(classes.where("_n > 1").select("v", F.col(key).alias("rep")), "v").select(F.col("rep").alias("a"), F.col(key).alias("b")).where("a <> b")
        return _checked(cut_lineage(ordered.unionByName(copies)), points, key, column, dimensions, min_cosine)
    # Keys of one class stand for its other keys as well.
    ends = lambda c: members.select(F.col("rep").alias(c), F.col(key).alias(f"{c}_key"))
    across = ordered.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_key").alias("x"), F.col("b_key").alias("y"))
    # Every copy pairs with the first k of its class; the lists of these are short.
    heads = members.where("place <= %d and size > 1" % k).groupBy("rep").agg(F.collect_list(key).alias("_heads"))
    copies = packed.join(classes.where("_n > 1").select("v", F.col(key).alias("rep")), "v").select("rep", F.col(key).alias("x"))
    within = copies.join(heads, "rep").select("x", F.explode("_heads").alias("y"))
    both = across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _top_of_either(_checked(cut_lineage(both), points, key, column, dimensions, min_cosine), k)


def _classes(packed: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``(key, v, _n)``: one row per packed vector with its smallest key and the number of its
    copies; and ``(rep, key, place, size)``: the first k + 1 keys of each class.

    The cut to k + 1 is a rank filter, which Spark applies before the shuffle, so that
    a class with a third of all vectors costs k + 1 rows per task.
    """
    first = cut_lineage(packed.groupBy("v").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_n")))
    several = first.where("_n > 1").select("v", F.col(key).alias("rep"), F.col("_n").alias("size"))
    w = Window.partitionBy("v").orderBy(key)
    inside = packed.join(several.select("v"), "v", "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).join(several, "v")
    alone = first.where("_n = 1").select(F.col(key).alias("rep"), F.col(key).alias(key), F.lit(1).alias("place"), F.lit(1).cast("bigint").alias("size"))
    return first, inside.select("rep", key, "place", "size").unionByName(alone)


def _fitted(packed: DataFrame, n: int, depth: int, dimensions: int) -> Tree:
    """The top of the tree, fitted on a sample of at most ``SAMPLE`` vectors chosen by a hash of their bytes."""
    if not depth:
        return Tree(np.empty((0, dimensions), np.float32), np.empty(0, np.float32), np.empty((0, 2), np.int64), 1)
    share = min(1.0, 0.9 * SAMPLE / n)
    rows = packed.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(SAMPLE).collect()
    return fit(unpack([bytes(r["v"]) for r in rows], dimensions), depth) if len(rows) > 1 else _fitted(packed, n, 0, dimensions)


def _route(classes: DataFrame, key: str, tree: Tree, margin: float, dimensions: int, once: bool = False) -> DataFrame:
    """``(shard, key, v)``: each vector in every shard that it may find a partner in, or only ``once`` in its own."""
    schema = T.StructType([T.StructField("shard", T.IntegerType()), classes.schema[key], classes.schema["v"]])
    shared = classes.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            vectors = unpack(pdf["v"], dimensions)
            leaves = _own_leaves(shared.value, vectors) if once else shared.value.route(vectors, margin)
            rows = np.concatenate(leaves)
            numbers = np.repeat(np.arange(len(leaves), dtype=np.int32), [len(x) for x in leaves])
            yield pd.DataFrame({"shard": numbers, key: pdf[key].to_numpy()[rows], "v": pdf["v"].to_numpy()[rows]})

    return classes.mapInPandas(run, schema)


def _blocks(routed: DataFrame, key: str, block: int) -> DataFrame:
    """``(shard, pair, part, key, v)``: the tasks of each shard.

    Routing is done twice, for the sizes and for the rows, as it is cheaper than keeping
    its result. A shard of up to ``block`` rows is one task. A larger one is hashed into b blocks,
    and each pair of blocks (i <= j) is a task; a row goes to the b tasks of its block.
    """
    sizes = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    half = F.ceil(F.col("_n") / F.lit(block / 2))
    n_blocks = F.when(F.col("_n") <= block, F.lit(1)).otherwise(half).cast("int")
    rows = routed.join(F.broadcast(sizes.select("shard", n_blocks.alias("_b"))), "shard")  # one row per shard
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_b")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda o: F.least(o, F.col("_own")) * F.col("_b") + F.greatest(o, F.col("_own")))
    spread = rows.select("shard", F.explode(tasks).alias("pair"), "_own", "_b", key, "v")
    return spread.select("shard", "pair", F.when(F.col("_own") == F.expr("pair div _b"), 0).otherwise(1).alias("part"), key, "v")


def _checked(pairs: DataFrame, points: DataFrame, key: str, column: str, dimensions: int, min_cosine: float) -> DataFrame:
    """The pairs whose original vectors have the cosine, with it."""
    wanted = pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct()
    own = points.where(F.size(column) == dimensions).select(key, F.col(column).alias("_v")).join(wanted, key, "left_semi").groupBy(key).agg(F.min("_v").alias("_v"))
    own = cut_lineage(own)
    side = lambda c: own.select(F.col(key).alias(c), F.col("_v").alias(f"_{c}"))
    from tallgrass.operators.vectors import cosine

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", cosine(F.col("_a"), F.col("_b")).alias("cosine"))
    return both.where(F.col("cosine") >= min_cosine)


def _top_of_either(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs among the ``k`` best of one end; ties by the other end's key."""
    twice = pairs.select(F.col("a").alias("_own"), F.col("b").alias("_other"), "a", "b", "cosine").unionByName(
        pairs.select(F.col("b").alias("_own"), F.col("a").alias("_other"), "a", "b", "cosine")
    )
    w = Window.partitionBy("_own").orderBy(F.desc("cosine"), "_other")
    best = twice.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return best.select("a", "b", "cosine").distinct()


# -- nearest of a set of queries ------------------------------------------------
NEAREST_SHARD, QUERY_BLOCK, NEAREST_RELAX = 16384, 8192, 2.0


@dataclass
class Leaves:
    """A shard's tree with its vectors sorted by leaf, and for each leaf the bounds of its distances to the vantage points above it."""

    vectors: np.ndarray
    rows: list[np.ndarray]
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(vectors: np.ndarray, leaf: int = 512) -> Leaves:
    depth = max(0, math.ceil(math.log2(max(1, len(vectors)) / leaf)))
    rng = np.random.default_rng(5)
    sample = vectors if len(vectors) <= 4096 else vectors[rng.choice(len(vectors), 4096, replace=False)]
    tree = fit(sample, depth)
    rows = [r for r in _own_leaves(tree, vectors) if len(r)]
    if len(tree.radii):
        d = distances(vectors, tree.points)
        low = np.stack([d[r].min(axis=0) for r in rows])
        high = np.stack([d[r].max(axis=0) for r in rows])
    else:
        low = high = np.zeros((len(rows), 0), np.float32)
    return Leaves(vectors, rows, tree.points, low, high)


def _own_leaves(tree: Tree, vectors: np.ndarray) -> list[np.ndarray]:
    seen = np.zeros(len(vectors), bool)
    out = []
    for rows in tree.route(vectors, 0.0):
        own = rows[~seen[rows]]
        seen[own] = True
        out.append(own)
    return out


def search(index: Leaves, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, cosines)``, each queries x k, best first; -1 where there are fewer.

    A leaf can't be nearer than the largest gap between the query's distance to a
    vantage point and the leaf's range there. Leaves are visited in the order of that
    bound; a leaf is skipped if its bound times ``relax`` exceeds the distance of the
    k-th best so far, which for ``relax`` = 1 loses nothing.
    """
    n = len(queries)
    best = np.full((n, k), -2.0, np.float32)
    which = np.full((n, k), -1, np.int64)
    if index.points.shape[0]:
        d = distances(queries, index.points)
        bound = np.zeros((n, len(index.rows)), np.float32)
        for i in range(len(index.rows)):
            gap = np.maximum(index.low[i] - d, d - index.high[i])
            bound[:, i] = np.maximum(0.0, gap.max(axis=1))
    else:
        bound = np.zeros((n, len(index.rows)), np.float32)
    nearest_first = np.argsort(bound.mean(axis=0), kind="stable")
    first = np.argmin(bound, axis=1)
    done = np.zeros((n, len(index.rows)), bool)

    def visit(i: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        members = index.rows[i]
        c = queries[rows] @ index.vectors[members].T
        if c.shape[1] > k:
            top = np.argpartition(-c, k - 1, axis=1)[:, :k]
            c, ids = np.take_along_axis(c, top, axis=1), members[top]
        else:
            ids = np.broadcast_to(members, c.shape)
        all_c, all_i = np.concatenate([best[rows], c], axis=1), np.concatenate([which[rows], ids], axis=1)
        order = np.argsort(-all_c, axis=1, kind="stable")[:, :k]
        best[rows], which[rows] = np.take_along_axis(all_c, order, axis=1), np.take_along_axis(all_i, order, axis=1)
        done[rows, i] = True

    for i in range(len(index.rows)):
        visit(i, np.flatnonzero(first == i))
    for i in nearest_first:
        radius = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best[:, -1]))
        visit(i, np.flatnonzero(~done[:, i] & (bound[:, i] * relax <= radius)))
    return which, best


def nearest(
    points: DataFrame, queries: DataFrame, k: int = 10, key: str = "point_id", column: str = "dense", dimensions: int = 64, relax: float = NEAREST_RELAX, shard: int = NEAREST_SHARD, queries_per_task: int = QUERY_BLOCK
) -> DataFrame:
    """``(query, neighbour, cosine, rank)``: the ``k`` most similar points of each query, itself left out.

    ``queries`` is a subset of the points, given by key. Cosines are those of the
    vectors as bytes (they differ from the true ones by about 0.002). Queries whose
    vector is unusable have no rows; ties go to the smaller key.

    Every point is in one shard; shards that have grown over twice their size, as of
    copies, are cut by a hash. A query visits its own shard, and then the others whose
    boundary is nearer than its k-th best there, divided by ``relax`` (1 skips nothing
    that counts). The queries of a shard are dealt out in blocks of ``queries_per_task``,
    so a task holds a shard and a block, however many queries there are.
    """
    packed = cut_lineage(packed_vectors(points, dimensions, key, column))
    n = packed.count()
    tree = _fitted(packed, n, max(0, math.ceil(math.log2(max(1, n) / shard))), dimensions)
    data = cut_lineage(_route(packed, key, tree, 0.0, dimensions, once=True))
    sizes = {r["shard"]: r["n"] for r in data.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most SAMPLE shards
    spark = points.sparkSession
    cuts = spark.createDataFrame([(s, max(1, math.ceil(m / (2 * shard)))) for s, m in sizes.items()], "shard int, _cuts int")
    data = data.join(F.broadcast(cuts), "shard").withColumn("_part", F.pmod(F.xxhash64(F.lit(17), key), F.col("_cuts")).cast("int"))
    asked = packed.join(queries.select(key).distinct(), key, "left_semi")
    own = _route(asked, key, tree, 0.0, dimensions, once=True)
    home = cut_lineage(_visit(data, own, cuts, k, key, dimensions, relax, queries_per_task))
    # The k-th best of the home shard bounds what other shards may skip.
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    worst = home.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("cosine")).alias("_least"))
    bounded = asked.join(worst.withColumnRenamed("query", key), key, "left")
    away = _visit(data, _others(bounded, key, tree, relax, dimensions), cuts, k, key, dimensions, relax, queries_per_task)
    found = home.unionByName(away)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _others(bounded: DataFrame, key: str, tree: Tree, relax: float, dimensions: int) -> DataFrame:
    """``(shard, key, v)``: the shards other than its own that a query must visit, given the cosine of its k-th best so far."""
    schema = T.StructType([T.StructField("shard", T.IntegerType()), bounded.schema[key], bounded.schema["v"]])
    shared = bounded.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            least = pdf["_least"].fillna(-1.0).to_numpy(np.float32)
            margins = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * least)) / relax
            vectors = unpack(pdf["v"], dimensions)
            own = np.zeros(len(pdf), np.int64)
            for i, rows in enumerate(_own_leaves(shared.value, vectors)):
                own[rows] = i
            leaves = [rows[own[rows] != i] for i, (rows, _) in enumerate(shared.value.descend(vectors, margins))]
            rows = np.concatenate(leaves)
            numbers = np.repeat(np.arange(len(leaves), dtype=np.int32), [len(x) for x in leaves])
            yield pd.DataFrame({"shard": numbers, key: pdf[key].to_numpy()[rows], "v": pdf["v"].to_numpy()[rows]})

    return bounded.mapInPandas(run, schema)


def _visit(data: DataFrame, asking: DataFrame, cuts: DataFrame, k: int, key: str, dimensions: int, relax: float, per_task: int) -> DataFrame:
    """``(query, neighbour, cosine)`` of the queries in the shards that they visit, by blocks of queries."""
    asking = cut_lineage(asking)
    blocks = asking.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).cast("int").alias("_blocks"))  # a row per shard
    asked = asking.join(F.broadcast(blocks), "shard").join(F.broadcast(cuts), "shard")
    asked = asked.select("shard", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_part"), F.pmod(F.xxhash64(F.lit(3), key), F.col("_blocks")).cast("int").alias("_block"), F.col(key).alias("_key"), F.col("v").alias("_v"))
    stored = data.join(F.broadcast(blocks), "shard").select("shard", "_part", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), key, "v")
    kind = data.schema[key].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("neighbour", kind), T.StructField("cosine", T.DoubleType())])

    def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query": [], "neighbour": [], "cosine": []}).astype({"query": object, "neighbour": object, "cosine": float})
        if not len(own) or not len(asking):
            return nothing
        index, keys = build(unpack(own["v"], dimensions)), own[key].to_numpy()
        rows, cosines = search(index, unpack(asking["_v"], dimensions), k + 1, relax)
        ids = np.repeat(asking["_key"].to_numpy(), rows.shape[1])
        flat = rows.ravel()
        ok = flat >= 0
        frame = pd.DataFrame({"query": ids[ok], "neighbour": keys[flat[ok]], "cosine": cosines.ravel()[ok].astype(float)})
        return frame[frame["query"] != frame["neighbour"]]

    by = ("shard", "_part", "_block")
    return stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, schema)
