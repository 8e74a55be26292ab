"""Approximate nearest neighbours of large artifacts: random-projection trees, then rounds of neighbour descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import uniform
from .numbering import cut, small

#: Rows of an artifact that trees are fitted to, the depth that so many can bear, rows of a leaf, and rows that are compared at once.
SAMPLE_ROWS, MAX_DEPTH, LEAF_ROWS, GROUP_ROWS = 4096, 10, 96, 256


def _directions(trees: int, width: int, seed: int) -> np.ndarray:
    """A random direction for each tree and level, the same in every task."""
    return np.random.default_rng(seed).standard_normal((width, trees, MAX_DEPTH))


def _leaves(heights: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row in each tree: ``heights`` by row, tree and level; ``cuts`` by tree and node."""
    node = np.zeros(heights.shape[:2], np.int64)
    tree = np.arange(heights.shape[1])
    for level in range(depth):
        node = 2 * node + 1 + (heights[:, :, level] > cuts[tree[None, :], node])
    return node


def _nearest_within(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a group its ``k`` nearest others: source, neighbour, distance."""
    square = (vectors * vectors).sum(1)
    near = square[:, None] + square[None, :] - 2 * vectors @ vectors.T
    np.fill_diagonal(near, np.inf)
    n = min(k, len(ids) - 1)
    at = np.argpartition(near, n - 1, axis=1)[:, :n]
    gaps = np.sqrt(((vectors[:, None, :] - vectors[at]) ** 2).sum(2))
    return np.repeat(ids, n), ids[at].ravel(), gaps.ravel()


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each source, each neighbour once, ties by id."""
    once = found.groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def tree_leaves(vectors: DataFrame, trees: int, artifact: str = "artifact", row: str = "row", vector: str = "vector", seed: int = 0) -> DataFrame:
    """``artifact``, ``row``, ``vector``, ``tree``, ``leaf``: every row's leaf in each of some random-projection trees.

    A node halves its rows at the median height along a random direction. Medians come from at most about SAMPLE_ROWS rows of an artifact,
    drawn by hash; the trees of small artifacts have fewer levels, so that a leaf has about LEAF_ROWS rows.
    """
    sizes = vectors.groupBy(artifact).agg(F.count("*").alias("__n"))
    sized = vectors.select(artifact, row, vector).join(small(sizes), artifact)
    some = sized.where(uniform(seed, row) * F.col("__n") < SAMPLE_ROWS)
    kind = vectors.schema[artifact].dataType.simpleString()

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group[vector].to_numpy()).astype(float)
        heights = np.einsum("nw,wtl->ntl", x, _directions(trees, x.shape[1], seed))
        depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(group["__n"].iloc[0], 1) / LEAF_ROWS)))))
        cuts, nodes = np.zeros((trees, 2**MAX_DEPTH)), np.zeros(heights.shape[:2], np.int64)
        for level in range(depth):
            for t in range(trees):
                for node in np.unique(nodes[:, t]):
                    cuts[t, node] = np.median(heights[nodes[:, t] == node, t, level])
                nodes[:, t] = 2 * nodes[:, t] + 1 + (heights[:, t, level] > cuts[t, nodes[:, t]])
        return pd.DataFrame({artifact: [group[artifact].iloc[0]], "__depth": [depth], "__cuts": [cuts[:, : 2**depth].ravel().tolist()]})

    fitted = cut(some.groupBy(artifact).applyInPandas(fit, f"{artifact} {kind}, __depth int, __cuts array<double>"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(artifact, sort=False):
                x, depth = np.stack(part[vector].to_numpy()).astype(float), int(part["__depth"].iloc[0])
                heights = np.einsum("nw,wtl->ntl", x, _directions(trees, x.shape[1], seed))
                leaf = _leaves(heights, np.asarray(part["__cuts"].iloc[0]).reshape(trees, -1), depth)
                yield pd.DataFrame({artifact: key, row: part[row].to_numpy(), vector: part[vector].to_numpy(), "leaves": list(leaf)})

    schema = T.StructType([vectors.schema[artifact], vectors.schema[row], vectors.schema[vector], T.StructField("leaves", T.ArrayType(T.LongType()))])
    placed = vectors.select(artifact, row, vector).join(small(fitted, 1000), artifact).mapInPandas(place, schema)
    return placed.select(artifact, row, vector, F.posexplode("leaves").alias("tree", "leaf"))


def approximate_knn(vectors: DataFrame, k: int = 6, trees: int = 8, rounds: int = 2, artifact: str = "artifact", row: str = "row", vector: str = "vector", seed: int = 0) -> DataFrame:
    """``src``, ``dst``, ``distance``, ``rank``: about the ``k`` nearest other rows of each row in its artifact.

    First candidates are the nearest within leaves of random-projection trees. Then, in each round, the neighbours of a row, and
    some that have it as neighbour, are compared among each other; only pairs that are nearer than what an end has are kept. Shuffled
    vectors are ``trees`` a row at first and at most 3 k a round: linear in rows, where :func:`neighbors.exact_knn` is quadratic. A leaf beyond
    GROUP_ROWS rows (equal vectors, or more rows than MAX_DEPTH levels can part) is dealt to groups by hash; rounds join what that parts.
    Recall against the exact neighbours is measured in ``tests/test_approximate.py``; distances are exact. A row alone in its artifact has no
    neighbours. Ids must be unique over all artifacts; rows with null vectors are left out.
    """
    at = cut(vectors.where(F.col(vector).isNotNull()).select(artifact, row, vector))
    kind = vectors.schema[row].dataType.simpleString()
    found_in = f"src {kind}, dst {kind}, distance double"
    leaves = cut(tree_leaves(at, trees, artifact, row, vector, seed))
    keys = [artifact, "tree", "leaf"]
    counts = leaves.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP_ROWS).alias("__groups"))
    dealt = leaves.join(small(counts), keys).withColumn("__group", F.pmod(F.xxhash64(row, "tree"), F.col("__groups")))
    groups = dealt.groupBy(*keys, "__group").agg(F.collect_list(F.struct(F.col(row).alias("id"), F.col(vector).alias("v"))).alias("items"))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vs in zip(batch["ids"], batch["vs"], strict=True):
                if len(ids) > 1:
                    yield pd.DataFrame(dict(zip(("src", "dst", "distance"), _nearest_within(np.asarray(ids), np.stack(vs).astype(float), k), strict=True)))

    edges = cut(_best(groups.select(F.col("items.id").alias("ids"), F.col("items.v").alias("vs")).mapInPandas(within, found_in), k))
    for step in range(rounds):
        last = edges.groupBy("src").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        known = at.select(F.col(row).alias("id"), F.col(vector).alias("v")).join(last.select(F.col("src").alias("id"), F.when(F.col("n") >= k, F.col("far")).alias("far")), "id", "left")
        # Of the rows that have one as neighbour (any number, for a hub), 2 k drawn by hash.
        order = Window.partitionBy("mid").orderBy(F.xxhash64("id", F.lit(step)), "id")
        back = edges.select(F.col("dst").alias("mid"), F.col("src").alias("id")).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= 2 * k).select("mid", "id")
        meet = edges.select(F.col("src").alias("mid"), F.col("dst").alias("id")).union(back).distinct()
        packed = meet.join(known, "id").groupBy("mid").agg(F.collect_list(F.struct("id", "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))).alias("items"))

        def nearer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for ids, vs, far in zip(batch["ids"], batch["vs"], batch["fars"], strict=True):
                    if len(ids) > 1:
                        src, dst, d = _nearest_within(np.asarray(ids), np.stack(vs).astype(float), k)
                        good = d < np.repeat(np.asarray(far, float), len(src) // len(ids))
                        if good.any():
                            yield pd.DataFrame({"src": src[good], "dst": dst[good], "distance": d[good]})

        more = packed.select(F.col("items.id").alias("ids"), F.col("items.v").alias("vs"), F.col("items.far").alias("fars")).mapInPandas(nearer, found_in)
        edges = cut(_best(edges.select("src", "dst", "distance").union(more), k))
    return edges
