"""Communities of a graph by modularity: local moves, refinement and aggregation, level by level, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .numbering import Stored

#: A gain must be at least this share of all weight for a node to move.
LEAST_GAIN = 1e-9


def undirected(edges: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``w`` in both directions from edges (src, dst, and w or 1): weights of one pair are added, loops left out."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    at = edges.where("src <> dst").select("src", "dst", w.alias("w"))
    return at.unionByName(at.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels`` (node, label) over a graph as :func:`undirected` gives it, which may have loops."""
    to, of = labels.toDF("dst", "b"), labels.toDF("src", "a")
    at = graph.join(of, "src").join(to, "dst")
    by = at.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    x = by.agg(F.sum("inside").alias("i"), F.sum("k").alias("t"), F.sum(F.col("k") ** 2).alias("q")).first()
    return 0.0 if not x.t else x.i / x.t - resolution * x.q / x.t**2


def _moved(graph: DataFrame, nodes: DataFrame, labels: DataFrame, total: float, resolution: float, step: int, singles: bool, store: Stored) -> tuple[DataFrame, int]:
    """Labels after one set of moves, and how many nodes wanted to move.

    A node wants to go where it gains most modularity. A community gives or takes by a draw of the step, and only moves out of one that gives
    into one that takes are made, so no node goes to where others are leaving. Where more degree would come into a community than it
    has, so much of it as it has comes, by a draw of the node: gains are then not far from what they were reckoned as. With
    ``singles`` only nodes alone in their community move.
    """
    own = labels.join(nodes, "node")
    held = own.groupBy("label").agg(F.sum("k").alias("held"), F.count("*").alias("size"))
    votes = graph.where("src <> dst").join(labels.toDF("dst", "label"), "dst").select(F.col("src").alias("node"), "label", "w")
    # Staying is a choice too where a node has no edge into its own community.
    votes = votes.unionByName(labels.select("node", "label", F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
    at = votes.join(held, "label").join(own.select("node", "k", F.col("label").alias("mine")), "node")
    here = F.col("label") == F.col("mine")
    gain = F.col("w") - F.lit(resolution / total) * F.col("k") * (F.col("held") - F.when(here, F.col("k")).otherwise(0.0))
    order = F.struct(F.round("gain", 9), F.xxhash64("label", F.lit(step)))
    best = at.withColumn("gain", gain).groupBy("node").agg(
        F.max_by("label", order).alias("to"),
        F.max_by("held", order).alias("room"),
        F.max("k").alias("k"),
        F.max("gain").alias("top"),
        F.max(F.when(here, F.col("gain"))).alias("now"),
        F.max("mine").alias("label"),
        F.max(F.when(here, F.col("size"))).alias("size"),
    )
    wants = (F.col("top") - F.col("now") > LEAST_GAIN * total) & (F.col("to") != F.col("label")) & ((F.col("size") == 1) if singles else F.lit(True))
    gives = lambda c: F.pmod(F.xxhash64(c, F.lit(step + 7)), F.lit(2)) == 0
    chosen = store(best.withColumn("wants", wants).withColumn("goes", F.col("wants") & gives("label") & ~gives("to")).select("node", "label", "to", "room", "k", "wants", "goes"))
    coming = chosen.where("goes").groupBy("to").agg(F.sum("k").alias("coming"))
    comes = F.col("goes") & (uniform(step, "node") * F.col("coming") < F.col("room"))
    out = store(chosen.join(coming, "to", "left").select("node", F.when(comes, F.col("to")).otherwise(F.col("label")).alias("label")))
    n = chosen.where("wants").count()
    store.drop(chosen)
    return out, n


def local_moves(graph: DataFrame, nodes: DataFrame, labels: DataFrame, total: float, resolution: float, rounds: int, store: Stored) -> DataFrame:
    """The labels of most modularity among those that sets of moves lead to, until no node wants to move or ``rounds`` are over."""
    best, top = labels, modularity(graph, labels, resolution)
    for step in range(rounds):
        labels, n = _moved(graph, nodes, labels, total, resolution, step, False, store)
        if not n:
            break
        if (q := modularity(graph, labels, resolution)) > top:
            best, top = labels, q
    return best


def _refined(inner: DataFrame, nodes: DataFrame, total: float, resolution: float, rounds: int, store: Stored) -> DataFrame:
    """Groups within communities, whose edges are ``inner``: single nodes join one, a set at a time, until none gains."""
    labels = nodes.select("node", F.col("node").alias("label"))
    for step in range(rounds):
        labels, n = _moved(inner, nodes, labels, total, resolution, 1000 + step, True, store)
        if not n:
            break
    return labels


def leiden(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 8) -> DataFrame:
    """``src`` and ``label``: communities of an undirected graph (src, dst, and w or 1) at a ``resolution``.

    On each level nodes move to the community of a neighbour where modularity gains most, set by set. Each community is then refined: its
    nodes start alone and, while alone, join a neighbour's group within the community, so every group hangs together. Groups become the
    nodes of the next level's graph, where communities begin as they were found. This ends when groups are no fewer than nodes.
    Weights of repeated edges are added, loops left out; a node without an edge to another is in no row. Draws hash node or community and
    step, so results are the same in every run. A round is a few shuffles of the level's edges, which grow fewer with each level.
    """
    store = Stored(edges)
    graph = store(undirected(edges))
    nodes = store(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    total = nodes.agg(F.sum("k")).first()[0] or 0.0
    if not total:
        return graph.select("src", F.col("src").alias("label"))
    labels = nodes.select("node", F.col("node").alias("label"))
    of = nodes.select(F.col("node").alias("src"), "node")  # the level's node that each row is in
    for _ in range(levels):
        labels = local_moves(graph, nodes, labels, total, resolution, rounds, store)
        done = of.join(labels, "node").select("src", "label")
        inner = store(graph.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "w"))
        # Gains are as in the whole graph: degrees are those of all edges.
        refined = _refined(inner, nodes, total, resolution, rounds, store).withColumnRenamed("label", "to")
        groups, n = refined.select("to").distinct().count(), nodes.count()
        if groups == n:
            break
        merged = graph.join(refined.toDF("src", "a"), "src").join(refined.toDF("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        of = store(of.join(refined, "node").select("src", F.col("to").alias("node")))
        labels = store(labels.join(refined, "node").groupBy(F.col("to").alias("node")).agg(F.min("label").alias("label")))
        last, graph = graph, store(merged)
        store.drop(last, inner)
        nodes = store(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    return done
