"""Approximate neighbours held against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark import queries
from cellspark.operators import approximate, neighbors


def table(spark, groups):
    """A row for each vector of each artifact."""
    rows, at = [], 0
    for name, x in groups.items():
        rows += [(name, at + i, v.tolist()) for i, v in enumerate(x)]
        at += len(x)
    return spark.createDataFrame(rows, "artifact string, row long, vector array<double>")


def recall(exact, found):
    """Share of exact neighbours that are found; a neighbour as near as the last exact one counts too."""
    last = exact.groupBy("src").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    got = found.join(last, "src").where(F.col("distance") <= F.col("far") * (1 + 1e-9) + 1e-12).groupBy("src").agg(F.count("*").alias("hit"))
    r = last.join(got, "src", "left").agg((F.sum(F.least(F.coalesce("hit", F.lit(0)), "n")) / F.sum("n")).alias("r")).first().r
    return r


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    big = np.concatenate([rng.normal(c * 2, 1, (300, 20)) for c in rng.standard_normal((8, 20))])
    return table(spark, {"big": big, "flat": rng.standard_normal((700, 12)), "few": rng.standard_normal((5, 12)), "one": rng.standard_normal((1, 12))})


def test_recall(spark, clustered):
    exact, found = neighbors.exact_knn(clustered, 10).cache(), approximate.approximate_knn(clustered, 10)
    assert recall(exact, found) >= 0.95
    rows = found.collect()
    of = {r.row: r for r in clustered.collect()}
    assert all(of[r.src].artifact == of[r.dst].artifact and r.src != r.dst for r in rows)
    assert all(abs(np.linalg.norm(np.subtract(of[r.src].vector, of[r.dst].vector)) - r.distance) < 1e-9 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.src, []).append(r)
    assert all(sorted(x.rank for x in rs) == list(range(1, len(rs) + 1)) and len({x.dst for x in rs}) == len(rs) for rs in by.values())
    assert {len(by[k]) for k, r in of.items() if r.artifact == "few"} == {4} and not any(of[k].artifact == "one" for k in by)


def test_rounds_raise_recall(spark, clustered):
    exact = neighbors.exact_knn(clustered, 10).cache()
    one, two = (recall(exact, approximate.approximate_knn(clustered, 10, trees=2, rounds=n)) for n in (0, 2))
    assert one < two and two >= 0.9


def test_equal_vectors_and_groups(spark, monkeypatch):
    """Leaves beyond the limit of a group are parted, and joined again by rounds."""
    monkeypatch.setattr(approximate, "GROUP_ROWS", 64)
    rng = np.random.default_rng(2)
    at = table(spark, {"a": np.concatenate([np.ones((300, 4)), rng.standard_normal((300, 4))])})
    assert recall(neighbors.exact_knn(at, 5).cache(), approximate.approximate_knn(at, 5, rounds=3)) >= 0.9
    assert approximate.approximate_knn(at.limit(0), 5).collect() == []
    assert approximate.approximate_knn(at.limit(40).withColumn("vector", F.when(F.col("row") > 3, F.col("vector"))), 3).select("src").distinct().count() == 36


def test_query_recall(spark):
    d = "/root/testdata/sf0.001"
    found = queries.QUERIES["knn6_approximate"](spark, d)
    assert recall(queries.QUERIES["knn6"](spark, d).cache(), found) >= 0.9


def test_shuffled_vectors_are_linear(spark):
    """Rows that trees give on are trees times the rows at every size."""
    for n in (400, 1600):
        at = table(spark, {"a": np.random.default_rng(3).standard_normal((n, 6))})
        leaves = approximate.tree_leaves(at, 4)
        assert leaves.count() == 4 * n
        assert leaves.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0] <= 2 * approximate.LEAF_ROWS
