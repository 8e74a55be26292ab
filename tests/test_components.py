"""Components of each artifact against NumPy's singular values, and clusters compared within types."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import cluster
from cellspark.operators.components import artifact_components


def by_svd(dense, k):
    centred = dense - dense.mean(0)
    _, size, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:k] * np.sign(axes[:k][np.arange(len(axes[:k])), np.abs(axes[:k]).argmax(1)])[:, None]
    axes[size[:k] < 1e-9 * size[0]] = 0
    out = np.zeros((len(dense), k))
    out[:, : len(axes)] = centred @ axes.T
    return out


def made(rng, n, genes, factors=6):
    """Sparse counts with a few strong directions."""
    rate = np.exp(rng.normal(size=(n, factors)) @ rng.normal(size=(factors, genes)) * 0.6 - 1.0)
    return rng.poisson(rate).astype(float)


def coo_of(spark, dense, first, genes):
    i, j = np.nonzero(dense)
    return [(int(a) + first, int(genes[b]), float(dense[a, b])) for a, b in zip(i, j, strict=True)]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    tables = {"a": made(rng, 300, 150), "b": made(rng, 90, 150), "c": made(rng, 40, 150)[:, :] * 0 + 3.0}
    tables["a"][7] = 0
    rows, cells, first, starts = [], [], 0, {}
    for name, dense in tables.items():
        starts[name] = first
        rows += coo_of(spark, dense, first, np.arange(150) + 1000)
        cells += [(first + i, name) for i in range(len(dense))]
        first += len(dense)
    coo = spark.createDataFrame(rows, "cell long, gene long, value double").repartition(7)
    return tables, starts, coo, spark.createDataFrame(cells, "cell long, artifact string")


@pytest.mark.parametrize("wave_bytes", [1 << 28, 1])
def test_components_equal_svd(spark, world, wave_bytes):
    tables, starts, coo, cells = world
    genes = coo.select("gene").distinct()
    got = {r.cell: r.pca for r in artifact_components(coo, cells, genes, 4, oversample=4, wave_bytes=wave_bytes).collect()}
    assert len(got) == cells.count()
    for name, dense in tables.items():
        own = np.array([got[starts[name] + i] for i in range(len(dense))])
        want = by_svd(dense, 4)
        assert np.allclose(own, want, atol=1e-4 * max(1.0, np.abs(want).max())), name


def test_genes_of_artifacts_differ(spark, world):
    tables, starts, coo, cells = world
    picked = {"a": [1000, 1003, 1010], "b": list(range(1020, 1080))}
    genes = spark.createDataFrame([(a, g) for a, gs in picked.items() for g in gs], "artifact string, gene long")
    got = {r.cell: r.pca for r in artifact_components(coo, cells, genes.union(genes), 5).collect()}
    for name, gs in picked.items():
        dense = tables[name][:, np.array(gs) - 1000]
        own = np.array([got[starts[name] + i] for i in range(len(dense))])
        assert np.allclose(own, by_svd(dense, 5), atol=1e-4 * np.abs(own).max())
    assert {tuple(got[starts["c"] + i]) for i in range(40)} == {(0.0,) * 5}


def test_odd_rows_of_components(spark, world):
    _, _, coo, cells = world
    odd = coo.union(spark.createDataFrame([(0, 1000, None), (-1, 1000, 2.0)], coo.schema)).withColumn("artifact", F.lit("x")).drop("artifact")
    more = cells.union(spark.createDataFrame([(5000, None)], cells.schema)).withColumn("who", F.lit(3))
    genes = coo.select("gene").distinct()
    same = lambda df: {r.cell: np.round(r.pca, 5).tolist() for r in df.collect()}
    assert same(artifact_components(odd, more, genes, 2)) == same(artifact_components(coo, cells, genes, 2))
    assert artifact_components(coo, cells.limit(0), genes, 2).count() == 0
    assert {tuple(r.pca) for r in artifact_components(coo.limit(0), cells, genes.limit(0), 2).collect()} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        artifact_components(coo, cells, spark.range(10_001).withColumnRenamed("id", "gene"), 2)


def test_variable_genes_of_each_artifact(spark, world):
    _, _, coo, cells = world
    both = {(r.artifact, r.gene): r["rank"] for r in cluster.variable_genes(coo, cells, 20, by="artifact").collect()}
    for name in ("a", "b"):
        own = cells.where(F.col("artifact") == name)
        alone = cluster.variable_genes(coo.join(own.select("cell"), "cell", "left_semi"), own, 20)
        assert {g: n for (a, g), n in both.items() if a == name} == {r.gene: r["rank"] for r in alone.collect()}
    assert not [g for a, g in both if a == "c"]


def test_correlations_within_types(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{t}{i}", g, float(rng.random())) for t in "xy" for i in range(4) for g in range(9) if rng.random() < 0.7]
    means = spark.createDataFrame(rows, "cluster string, gene int, mean double")
    types = means.select("cluster", F.substring("cluster", 1, 1).alias("type")).distinct()
    every = {(r.a, r.b): r.corr for r in cluster.cluster_correlations(means, 9).collect()}
    typed = {(r.a, r.b): r.corr for r in cluster.cluster_correlations(means, 9, types).collect()}
    assert set(typed) == {(a, b) for a, b in every if a[0] == b[0]}
    assert all(abs(typed[k] - every[k]) < 1e-12 for k in typed)
