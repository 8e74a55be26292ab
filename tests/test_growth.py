"""Steps whose cost grew faster than their input: wide rows, positions, numbering, stores, neighbours in batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellspark.functions import scalars
from cellspark.operators import cluster, neighbors, numbering, sampling, select
from cellspark.plans.collate import CollateOptions, collate, dense_rows
from cellspark.plans.datamodule import CellDataset, DataModule, LoaderOptions
from cellspark.sources import store
from cellspark.sources.catalog import with_global_index


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, i % 3, "o", "xyz"[i % 3], [(g, float((i * g) % 4)) for g in range(0, 9, 1 + i % 3) if (i * g) % 4]) for i in range(60)]
    return spark.createDataFrame(rows, "cell long, artifact int, organism string, kind string, expr array<struct<gene:int,value:double>>")


def genes(spark, positions):
    return spark.createDataFrame([(g, "o", p) for g, p in enumerate(positions)], "gene int, organism string, pos int")


@pytest.mark.parametrize("positions", [list(range(5, 15)), [3 * g for g in range(10)], [0, 0, *range(2, 10)]])
@pytest.mark.parametrize("how", ["all", "some"])
def test_sparse_rows_hold_what_wide_ones_do(spark, cells, positions, how):
    known = genes(spark, positions)
    options = dict(how=how, genelist=[1, 4, 6], logp1=True, norm_to=100.0, n_bins=4)
    wide = {r.cell: r for r in collate(cells, known, CollateOptions(**options)).collect()}
    sparse = collate(cells, known, CollateOptions(**options, sparse=True)).orderBy("cell").toPandas()
    made = dense_rows(sparse)
    assert len(sparse) == len(wide) == 60 and made.any()
    for row, at in zip(sparse.itertuples(), made, strict=True):
        assert at.tolist() == wide[row.cell].x and row.width == len(wide[row.cell].x)
        assert list(row.genes) == [wide[row.cell].genes[i] for i in row.places] and 0 not in list(row.x)


def test_dense_rows_of_two_widths_raise():
    with pytest.raises(ValueError):
        dense_rows(pd.DataFrame({"width": [2, 3], "places": [[0], [1]], "x": [[1.0], [1.0]]}))


def test_sparse_is_for_whole_rows_alone(spark, cells):
    with pytest.raises(ValueError):
        collate(cells, genes(spark, range(10)), CollateOptions(how="most expr", sparse=True))


@pytest.mark.parametrize("how", ["most expr", "random expr"])
def test_rows_left_unfilled_hold_what_is_expressed(spark, cells, how):
    filled = {r.cell: r for r in collate(cells, genes(spark, range(5, 15)), CollateOptions(how=how, max_len=3)).collect()}
    for r in collate(cells, genes(spark, range(5, 15)), CollateOptions(how=how, max_len=3, fill=False)).collect():
        n = sum(v > 0 for v in filled[r.cell].x)
        assert r.genes == filled[r.cell].genes[:n] and r.x == filled[r.cell].x[:n]
    with pytest.raises(ValueError):
        collate(cells, genes(spark, range(10)), CollateOptions(how=how, max_len=3, fill=False, add_zero_genes=1))


@pytest.mark.parametrize("how", ["most expr", "random expr", "all"])
def test_no_cell_carries_the_positions_of_a_run(spark, cells, how):
    """An array of an organism's positions was copied to each cell: cells times genes."""
    assert "positions" not in plan(collate(cells, genes(spark, range(5, 15)), CollateOptions(how=how, max_len=3)))
    assert "positions" in plan(collate(cells, genes(spark, [*range(9), 50]), CollateOptions(how=how, max_len=3)))


def test_whole_rows_are_shuffled_once_to_be_numbered(cells):
    at = with_global_index(cells)
    text = physical(at)
    # One exchange of cells, which are read once; the other is of counts by stretch.
    assert text.count("Scan ExistingRDD") == 1 and text.count("Exchange hashpartitioning") == 2 and "expr" in at.columns
    want = sorted((r.artifact, r.cell) for r in cells.collect())
    assert [(r.artifact, r.cell) for r in at.orderBy("global_idx").collect()] == want


def test_splits_are_made_without_values(spark, cells):
    module = DataModule(CellDataset(cells, genes(spark, range(10)), predict=["kind"]), ["kind"], LoaderOptions(n_samples=50), CollateOptions(how="most expr", max_len=2))
    module.setup()
    assert "Exchange" not in physical(module.splits) and "expr" not in plan(module.dataset.obs)
    nnz = {r.cell: len([x for x in r.expr if x.value]) for r in cells.collect()}
    assert {r.cell: r["__nnz"] for r in module.dataset.obs.collect()} == nnz
    assert module.draws(0).count() == 50


def test_buckets_grow_with_the_table(spark, cells, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 10)
    at = store.write_store(cells.withColumn("global_idx", F.col("cell")), buckets=4)
    assert at.select(F.input_file_name().alias("f")).distinct().count() == 6 and at.count() == 60


@pytest.mark.parametrize("kind", ["int", "string"])
def test_equal_vectors_are_told_apart_by_id(spark, kind, monkeypatch):
    """Of more copies than candidates were kept, any came before; now those of the least ids do."""
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    rows = [(0, f"{i:03d}" if kind == "string" else i, [float(i // 80), 1.0]) for i in range(160)]
    got = neighbors.exact_knn(spark.createDataFrame(rows, f"artifact int, row {kind}, vector array<double>"), 4).collect()
    ids = [r[1] for r in rows]
    for i in range(160):
        same = [ids[j] for j in range(i // 80 * 80, i // 80 * 80 + 80) if j != i][:4]
        assert [r.dst for r in sorted((r for r in got if r.src == ids[i]), key=lambda r: r["rank"])] == same


def test_a_task_of_neighbours_holds_one_pair_of_blocks(spark):
    """Pairs of blocks came to Python in batches of 10,000 rows, each of two whole blocks."""
    at = spark.createDataFrame([(0, 1, [1.0]), (0, 2, [3.0])], "artifact int, row int, vector array<double>")
    text = plan(neighbors.exact_knn(at, 2))
    assert "FlatMapGroupsInArrow" in text and "MapInPandas" not in text
    assert [(r.src, r.dst, r.distance) for r in neighbors.exact_knn(at, 2).orderBy("src").collect()] == [(1, 2, 2.0), (2, 1, 2.0)]


def test_values_are_shuffled_once_to_make_cells(spark):
    """They were shuffled by cell and gene, then by cell, and again to be normalised by a join."""
    coo = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (2, 5, 0.0), (1, 0, 1.0)], "cell int, gene int, value double")
    made = select.to_cells(coo)
    assert physical(made).count("Exchange") == 1
    assert [(r.cell, [tuple(x) for x in r.expr]) for r in made.collect()] == [(1, [(0, 1.0), (1, 5.0)])]
    assert physical(cluster.normalise(select.summed(coo))).count("Exchange hashpartitioning(cell") <= 2
    assert "Exchange hashpartitioning(cell, gene" not in physical(cluster.normalise(select.summed(coo)))


def test_tasks_that_gather_do_not_grow(spark, monkeypatch):
    """Partitions were a fixed number, or joined by their packed size; now they follow the number of rows."""
    monkeypatch.setattr(numbering, "GATHER_ROWS", 100)
    rows = spark.range(4000).withColumn("cell", F.col("id") % 500)
    sizes = numbering.gathered(rows, "cell", rows=4000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) <= 400
    assert numbering.gathered(rows, "cell", rows=1600).rdd.getNumPartitions() <= 4


def test_a_vocabulary_is_counted_once(spark, cells):
    """Its positions, numbered by one task, were numbered again for each of six reads."""
    known = genes(spark, range(10)).withColumn("pos", F.row_number().over(Window.orderBy("gene")) - 1)
    assert "Window" not in plan(collate(cells, known, CollateOptions(how="most expr", max_len=3)))


@pytest.mark.parametrize("width", [4, 9, 500])
def test_few_draws_give_the_zeros_of_many(spark, width):
    at = spark.range(300).select(F.col("id").alias("cell"), F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda g: g.cast("int")).alias("taken"), (F.col("id") % 5).cast("int").alias("need"))
    got = select.with_zero_genes(at, F.col("need"), F.lit(width), seed=3)
    draw = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.floor(scalars.uniform(3, F.col("cell"), i) * width).cast("int")))
    for r in got.withColumn("all", F.array_except(draw, "taken")).collect():
        free = width - len(r.taken)
        assert len(r.zeros) == min(r.need, free) and not set(r.zeros) & set(r.taken)
        if len(r["all"]) >= r.need:
            assert r.zeros == r["all"][: r.need]


@pytest.mark.parametrize("validation", [0, 1, 137, 0.3, 1.0, 10_000])
def test_a_split_shuffles_no_rows(spark, validation):
    """All rows were shuffled with their hashes, to find which come first; now the place where these end is looked for."""
    at = spark.range(500).select(F.col("id").alias("global_idx"), (F.col("id") % 7).alias("artifact")).repartition(3)
    got = sampling.split(at, validation, 0.3, seed=5)
    assert "shuffled" not in plan(got) and "Union" not in plan(got)
    held = {r.global_idx for r in got.where("split = 'test'").collect()}
    assert 0 < len(held) <= 150 and len({i % 7 for i in held}) * 71 <= len(held)
    ranked = sampling.shuffled_index(at.where(~F.col("global_idx").isin(*held)), "global_idx", 5)
    n = validation if isinstance(validation, int) else int(500 * validation)
    want = {r.global_idx: "validation" if r.shuffled < n else "train" for r in ranked.collect()} | dict.fromkeys(held, "test")
    assert {r.global_idx: r.split for r in got.collect()} == want


def test_numbering_follows_the_number_of_cells(spark, cells, monkeypatch):
    monkeypatch.setattr(numbering, "GATHER_ROWS", 2)
    at = with_global_index(cells)
    assert "30), REPARTITION_BY_NUM" in physical(at)
    assert [(r.artifact, r.cell) for r in at.orderBy("global_idx").collect()] == sorted((r.artifact, r.cell) for r in cells.collect())


def spread(spark, rng):
    """Moments of genes: a batch with many equal means, one of few means, one of single ones, and a small one."""
    means = {"equal": rng.lognormal(size=150).repeat(9), "few": np.array([1.0, 2.0, 4.0]).repeat([500, 260, 40]), "single": rng.lognormal(size=1003), "small": rng.lognormal(size=80)}
    at = pd.concat([pd.DataFrame({"artifact": a, "gene": rng.permutation(len(m)), "n": 50, "mean": m, "variance": m ** 1.4 * rng.lognormal(sigma=0.5, size=len(m))}) for a, m in means.items()])
    return at, spark.createDataFrame(at).repartition(5)


@pytest.mark.parametrize("rows", [200, 1002])
def test_a_fit_dealt_over_tasks_is_that_of_one(spark, monkeypatch, rows):
    """One task held all genes of a batch; a large batch's rows are summed by many now, to the same curve."""
    at, moments = spread(spark, np.random.default_rng(8))
    monkeypatch.setattr(cluster, "FIT_ROWS", rows)
    fitted, few = cluster._expected(moments, ["artifact"], 0.3, numbering.Stored(moments))
    assert few and fitted.columns == ["artifact", "gene", "n", "mean", "sd"]
    got = fitted.toPandas().set_index(["artifact", "gene"])["sd"]
    assert len(got) == len(at) and got.index.is_unique
    for name, part in at.sort_values("gene").groupby("artifact"):
        want = 10 ** (cluster._local_fit(np.log10(part["mean"].to_numpy()), np.log10(part["variance"].to_numpy()), 0.3) / 2)
        assert np.allclose(got[name].loc[part["gene"]], want, rtol=1e-8, atol=0), name


def test_no_task_holds_the_genes_of_a_large_batch(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(c, g, float(rng.integers(1, 9))) for c in range(60) for g in rng.choice(900, 60, replace=False).tolist()]
    coo, cells = spark.createDataFrame(rows, "cell int, gene int, value double"), spark.range(60).selectExpr("CAST(id AS INT) AS cell", "CAST(id % 2 AS INT) AS artifact")
    wanted = [cluster.variable_genes(coo, cells, 40, by=by).orderBy("rank").collect() for by in ("artifact", None)]
    held = []
    monkeypatch.setattr(cluster, "FIT_ROWS", 500)
    monkeypatch.setattr(cluster, "_curves", lambda ranked, sizes, span, of=cluster._curves: held.append(sizes) or of(ranked, sizes, span))
    for by, want in zip(("artifact", None), wanted, strict=True):
        got = cluster.variable_genes(coo, cells, 40, by=by).collect()
        assert len(got) == len(want) and sorted((r["rank"], r.gene, r[0]) for r in got) == sorted((r["rank"], r.gene, r[0]) for r in want)
    assert [len(h) for h in held] == [2, 1] and min(min(h.values()) for h in held) > 500


def test_many_values_meet_their_fit_in_parts_that_follow_their_number(spark, monkeypatch):
    rows = [(c, g, 1.0 + (c * g) % 7) for c in range(60) for g in range(c % 5, 90, 5)]
    coo, cells = spark.createDataFrame(rows, "cell int, gene int, value double"), spark.range(60).selectExpr("CAST(id AS INT) AS cell", "CAST(id % 2 AS INT) AS artifact")
    want = cluster.variable_genes(coo, cells, 20, by="artifact").collect()
    asked = []
    monkeypatch.setattr(cluster, "SMALL_ROWS", 10)
    monkeypatch.setattr(numbering, "GATHER_ROWS", 50)
    monkeypatch.setattr(cluster, "gathered", lambda df, *keys, rows, of=numbering.gathered: asked.append((keys, rows)) or of(df, *keys, rows=rows))
    assert sorted(cluster.variable_genes(coo, cells, 20, by="artifact").collect()) == sorted(want)
    assert asked == [(("artifact", "gene"), len(rows))] * 2
