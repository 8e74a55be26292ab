"""Operators that count in two levels, look up within rows or cut work by blocks: equal to plain versions, and by plan."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import cluster, genes, labels, neighbors, numbering, qc, sampling
from cellspark.plans import collate as collating
from cellspark.plans.collate import CollateOptions, collate, iter_batches, keep_genes
from cellspark.plans.datamodule import CellDataset, DataModule, LoaderOptions
from cellspark.plans.defaults import after_with, clean_before, cluster_names
from cellspark.plans.preprocess import PreprocessOptions, Preprocessor, preprocess_collection
from cellspark.sources import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_numbering_within_a_hot_key(spark):
    at = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("k"))
    got = numbering.numbered(at, ["k"], numbering.ranges(at, "id", rows=100), ["id"]).collect()
    for key in ("hot", "cold"):
        own = sorted((r.id, r.pos) for r in got if r.k == key)
        assert [p for _, p in own] == list(range(len(own)))
    words = at.select(F.concat(F.lit("w"), "id").alias("w"))
    assert sorted(r.pos for r in numbering.numbered(words, [], numbering.ranges(words, "w", rows=100), ["w"]).collect()) == list(range(5000))
    assert numbering.numbered(at.limit(0), ["k"], numbering.ranges(at.limit(0), "id"), ["id"]).count() == 0


def test_running_sums(spark):
    at = spark.range(300).selectExpr("id", "id % 3 AS k", "CAST(id % 5 AS DOUBLE) AS w")
    got = numbering.running_sums(at, ["k"], "w", numbering.ranges(at, "id", rows=20), ["id"]).collect()
    for key in range(3):
        total = 0.0
        for r in sorted((r for r in got if r.k == key), key=lambda r: r.id):
            assert (r.lo, r.hi) == (total, total + r.w)
            total = r.hi
        assert {r.total for r in got if r.k == key} == {total}


@pytest.mark.parametrize("values", [[1.0], [1, 2], [5.0] * 9, list(range(1000)), [0.0] * 50 + [1e9] + [3.5, 3.25], [-1.5, None, 2.5, 7], [1e-9 * i for i in range(501)] + [1e6]])
def test_exact_medians(spark, values):
    at = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    for bins in (2, 4096):
        got = qc.exact_medians(at, {"m": F.col("v"), "twice": 2 * F.col("v"), "none": F.lit(None).cast("double")}, bins)
        right = statistics.median(v for v in values if v is not None)
        assert got["m"] == right and got["twice"] == 2 * right and got["none"] is None


def test_draws_join_by_buckets(spark):
    weights = spark.createDataFrame([(f"c{i}", 1.0 if i else 1e6) for i in range(200)], "label string, weight double")
    drawn = sampling.draw_labels(weights, 5000, 3)
    assert "NestedLoop" not in plan(drawn)
    rows = drawn.collect()
    assert sorted(r.draw_id for r in rows) == list(range(5000)) and sum(r.label == "c0" for r in rows) > 4900
    at = spark.range(1000).selectExpr("id AS cell", "IF(id < 990, 'hot', 'cold') AS label", "CAST(id % 3 AS DOUBLE) AS w")
    picked = sampling.draw_weighted(drawn.select("draw_id", F.lit("hot").alias("label")), at, "cell", "w")
    assert picked.count() == 5000 and picked.where("cell % 3 = 0").count() == 0
    counts = {i: n for i, n in ((r.m, r.n) for r in picked.groupBy((F.col("cell") % 3).alias("m")).agg(F.count("*").alias("n")).collect())}
    assert 1.8 < counts[2] / counts[1] < 2.2


def test_draws_without_replacement_rank_by_keys(spark):
    at = spark.range(2000).selectExpr("id AS cell", "'a' AS label", "CAST(id % 4 AS DOUBLE) AS w")
    held, numbering.PART_ROWS = sampling.PART_ROWS, 100
    sampling.PART_ROWS = 100
    try:
        got = sampling.draw_without_replacement(at, spark.createDataFrame([("a", 700)], "label string, n int"), "cell", weight="w", seed=2).collect()
    finally:
        sampling.PART_ROWS = numbering.PART_ROWS = held
    assert sorted(r["rank"] for r in got) == list(range(1, 701)) and len({r.cell for r in got}) == 700 and all(r.cell % 4 for r in got)


def test_knn_of_several_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 5))
    at = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "artifact int, row int, vector array<double>")
    held, neighbors.BLOCK = neighbors.BLOCK, 20
    try:
        got = neighbors.exact_knn(at, 4).collect()
    finally:
        neighbors.BLOCK = held
    for i in range(150):
        far = sorted((float(np.linalg.norm(v[i] - v[j])), j) for j in range(150) if j != i and j % 2 == i % 2)[:4]
        assert [r.dst for r in sorted((r for r in got if r.src == i), key=lambda r: r["rank"])] == [j for _, j in far]


def test_correlations_of_clusters_without_a_common_gene(spark):
    means = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 3.0), ("y", 3, 2.0), ("z", 1, 2.0), ("z", 2, 6.0)], "cluster string, gene int, mean double")
    got = {(r.a, r.b): r.corr for r in cluster.cluster_correlations(means, 4).collect()}
    dense = {"x": [1, 3, 0, 0], "y": [0, 0, 2, 0], "z": [2, 6, 0, 0]}
    for (a, b), c in got.items():
        assert math.isclose(c, np.corrcoef(dense[a], dense[b])[0, 1], abs_tol=1e-12)
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) + 5
    at = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row int, v array<double>")
    got = np.array([r.pca for r in cluster.pca(at, "v", 3).orderBy("row").collect()])
    centred = v - v.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:3] * np.sign(axes[:3][np.arange(3), np.abs(axes[:3]).argmax(1)])[:, None]
    assert np.allclose(got, centred @ axes.T, atol=1e-6)


def test_variable_genes_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.poisson(rng.gamma(1, 2, 40), (120, 40)).astype(float)
    values[:, 7] *= rng.choice([0, 6], 120)
    coo = spark.createDataFrame([(i, j, float(values[i, j])) for i in range(120) for j in range(40) if values[i, j]], "cell int, gene int, value double")
    cells = spark.range(120).selectExpr("CAST(id AS INT) AS cell", "IF(id < 70, 'a', 'b') AS batch")
    ranks = []
    for part in (values[:70], values[70:]):
        mean, var = part.mean(0), part.var(0, ddof=1)
        some = np.flatnonzero((mean > 0) & (var > 0))
        sd = 10 ** (cluster._local_fit(np.log10(mean[some]), np.log10(var[some]), 1.0) / 2)
        clipped = np.minimum(part[:, some], np.sqrt(len(part)) * sd + mean[some])
        score = (len(part) * mean[some] ** 2 + (clipped**2).sum(0) - 2 * clipped.sum(0) * mean[some]) / ((len(part) - 1) * sd**2)
        order = some[np.lexsort((some, -score))]
        ranks.append({int(g): i + 1 for i, g in enumerate(order)})
    middle = {g: statistics.median(r[g] for r in ranks if g in r) for g in ranks[0] | ranks[1]}
    expected = [g for g, _ in sorted(middle.items(), key=lambda x: (x[1], x[0]))][:10]
    assert [r.gene for r in cluster.variable_genes(coo, cells, 10, "batch").orderBy("rank").collect()] == expected


def ring(size, start):
    return [(start + i, start + (i + d) % size) for i in range(size) for d in (1, 2, 3, 4)]


def test_communities_of_a_planted_partition(spark):
    edges = spark.createDataFrame([*ring(12, 0), *ring(12, 100), (0, 100)], "src int, dst int")
    for resolution in (0.0, 1.0):
        got = {r.src: r.label for r in cluster.propagate_labels(edges, 12, resolution).collect()}
        groups = [{got[i] for i in range(12)}, {got[100 + i] for i in range(12)}]
        assert not groups[0] & groups[1]
    # A plain version of label propagation.
    near = {}
    for a, b in {(a, b) for a, b in map(tuple, edges.collect())} | {(b, a) for a, b in map(tuple, edges.collect())}:
        near.setdefault(a, set()).add(b)
    label = {v: v for v in near}
    for _ in range(3):
        votes = {v: statistics.multimode(label[x] for x in near[v]) for v in near}
        label = {v: min(x) for v, x in votes.items()}
    assert {r.src: r.label for r in cluster.propagate_labels(edges, 3).collect()} == label


def world(spark, n=60):
    cells = spark.createDataFrame(
        [(i, i % 3, "NCBITaxon:9606", ["a", "b", None][i % 3], [{"gene": f"g{j}", "value": float((i * j) % 5)} for j in range(6) if (i * j) % 5]) for i in range(n)],
        "cell long, artifact int, organism string, kind string, expr array<struct<gene: string, value: double>>",
    )
    vocabulary = spark.createDataFrame([(f"g{j}", "NCBITaxon:9606", j) for j in range(8)], "gene string, organism string, pos int")
    return cells, vocabulary


@pytest.mark.parametrize("how", ["most expr", "random expr", "all"])
def test_collation_within_rows_equals_a_join(spark, how, monkeypatch):
    cells, vocabulary = world(spark)
    options = CollateOptions(how=how, max_len=3, logp1=True, norm_to=1e4)
    inside = collate(cells, vocabulary, options)
    if how != "random expr":
        assert "Exchange hashpartitioning(cell" not in plan(inside)
    first = sorted(map(str, inside.collect()))
    monkeypatch.setattr(collating, "placing", lambda *a: None)
    assert sorted(map(str, collate(cells, vocabulary, options).collect())) == first


def test_keep_genes(spark):
    cells, _ = world(spark)
    few = spark.createDataFrame([("g1",), ("g4",)], "gene string")
    got = keep_genes(cells, few).select("cell", "expr").orderBy("cell").collect()
    assert all({x.gene for x in r.expr} <= {"g1", "g4"} for r in got) and len(got) == 60
    assert got == keep_genes(cells, few, limit=1).select("cell", "expr").orderBy("cell").collect()


def test_batches_have_the_asked_size_and_order(spark):
    at = spark.range(103).repartition(7).selectExpr("id", "array(CAST(id AS DOUBLE)) AS x")
    parts = list(iter_batches(at, 10, "id"))
    assert [len(p) for p in parts] == [10] * 10 + [3] and [i for p in parts for i in p["id"]] == list(range(103))
    assert list(iter_batches(at.limit(0), 10)) == []


def test_dataset_options(spark, tmp_path):
    cells, vocabulary = world(spark)
    var = spark.createDataFrame([(a, f"g{j}") for a in range(3) for j in range(1 + a, 5 + a)], "artifact int, gene string")
    inner = CellDataset(cells, vocabulary, predict=["kind"], join="inner", var=var)
    assert {r.gene for r in inner.genes.collect()} == {"g3", "g4"}
    assert {x.gene for r in inner.cells.collect() for x in r.expr} == {"g3", "g4"}
    with pytest.raises(ValueError):
        CellDataset(cells, vocabulary, join="inner", var=var.where("artifact < 2").union(spark.createDataFrame([(7, "x")], "artifact int, gene string")))
    with pytest.raises(ValueError):
        CellDataset(cells, vocabulary, join="left")
    edges = spark.createDataFrame([(i, (i + 1) % 60, 1, 0.5) for i in range(60)], "src long, dst long, rank int, distance double")
    meta = CellDataset(cells, vocabulary, edges=edges, metacell_share=1.0).cells
    total = lambda df: {r.cell: sum(x.value for x in r.expr) for r in df.collect()}
    plain = total(cells)
    assert total(meta) == {i: plain[i] + plain[(i + 1) % 60] for i in range(60)} and meta.where("is_meta").count() == 60
    kept = CellDataset(cells.withColumn("assay", F.lit("EFO:0010961")), vocabulary, edges=edges, metacell_share=1.0).cells
    assert total(kept) == plain and kept.where("is_meta").count() == 60
    near = CellDataset(cells, vocabulary, predict=["kind"], edges=edges, knn_cells=True)
    module = DataModule(near, ["kind"], LoaderOptions(validation=6), CollateOptions(how="all", norm_to=100.0))
    row = module.validation().first()
    assert len(row.knn_cells) == 1 and len(row.knn_cells[0]) == len(row.x) and row.knn_cells_info == [0.5] and row.dataset is not None
    near.save_encoders(f"{tmp_path}/e")
    near.load_encoders(f"{tmp_path}/e")
    assert {r.value: r.code for r in near.encoders["kind"].collect()} == {"a": 0, "b": 1, "unknown": -1}
    assert near.class_sizes().first().n_classes == 2 and "n_cells=60" in repr(near)
    assert near.aligned_share(var.withColumn("gene", F.concat("gene", F.lit("")))).first().pct_aligned == 100.0
    module.organisms = ["other"]
    assert module.validation().count() == 0


def test_a_split_is_made_anew_for_other_options(spark, tmp_path):
    cells, vocabulary = world(spark)
    of = lambda cells, **o: DataModule(CellDataset(cells, vocabulary, predict=["kind"]), ["kind"], LoaderOptions(n_samples=30, **o), CollateOptions(how="all"))
    first = of(cells, validation=6)
    first.setup(f"{tmp_path}/s")
    assert first.index is not None and first.draws().count() == 30
    count = lambda m: m.splits.where("split = 'validation'").count()
    again, other, more = of(cells, validation=6), of(cells, validation=9), of(cells.where("cell < 50"), validation=9)
    for module, n in ((again, 6), (other, 9), (more, 9)):
        module.setup(f"{tmp_path}/s")
        assert count(module) == n
    assert more.splits.count() == 50


def tables(spark):
    cells, vocabulary = world(spark)
    obs = cells.select("cell", "artifact", "organism", F.lit("EFO:1").alias("assay"), F.when(F.col("artifact") == 1, "bad").otherwise("T:1").alias("cell_type_ontology_term_id"))
    coo = cells.select("cell", F.explode("expr").alias("x")).select("cell", "x.gene", "x.value")
    var = obs.select("artifact").distinct().join(spark.range(6), how="cross").selectExpr("artifact", "CAST(id AS INT) AS var_idx", "concat('g', id) AS gene_id")
    known = vocabulary.selectExpr("gene AS gene_id", "gene AS symbol", "organism", "pos = 1 AS mt", "pos = 2 AS ribo", "false AS hb", "CAST(pos + 1 AS DOUBLE) AS length")
    ontology = spark.createDataFrame([("cell_type", "T:1", "t", [])], "kind string, ontology_id string, name string, parents array<string>")
    return obs, coo, var, known, ontology


OPTIONS = dict(min_nnz_genes=1, min_dataset_size=5, min_valid_genes=3, min_genes=3)


def test_preprocessor_steps(spark):
    obs, coo, var, known, ontology = tables(spark)
    run = Preprocessor(PreprocessOptions(**OPTIONS, n_hvg=3, n_pcs=2, binning=5))
    out = run.transform(obs, coo, var, known, ontology)
    assert {r.artifact: r.reason for r in run.report.collect()} == {0: None, 1: "labels", 2: None}
    assert {(r.artifact, r.value) for r in run.violations.collect()} == {(1, "bad")}
    assert {r.artifact: sorted(r.unseen) for r in run.unseen.collect()} == {a: ["g6", "g7"] for a in range(3)}
    assert {len(r.pca) for r in out.collect() if r.pca} == {2}
    layered = coo.withColumns({"counts": F.col("value"), "value": F.col("value") / 2})
    own = Preprocessor(PreprocessOptions(**OPTIONS, skip_validate=True)).transform(obs, layered, var, known, ontology)
    whole = Preprocessor(PreprocessOptions(**OPTIONS)).transform(obs, coo, var, known)
    sums = lambda df: sorted((r.cell, r.total_counts) for r in df.collect())
    assert sums(own) == sums(whole)
    with pytest.raises(ValueError):
        Preprocessor(PreprocessOptions(**OPTIONS, use_layer="gone")).transform(obs, coo, var, known)
    with pytest.raises(ValueError):
        PreprocessOptions(binning=1.5)
    negative = Preprocessor(PreprocessOptions(**OPTIONS, binning=5))
    negative.transform(obs, coo.withColumn("value", F.when((F.col("cell") % 3 == 0) & (F.col("gene") == "g1"), -1.0).otherwise(F.col("value"))), var, known)
    assert {r.artifact: r.reason for r in negative.report.collect()}[0] == "negative values"
    full = Preprocessor(PreprocessOptions(**OPTIONS, length_normalize=True)).transform(obs.withColumn("assay", F.lit("EFO:0008930")), coo, var, known)
    value = {(r.cell, x.gene): x.value for r in full.collect() for x in r.expr}
    assert all(math.isclose(value[r.cell, r.gene], r.value / (int(r.gene[1:]) + 1)) for r in coo.collect() if (r.cell, r.gene) in value)


def test_collection_is_registered_resumed_and_sliced(spark, tmp_path):
    obs, coo, var, known, _ = tables(spark)
    sizes = spark.createDataFrame([(a, 10 if a else 5000) for a in range(3)], "artifact int, bytes long")
    for name, df in {"obs": obs.where("artifact < 2"), "coo": coo, "var": var, "vocabulary": known, "sizes": sizes}.items():
        df.write.parquet(f"{tmp_path}/in/{name}")
    options = PreprocessOptions(**OPTIONS, maxfilesize=1000)
    assert preprocess_collection(spark, f"{tmp_path}/in", f"{tmp_path}/out", options, key="k").count() == 2
    obs.write.mode("overwrite").parquet(f"{tmp_path}/in/obs")
    assert preprocess_collection(spark, f"{tmp_path}/in", f"{tmp_path}/out", options, key="k", resume=True).count() == 3
    cells = spark.read.parquet(f"{tmp_path}/out/cells")
    assert cells.groupBy("cell").count().where("count > 1").isEmpty() and cells.select("artifact").distinct().count() == 3
    assert {r.block_id for r in cells.collect()} == {0}  # a block has thousands of cells at least
    artifacts, collection = (spark.read.parquet(f"{tmp_path}/out/catalog/{x}") for x in ("artifacts", "collection"))
    assert sum(r.n_cells for r in artifacts.collect()) == cells.count() and all(r.bytes > 0 for r in artifacts.collect())
    members = catalog.members(artifacts, collection, "k").withColumn("n_organisms", F.lit(1))
    assert catalog.read_cells(spark, [r.path for r in members.collect()]).count() == cells.count()
    sliced, _ = catalog.write_slice(spark, members, (0, 2), f"{tmp_path}/slice", f"{tmp_path}/slice_catalog", "s")
    assert sliced.count() == 2


def test_unreadable_formats_are_left_out(spark):
    artifacts = spark.createDataFrame([("a", ".parquet", True), ("b", ".h5ad", True)], "artifact_id string, suffix string, is_latest boolean")
    collection = spark.createDataFrame([("k", "a", 0), ("k", "b", 1)], "collection_key string, artifact_id string, ordinal int")
    assert [r.artifact_id for r in catalog.members(artifacts, collection, "k").collect()] == ["a"]


def test_default_hooks(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        group = i % 2
        centre = np.array([10.0, 0, 0]) if group else np.array([0, 10.0, 0])
        rows.append((i, 0, "NCBITaxon:9606", "T (cell culture)" if group else "T", "S:1", (centre + rng.normal(size=3) * 0.1).tolist()))
    cells = spark.createDataFrame(rows, "cell long, artifact int, organism string, cell_type_ontology_term_id string, development_stage_ontology_term_id string, pca array<double>")
    clean = clean_before(cells)
    assert {r.cell_type_ontology_term_id for r in clean.collect()} == {"T"} and clean.where("cell_culture = 'True'").count() == 30
    coo = spark.createDataFrame([(i, i % 2 * 2 + j, 1.0 + j) for i in range(60) for j in range(2)], "cell long, gene int, value double")
    stages = spark.createDataFrame([("stage", "S:1", "s", ["S:0"])], "kind string, ontology_id string, name string, parents array<string>")
    out = after_with(coo, stages, {"S:0": "young"}, 6, k=5)(clean).collect()
    assert len(out) == 60 and {r.age_group for r in out} == {"young"}
    for c in ("leiden_2", "leiden_1", "leiden_0.5"):
        assert not {r[c] for r in out if r.cell % 2} & {r[c] for r in out if r.cell % 2 == 0}
    group = clean.withColumn("leiden_1", F.col("cell") % 2)
    names = {r.cell: r.clust_cell_type for r in cluster_names(group, coo, 6).collect()}
    assert {names[i] for i in range(0, 60, 2)} == {"T"} and {names[i] for i in range(1, 60, 2)} == {"T_1"}
    # Clusters of one type with the same values are merged and numbered again.
    same = coo.withColumn("gene", F.col("gene") % 2)
    assert {r.clust_cell_type for r in cluster_names(group, same, 6).collect()} == {"T"}


def test_gene_registry(spark, tmp_path):
    from cellspark.__main__ import populate, populate_genes

    spark.createDataFrame([("E1", None, "MT-A", "m"), (None, "S1", "B", "m"), ("E9", None, "C", "m")], "ensembl_gene_id string, stable_id string, symbol string, organism string").write.parquet(f"{tmp_path}/g")
    spark.createDataFrame([("OLD", "o", "h", False, False, False), ("E1", "x", "h", False, False, False)], "gene_id string, symbol string, organism string, mt boolean, ribo boolean, hb boolean").write.parquet(f"{tmp_path}/k")
    (tmp_path / "drop").write_text("E9\n")
    populate_genes(spark, f"{tmp_path}/g", f"{tmp_path}/o", f"{tmp_path}/k", f"{tmp_path}/drop")
    assert {(r.gene_id, r.organism, r.mt) for r in spark.read.parquet(f"{tmp_path}/o").collect()} == {("E1", "m", True), ("S1", "m", False), ("OLD", "h", False)}
    spark.createDataFrame([("disease", "D:1", "d", [])], "kind string, ontology_id string, name string, parents array<string>").write.parquet(f"{tmp_path}/t")
    populate(spark, f"{tmp_path}/t", f"{tmp_path}/to")
    assert {r.ontology_id for r in spark.read.parquet(f"{tmp_path}/to").collect()} == {"D:1", "unknown", "normal"}


def test_inner_genes_need_one(spark):
    with pytest.raises(ValueError):
        genes.require_genes(genes.inner_genes(spark.createDataFrame([(1, "a"), (2, "b")], "artifact int, gene string")))


def test_label_filters(spark):
    at = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    assert [(r.v, r.n) for r in labels.frequent_values(at, "v", 1).collect()] == [("x", 2)]
    assert labels.excluding(at, "v", ["x"]).count() == 1 and labels.excluding(at, "v", []).count() == 3
