"""Small hand-made cases: nulls, ties, zeros, cycles, single members, and the shapes of whole plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import scalars
from cellspark.operators import cluster, genes, labels, neighbors, ontology, qc, remap, sampling, select
from cellspark.plans.collate import CollateOptions, collate, iter_batches
from cellspark.plans.datamodule import CellDataset, DataModule, LoaderOptions
from cellspark.plans.preprocess import PreprocessOptions, Preprocessor, preprocess_collection
from cellspark.sources import catalog, files

TERMS = [("ethnicity", "HANCESTRO:0005", "European", []), ("ethnicity", "HANCESTRO:0008", "African", [])]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "kind string, ontology_id string, name string, parents array<string>")


@pytest.mark.parametrize(
    ("ids", "name"),
    [
        ("HANCESTRO:0005", "European"),
        ("HANCESTRO:0005,HANCESTRO:0008", "European,African"),
        ("HANCESTRO:9999", None),
        ("HANCESTRO:0005,HANCESTRO:9999", None),
        ("HANCESTRO:0005, HANCESTRO:0008", "European,African"),
    ],
)
def test_translate(spark, terms, ids, name):
    assert ontology.translate(spark.createDataFrame([(ids,)], "ids string"), terms, "ethnicity").first().name == name


def test_translate_value(spark, terms):
    label = "self_reported_ethnicity_ontology_term_id"
    assert ontology.translate_value(spark, terms, ["HANCESTRO:0005", "HANCESTRO:0005,HANCESTRO:0008"], label) == ["European", "European,African"]
    assert ontology.translate_value(spark, terms, {"HANCESTRO:0008": 3}, label) == {"African": 3}
    assert ontology.translate_value(spark, terms, "HANCESTRO:0008", label) == {"HANCESTRO:0008": "African"}
    assert ontology.translate_value(spark, terms, "x", "other") is None


def test_closure_with_diamond_and_cycle(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r.child, r.ancestor) for r in ontology.closure(edges).collect()}
    assert got == {("d", "b"), ("d", "c"), ("d", "a"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}


def test_encoder_null_and_boolean(spark):
    obs = spark.createDataFrame([(1, None, True), (2, "b", False), (3, "a", None)], "cell int, lab string, flag boolean")
    codes = {r.value: r.code for r in labels.encoder(obs, "lab").collect()}
    assert codes == {"a": 0, "b": 1, "unknown": -1}
    assert {r.cell: r.code for r in labels.encode(obs, labels.encoder(obs, "lab"), "lab").collect()} == {1: -1, 2: 1, 3: 0}
    assert {r.value for r in labels.categories(obs, "flag").collect()} == {"True", "False", "unknown"}
    with pytest.raises(Exception, match="has no code"):
        labels.encode(obs, labels.encoder(obs.where("lab = 'a'"), "lab"), "lab").collect()


def cell(spark, *expr):
    return spark.createDataFrame([(1, [{"gene": g, "value": float(v)} for g, v in expr])], "cell long, expr array<struct<gene: int, value: double>>")


def test_most_expressed_ties_and_empty(spark):
    at = cell(spark, (3, 5), (1, 5), (2, 9), (4, 0))
    assert [x.gene for x in at.select(select.most_expressed(F.col("expr"), 3).alias("x")).first().x] == [2, 1, 3]
    assert cell(spark).select(select.most_expressed(F.col("expr"), 3).alias("x")).first().x == []


def test_bins_match_numpy(spark):
    values = [1, 1, 2, 3, 5, 8, 13]
    row = select.with_bins(cell(spark, *enumerate(values), (9, 0)), 6).first()
    edges = np.quantile(values, np.linspace(0, 1, 5))
    assert row.bin_edges == [0.0, *edges.tolist()]
    assert [b.bin for b in row.bins] == [int((edges <= v).sum()) for v in values] + [0]
    assert select.with_bins(cell(spark), 6).first().bin_edges == [0.0] * 6


def test_zero_genes_fill_from_a_small_vocabulary(spark):
    at = spark.createDataFrame([(1, [0, 1, 2]), (2, [])], "cell long, taken array<int>")
    got = {r.cell: sorted(r.zeros) for r in select.with_zero_genes(at, F.lit(5), 6, probes=2).collect()}
    assert got[1] == [3, 4, 5] and len(set(got[2])) == 5


def test_revert_to_raw(spark):
    raw = spark.createDataFrame([([0.0, math.log2(3), math.log2(5)],)], "v array<double>").select(scalars.revert_to_raw(F.col("v")).alias("r")).first().r
    assert raw == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        scalars.revert_to_raw(F.col("v"), "no")


def test_outliers_and_filters(spark):
    m = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "cell int, m double")
    assert [r.cell for r in qc.with_outlier(m, "m", 5, "o").where("o").collect()] == [4]
    coo = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 2, 1.0)], "cell int, gene int, value double")
    assert [(r.cell, r.gene) for r in qc.filter_counts(coo, 3, 3).collect()] == [(1, 1)]


def test_duplicate_genes_keep_the_first(spark):
    var = spark.createDataFrame([(0, 0, "g1", "s"), (0, 1, "g1", "s"), (0, 2, "zz", "s")], "artifact int, var_idx int, gene_id string, symbol string")
    known = spark.createDataFrame([("g1", "s")], "gene_id string, symbol string")
    assert [r.var_idx for r in genes.join_vocabulary(var, known).collect()] == [0]
    assert genes.join_vocabulary(var, known, by_symbol=True).first().gene_id == "g1"


def test_split_covers_all_and_holds_out_whole_artifacts(spark):
    obs = spark.range(1000).selectExpr("id AS cell", "id % 7 AS artifact", "id AS global_idx")
    got = sampling.split(obs, 0.1, 0.3).groupBy("split", "artifact").count().collect()
    assert sum(r["count"] for r in got) == 1000
    held = {r.artifact for r in got if r.split == "test"}
    assert held and not held & {r.artifact for r in got if r.split != "test"}
    assert sum(r["count"] for r in got if r.split == "validation") == 100
    assert sampling.split(obs, 0.1).where("split = 'test'").count() == 0


def test_shuffled_index_is_dense(spark):
    got = sampling.shuffled_index(spark.range(500), "id", 3).select("shuffled").collect()
    assert sorted(r.shuffled for r in got) == list(range(500))


def test_draws_follow_weights(spark):
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "label int, weight double")
    got = {r.label: r["count"] for r in sampling.draw_labels(weights, 8000, 1).groupBy("label").count().collect()}
    assert got.keys() == {0, 1} and abs(got[1] / 8000 - 0.75) < 0.02
    rows = spark.range(100).selectExpr("0 AS label", "id AS cell", "IF(id < 50, 0.0D, 1.0D) AS w")
    few = sampling.draw_without_replacement(rows, spark.createDataFrame([(0, 500)], "label int, n int"), "cell", weight="w").collect()
    assert sorted(r.cell for r in few) == list(range(50, 100))
    many = sampling.draw_weighted(spark.range(2000).selectExpr("id AS draw_id", "0 AS label"), rows, "cell", "w")
    assert many.count() == 2000 and many.where("cell < 50").count() == 0


def test_rank_shards_cover(spark):
    at = spark.range(10).withColumnRenamed("id", "global_idx")
    assert sum(sampling.rank_shard(at, 10, r, 3).count() for r in range(3)) == 10


def test_nearest_edges_put_zeros_last(spark):
    e = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (1, 3, 1.0)], "src int, dst int, distance double")
    assert [r.dst for r in neighbors.nearest_edges(e).orderBy("rank").collect()] == [3, 2, 1]


def test_remap(spark):
    obs = spark.createDataFrame([(1, "na", "T (cell culture)", "CL:1"), (2, "E", "T", "liver (organoid)")], "cell int, e string, c string, t string")
    got = [tuple(r) for r in remap.clean_labels(obs, "e", "c", "t").orderBy("cell").collect()]
    assert got == [(1, "unknown", "T", "unknown", "True"), (2, "E", "T", "liver", "True")]


def test_pca_is_centred(spark):
    at = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0]) for i in range(30)], "row int, v array<double>")
    got = np.array([r.pca for r in cluster.pca(at, "v", 2).collect()])
    assert np.abs(got.mean(0)).max() < 1e-9


def world(spark, n=60):
    cells = spark.createDataFrame(
        [(i, i % 3, "NCBITaxon:9606", ["a", "b", None][i % 3], [{"gene": f"g{j}", "value": float((i * j) % 5)} for j in range(6) if (i * j) % 5]) for i in range(n)],
        "cell long, artifact int, organism string, kind string, expr array<struct<gene: string, value: double>>",
    )
    vocabulary = spark.createDataFrame([(f"g{j}", "NCBITaxon:9606", j) for j in range(8)], "gene string, organism string, pos int")
    return cells, vocabulary


@pytest.mark.parametrize("how", ["most expr", "random expr", "all", "some"])
def test_collate_widths(spark, how):
    cells, vocabulary = world(spark)
    rows = collate(cells, vocabulary, CollateOptions(how=how, max_len=4, genelist=["g1", "g5"])).collect()
    assert len(rows) == 60 and {len(r.x) for r in rows} == {{"all": 8, "some": 2}.get(how, 4)}
    assert all(len(set(r.genes)) == len(r.genes) for r in rows)
    if how == "most expr":
        assert all(r.x == sorted(r.x, reverse=True) for r in rows)


def test_collate_refuses_unknown_choice(spark):
    cells, vocabulary = world(spark)
    with pytest.raises(ValueError):
        collate(cells, vocabulary, CollateOptions(how="best"))


def test_data_module(spark, tmp_path):
    cells, vocabulary = world(spark)
    data = CellDataset(cells, vocabulary, predict=["kind"])
    module = DataModule(data, ["kind"], LoaderOptions(n_samples=50, batch_size=8, validation=6), CollateOptions(how="most expr", max_len=3))
    module.setup(str(tmp_path / "split"))
    train = module.train().collect()
    assert len(train) == 50 and {r["class"][0] for r in train} <= {-1, 0, 1}
    assert module.validation().count() == 6 and len(data) == 60
    assert sum(module.predict(r, 2).count() for r in range(2)) == 54
    assert sum(len(b) for b in iter_batches(module.validation(), 4)) == 6
    assert module.genes_by_organism().count() == 1


def test_hierarchical_dataset(spark):
    cells, vocabulary = world(spark)
    onto = spark.createDataFrame([("k", "a", "A", ["top"]), ("k", "b", "B", ["top"])], "kind string, ontology_id string, name string, parents array<string>")
    data = CellDataset(cells, vocabulary, hierarchical=["kind"], ontologies=onto)
    assert {r.value: r.code for r in data.encoders["kind"].collect()} == {"a": 0, "b": 1, "top": 2, "unknown": -1}
    assert {(r.ancestor_code, r.leaf_code) for r in data.labels_hierarchy("kind").collect()} == {(2, 0), (2, 1)}


def test_preprocess_reports_each_artifact(spark, tmp_path):
    cells, vocabulary = world(spark)
    obs = cells.select("cell", "artifact", "organism", F.lit("EFO:1").alias("assay"))
    coo = cells.select("cell", F.explode("expr").alias("x")).select("cell", "x.gene", "x.value")
    var = obs.select("artifact").distinct().crossJoin(spark.range(6)).selectExpr("artifact", "CAST(id AS INT) AS var_idx", "concat('g', id) AS gene_id")
    known = vocabulary.selectExpr("gene AS gene_id", "gene AS symbol", "organism", "pos = 1 AS mt", "pos = 2 AS ribo", "false AS hb")
    options = PreprocessOptions(min_nnz_genes=1, min_dataset_size=5, min_valid_genes=3, min_genes=3, binning=5, n_hvg=3)
    run = Preprocessor(options)
    out = run.transform(obs, coo, var, known)
    assert {r.status for r in run.report.collect()} == {"kept"}
    assert out.count() > 0 and {"outlier", "X_binned", "batches"} <= set(out.columns)
    for name, df in {"obs": obs, "coo": coo, "var": var, "vocabulary": known}.items():
        df.write.parquet(f"{tmp_path}/in/{name}")
    report = preprocess_collection(spark, f"{tmp_path}/in", f"{tmp_path}/out", options, start_at=1)
    assert report.count() == 2 and spark.read.parquet(f"{tmp_path}/out/cells").count() > 0


def test_sources(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("ensembl_gene_id\thgnc_symbol\nE1\tA\nE2\t\n\tB\n")
    assert {(r.ensembl_gene_id, r.hgnc_symbol) for r in files.read_gene_table(spark, str(tmp_path / "g.tsv")).collect()} == {("E1", "A"), ("E2", "E2")}
    files.write_list(spark.createDataFrame([("x",), ("y",)], "item string"), str(tmp_path / "l"))
    assert {r.item for r in files.read_list(spark, str(tmp_path / "l")).collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        catalog.check_rows(spark.createDataFrame([(1,)], "indptr int"))
    with pytest.raises(ValueError):
        catalog.read_cells(spark, [])


def test_stream(spark, tmp_path):
    from cellspark.streaming import ingest

    src = spark.range(10).selectExpr("id AS cell", "CAST(id AS DOUBLE) AS value")
    src.write.parquet(f"{tmp_path}/in")
    stream = ingest.read_new(spark, f"{tmp_path}/in", src.schema)
    ingest.preprocess_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", lambda df: df.where("value > 4")).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_cli_parses():
    from cellspark.__main__ import parser

    given = parser().parse_args(["preprocess", "a", "b", "--organisms", "x", "y", "--force"])
    assert given.organisms == ["x", "y"] and given.force
