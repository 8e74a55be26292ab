"""Gene lists, tables of genes, vocabularies, random strings, files by size, and the command line from end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import scalars
from cellspark.functions.vocabularies import ADDED_TERMS, COARSE_GROUPS, dimension_rows
from cellspark.operators import genes
from cellspark.plans.datamodule import CellDataset
from cellspark.sources import catalog, files


def test_only_columns_of_one_table_are_merged(spark):
    a = spark.createDataFrame([("g1", 1, "x"), ("g2", 2, None), ("g2", 5, "b")], "gene string, `a.b` int, shared string")
    b = spark.createDataFrame([("g2", "y", 7), (None, "z", 8)], "gene string, shared string, c int")
    out = genes.merge_only([a, b])
    assert out.columns == ["gene", "a.b", "c"]
    assert {tuple(r) for r in out.collect()} == {("g1", 1, None), ("g2", 2, 7), (None, None, 8)}
    assert {tuple(r) for r in genes.merge_only([a.select("gene"), b.select("gene")]).collect()} == {("g1",), ("g2",), (None,)}
    assert genes.merge_only([a.limit(0), b.limit(0)]).count() == 0
    with pytest.raises(ValueError):
        genes.merge_only([])


def test_gene_lists_are_kept_until_an_artifact_is_new(spark, tmp_path):
    var = spark.createDataFrame([("a", "g2", 0), ("a", "g1", 1), ("b", "g1", 0)], "artifact string, gene string, var_idx int")
    assert {r.artifact: (r.genes, r.n_vars) for r in genes.gene_lists(var, order="var_idx").collect()} == {"a": (["g2", "g1"], 2), "b": (["g1"], 1)}
    data = CellDataset.from_df(spark.createDataFrame([(1, "a", "h")], "cell long, artifact string, organism string"), var)
    path = f"{tmp_path}/lists"
    first = {r.artifact: r.genes for r in data.gene_lists(var, path).collect()}
    assert first == {"a": ["g1", "g2"], "b": ["g1"]}
    changed = var.where("gene = 'g1'")
    assert {r.artifact: r.genes for r in data.gene_lists(changed, path).collect()} == first
    assert {r.artifact: r.genes for r in data.gene_lists(changed, path, force=True).collect()} == {"a": ["g1"], "b": ["g1"]}
    more = var.union(spark.createDataFrame([("c", "g9", 0)], var.schema))
    assert data.gene_lists(more, path).count() == 3


def test_cached_gene_table(spark, tmp_path):
    source, cache, calls = tmp_path / "g.tsv", f"{tmp_path}/cache", []
    source.write_text("ensembl_gene_id\thgnc_symbol\tgene_biotype\tlength\nE1\tA\tp\t3\nE2\t\tq\t4\n\tB\tp\t5\n")

    def fetched():
        calls.append(1)
        return spark.read.csv(str(source), sep="\t", header=True).select("ensembl_gene_id", "hgnc_symbol", "gene_biotype")

    get = lambda *attributes, **o: sorted(tuple(r) for r in files.cached_gene_table(spark, fetched, cache, attributes, **o).collect())
    assert get("gene_biotype") == [("E1", "A", "p"), ("E2", "E2", "q")]
    assert get() == [("E1", "A", "p"), ("E2", "E2", "q")] and get("hgnc_symbol") == [("E1", "A"), ("E2", "E2")] and len(calls) == 1
    assert get(use_cache=False) and len(calls) == 2
    with pytest.raises(ValueError, match="length"):
        get("length")
    # The cache lacks what is asked for, and the file has it.
    assert sorted(tuple(r) for r in files.cached_gene_table(spark, str(source), cache, ["length"]).collect()) == [("E1", "A", "3"), ("E2", "E2", "4")]


def test_dimension_rows(spark):
    rows = dimension_rows(spark).collect()
    assert len(rows) == sum(map(len, ADDED_TERMS.values())) + sum(map(len, COARSE_GROUPS.values())) == 25 + 60
    assert ("cell_type_ontology_term_id", "neuron", "CL:0000540") in {tuple(r) for r in rows}
    assert all((r.ontology_id is None) == r.vocabulary.startswith("coarse_") for r in rows)


def test_random_strings(spark):
    at = spark.range(200).select(scalars.random_string(12, 3).alias("a"), scalars.random_string(12, 3, digits=False).alias("b"), scalars.random_string(0).alias("c")).collect()
    assert all(len(r.a) == len(r.b) == 12 and r.a.isalnum() and r.b.isalpha() and r.c == "" for r in at)
    assert len({r.a for r in at}) == len({r.b for r in at}) == 200 and any(x.isdigit() for r in at for x in r.a)


def test_files_follow_sizes(spark, tmp_path):
    cells = spark.range(60_000).select("id", F.when(F.col("id") % 100 < 90, 0).otherwise(F.col("id") % 7 + 1).alias("artifact"), F.randstr(F.lit(40)).alias("x"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        catalog.write_collection(cells.repartition(8), f"{tmp_path}/c")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    counts = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "c").glob("artifact=*")}
    assert counts["artifact=0"] > 3 and len(counts) == 8
    assert spark.read.parquet(f"{tmp_path}/c").count() == 60_000
    catalog.write_collection(cells.repartition(8), f"{tmp_path}/d")
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "d").glob("artifact=*"))


def test_command_line_from_end_to_end(spark, tmp_path, monkeypatch):
    from cellspark import __main__ as cli

    rng, obs, coo = np.random.default_rng(0), [], []
    for i in range(40):
        group = i % 2
        obs.append((i, i // 20, "NCBITaxon:9606", "EFO:1", "T", "S:1", "d1"))
        for g in range(6):
            if (v := float(rng.poisson(30 if (g < 3) == bool(group) else 1))) > 0:
                coo.append((i, f"g{g}", v))
    spark.createDataFrame(obs, "cell long, artifact int, organism string, assay string, cell_type_ontology_term_id string, development_stage_ontology_term_id string, donor_id string").write.parquet(f"{tmp_path}/in/obs")
    spark.createDataFrame(coo, "cell long, gene string, value double").write.parquet(f"{tmp_path}/in/coo")
    spark.createDataFrame([(a, g, f"g{g}") for a in range(2) for g in range(6)], "artifact int, var_idx int, gene_id string").write.parquet(f"{tmp_path}/in/var")
    spark.createDataFrame([(f"g{g}", f"G{g}", "NCBITaxon:9606", False, False, False) for g in range(6)], "gene_id string, symbol string, organism string, mt boolean, ribo boolean, hb boolean").write.parquet(f"{tmp_path}/in/vocabulary")
    spark.createDataFrame([("stage", "S:1", "s", ["S:0"])], "kind string, ontology_id string, name string, parents array<string>").write.parquet(f"{tmp_path}/in/ontology")
    (tmp_path / "stages.tsv").write_text("S:0\tyoung\n")
    options = "--min-nnz-genes 1 --min-dataset-size 5 --min-valid-genes 3 --min-genes 3 --skip-validate --batch-keys donor_id --key made"
    with pytest.raises(ValueError, match="n_pcs"):
        cli.main(["preprocess", f"{tmp_path}/in", f"{tmp_path}/no", *options.split(), "--communities"])
    cli.main(["preprocess", f"{tmp_path}/in", f"{tmp_path}/out", *options.split(), *f"--communities --stages {tmp_path}/stages.tsv --neighbours 4 --n-hvg 6 --n-pcs 2".split()])
    assert {r.status for r in spark.read.parquet(f"{tmp_path}/out/report").collect()} == {"kept"}
    out = spark.read.parquet(f"{tmp_path}/out/cells").collect()
    assert len(out) == 40 and {r.age_group for r in out} == {"young"}
    assert not {r.leiden_1 for r in out if r.cell % 2} & {r.leiden_1 for r in out if r.cell % 2 == 0}
    assert {r.collection_key for r in spark.read.parquet(f"{tmp_path}/out/catalog/collection").collect()} == {"made"}
