"""Command line: ``python -m cellspark preprocess IN OUT``, ``populate IN OUT`` and ``genes IN OUT``."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.genes import gene_vocabulary
from .plans.defaults import after_with, clean_before
from .plans.preprocess import PreprocessOptions, preprocess_collection
from .sources.files import read_list


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cellspark")
    commands = out.add_subparsers(dest="command", required=True)
    pre = commands.add_parser("preprocess", help="preprocess a collection of Parquet tables")
    pre.add_argument("in_dir")
    pre.add_argument("out_dir")
    pre.add_argument("--start-at", type=int, default=0)
    pre.add_argument("--organisms", nargs="+", default=list(PreprocessOptions.organisms))
    pre.add_argument("--filter-gene-by-counts", type=float, default=0)
    pre.add_argument("--filter-cell-by-counts", type=float, default=0)
    pre.add_argument("--min-nnz-genes", type=int, default=PreprocessOptions.min_nnz_genes)
    pre.add_argument("--min-dataset-size", type=int, default=PreprocessOptions.min_dataset_size)
    pre.add_argument("--min-valid-genes", type=int, default=PreprocessOptions.min_valid_genes)
    pre.add_argument("--min-genes", type=int, default=PreprocessOptions.min_genes)
    pre.add_argument("--max-drop", type=float, default=PreprocessOptions.max_drop)
    pre.add_argument("--assays-to-drop", nargs="*", default=list(PreprocessOptions.assays_to_drop))
    pre.add_argument("--keep-non-primary", action="store_false", dest="drop_non_primary")
    pre.add_argument("--normalize-sum", type=float, default=PreprocessOptions.normalize_sum)
    pre.add_argument("--madoutlier", type=float, default=PreprocessOptions.madoutlier)
    pre.add_argument("--pct-mt-outlier", type=float, default=PreprocessOptions.pct_mt_outlier)
    pre.add_argument("--batch-keys", nargs="*", default=list(PreprocessOptions.batch_keys))
    pre.add_argument("--no-raw", action="store_false", dest="use_raw")
    pre.add_argument("--use-layer")
    pre.add_argument("--length-normalize", action="store_true")
    pre.add_argument("--skip-validate", action="store_true")
    pre.add_argument("--n-pcs", type=int, default=0)
    pre.add_argument("--maxfilesize", type=float, default=PreprocessOptions.maxfilesize)
    pre.add_argument("--clean-labels", action="store_true", help="clean ethnicities, cell types and tissues first")
    pre.add_argument("--key", default="preprocessed", help="name of the collection that is registered")
    pre.add_argument("--communities", action="store_true", help="add communities, names of clusters and age groups; needs --n-pcs")
    pre.add_argument("--stages", help="tab-separated stage and group, for age groups")
    pre.add_argument("--neighbours", type=int, default=15)
    pre.add_argument("--approximate", action="store_true", help="approximate neighbours, for large artifacts")
    pre.add_argument("--by-modularity", action="store_true")
    pre.add_argument("--resume", action="store_true", help="skip artifacts that the report has already")
    pre.add_argument("--n-hvg", type=int, default=0)
    pre.add_argument("--binning", type=int, default=0)
    pre.add_argument("--force", action="store_true")
    pre.add_argument("--is-symbol", action="store_true")
    fill = commands.add_parser("populate", help="load ontology tables and add the unknown term to each registry")
    fill.add_argument("in_dir")
    fill.add_argument("out_dir")
    genes = commands.add_parser("genes", help="add gene tables of further organisms to a gene registry")
    genes.add_argument("in_dir", help="a table with ensembl_gene_id or stable_id, symbol and organism")
    genes.add_argument("out_dir")
    genes.add_argument("--known", help="the registry so far")
    genes.add_argument("--drop", help="a list of gene ids to leave out, one a line")
    return out


def populate_genes(spark: SparkSession, in_dir: str, out_dir: str, known: str | None = None, drop: str | None = None) -> None:
    """Write the genes of every organism in a table, with flags, and those of the registry so far that the table lacks."""
    rows = spark.read.parquet(in_dir)
    at = rows.withColumn("gene_id", F.coalesce("ensembl_gene_id", "stable_id"))
    if drop:
        at = at.join(read_list(spark, drop).select(F.trim("item").alias("gene_id")).distinct(), "gene_id", "left_anti")
    out = gene_vocabulary(at, None)
    if known:
        old = spark.read.parquet(known)
        out = out.unionByName(old.join(out.select("gene_id"), "gene_id", "left_anti"), allowMissingColumns=True)
    out.write.mode("overwrite").parquet(out_dir)


def populate(spark: SparkSession, in_dir: str, out_dir: str) -> None:
    """Write the ontology table below ``in_dir`` with an "unknown" term in each registry and a "normal" disease."""
    terms = spark.read.parquet(in_dir)
    extra = terms.select("kind").distinct().select("kind", F.explode(F.when(F.col("kind") == "disease", F.array(F.lit("unknown"), F.lit("normal"))).otherwise(F.array(F.lit("unknown")))).alias("ontology_id"))
    extra = extra.select("kind", "ontology_id", F.col("ontology_id").alias("name"), F.array().cast("array<string>").alias("parents"))
    terms.select("kind", "ontology_id", "name", "parents").unionByName(extra).dropDuplicates(["kind", "ontology_id"]).write.mode("overwrite").parquet(out_dir)


def communities_after(spark: SparkSession, in_dir: str, given: dict) -> Callable[[DataFrame], DataFrame] | None:
    """The hook after preprocessing, of the options that are its own, which are taken out of ``given``; None if it was not asked for."""
    wanted, stages, k, approximate, by_modularity = (given.pop(x) for x in ("communities", "stages", "neighbours", "approximate", "by_modularity"))
    if not wanted:
        return None
    if not given["n_pcs"]:
        raise ValueError("communities are those of components; set n_pcs")
    groups = {r.stage: r.group for r in spark.read.csv(stages, sep="\t", schema="stage string, `group` string").collect()} if stages else {}
    tables = {n: spark.read.parquet(f"{in_dir}/{n}") for n in ("coo", "vocabulary", "ontology")}
    return after_with(tables["coo"].select("cell", "gene", "value"), tables["ontology"], groups, tables["vocabulary"].count(), k, approximate, by_modularity)


def main(arguments: list[str] | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    command, in_dir, out_dir = given.pop("command"), given.pop("in_dir"), given.pop("out_dir")
    spark = SparkSession.builder.appName("cellspark").getOrCreate()
    if command == "populate":
        populate(spark, in_dir, out_dir)
    elif command == "genes":
        populate_genes(spark, in_dir, out_dir, **given)
    else:
        start, key, resume = given.pop("start_at"), given.pop("key"), given.pop("resume")
        before = clean_before if given.pop("clean_labels") else None
        after = communities_after(spark, in_dir, given)
        preprocess_collection(spark, in_dir, out_dir, PreprocessOptions(**given, before=before, after=after), start, key, resume).show(truncate=False)


if __name__ == "__main__":
    main()
