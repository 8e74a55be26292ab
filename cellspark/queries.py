"""A query over the test tables for each operator; their SQL is in :mod:`cellspark.sql`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import standins as t
from .functions import scalars
from .operators import approximate, cluster, components, labels, leiden, neighbors, ontology, qc, remap, sampling, select
from .operators import genes as gene_ops
from .operators.numbering import shared_folder
from .plans.collate import CollateOptions, collate
from .plans.datamodule import CellDataset, DataModule, LoaderOptions
from .plans.growing import GrowingCollection
from .sources import catalog, files
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query
def scan_union_index(s, d):
    return catalog.with_global_index(t.obs(s, d)).select("cell", "storage_idx", "obs_idx", "global_idx")


@query
def obs_filter(s, d):
    at = t.obs(s, d).where(F.col("priority").isin("1-URGENT", "2-HIGH") & (F.col("status") == "F"))
    return at.groupBy("artifact").agg(F.count("*").alias("n"), F.min("cell").alias("first_cell"))


@query
def block_split(s, d):
    at = catalog.with_global_index(t.obs(s, d))
    sizes = at.groupBy("artifact").agg(F.count("*").alias("n"), (F.count("*") * 100).alias("bytes"))
    return catalog.with_blocks(at, sizes, block_bytes=1000.0, block_cells=10).groupBy("artifact", "block_id").agg(F.count("*").alias("n"))


@query
def slice_artifacts(s, d):
    at = t.table(s, d, "nation").select("n_name", F.col("n_nationkey").alias("ordinal"), F.lit(1).alias("n_organisms"))
    return catalog.slice_members(at, (5, 12)).select("n_name", "ordinal")


@query
def version_diff(s, d):
    at = t.table(s, d, "part")
    return catalog.version_diff(at.select(F.col("p_brand").alias("key")), at.where("p_size > 49").select(F.col("p_brand").alias("key")))


@query
def var_inner_join(s, d):
    return gene_ops.inner_genes(t.var(s, d))


@query
def var_outer_join(s, d):
    return gene_ops.outer_genes(t.var(s, d))


@query
def gene_vocab_flags(s, d):
    at = t.table(s, d, "part").select(F.col("p_name").alias("ensembl_gene_id"), F.col("p_brand").alias("stable_id"), F.concat(F.lit("HB"), F.col("p_size")).alias("symbol"))
    at = at.withColumn("symbol", F.when(F.col("symbol").endswith("1"), F.concat(F.lit("MT-"), "symbol")).when(F.col("symbol").endswith("2"), F.concat(F.lit("RPS"), "symbol")).otherwise(F.col("symbol")))
    return gene_ops.with_positions(gene_ops.gene_vocabulary(at, "o1"))


@query
def gene_positions(s, d):
    return gene_ops.with_positions(t.genes(s, d), gene="gene").select("gene", "organism", "pos", "start_idx")


@query
def unseen_genes(s, d):
    brand = t.genes(s, d).where("brand = 'Brand#11'")
    return gene_ops.unseen_genes(gene_ops.aligned(t.var(s, d), brand), brand).select("artifact", F.explode("unseen").alias("gene"))


@query
def join_vocabulary(s, d):
    var = t.var(s, d).select("artifact", F.col("gene").alias("var_idx"), F.concat(F.lit("G"), F.col("gene") % 500).alias("gene_id"))
    known = t.genes(s, d).where("gene < 300").select(F.concat(F.lit("G"), "gene").alias("gene_id"), "symbol")
    return gene_ops.join_vocabulary(var, known)


@query
def join_vocabulary_whole(s, d):
    """Every artifact's genes with the whole gene table."""
    var = t.var(s, d).select("artifact", F.col("gene").alias("var_idx"), F.concat(F.lit("G"), "gene").alias("gene_id"))
    return gene_ops.join_vocabulary(var, t.genes(s, d).select(F.concat(F.lit("G"), "gene").alias("gene_id"), "symbol"))


@query
def vars_sorted(s, d):
    return gene_ops.vars_sorted(t.var(s, d).withColumn("var_idx", F.when(F.col("artifact") < 5, -F.col("gene")).otherwise(F.col("gene"))))


@query
def vars_aligned(s, d):
    return gene_ops.vars_aligned(t.var(s, d), t.genes(s, d).where("organism <> 'LARGE'"))


@query
def merged_categories(s, d):
    return labels.categories(t.obs(s, d), "priority")


@query
def encode_labels(s, d):
    at = t.obs(s, d)
    return labels.encode(at, labels.encoder(at, "priority", "3-MEDIUM"), "priority").groupBy("priority", "code").agg(F.count("*").alias("n"))


@query
def decode_labels(s, d):
    at = t.obs(s, d)
    codes = labels.encoder(at, "status")
    return labels.decode(labels.encode(at, codes, "status"), codes, "code").groupBy("code", "value").agg(F.count("*").alias("n"))


@query
def combined_label_codes(s, d):
    return labels.combined_codes(t.obs(s, d), ["priority", "segment"]).select("cell", "code")


@query
def label_weights(s, d):
    return labels.label_weights(t.obs(s, d), ["priority", "status"], 10).select("label", "n", rounded("weight", 9))


@query
def class_weights(s, d):
    return labels.class_weights(t.obs(s, d), "segment", 50).select("segment", "n", rounded("weight", 9))


@query
def class_index_offsets(s, d):
    return labels.class_index(t.obs(s, d), "priority", "cell").select("priority", "cell", "pos", "offset")


@query
def artifact_gene_lists(s, d):
    return gene_ops.gene_lists(t.var(s, d)).select("artifact", "n_vars", F.md5(F.array_join(F.col("genes").cast("array<string>"), ",")).alias("genes_md5"))


@query
def merge_only_genes(s, d):
    """Genes of two tables with a column of each; ``len``, which both have, is left out."""
    part = t.table(s, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("size"), F.length("p_name").alias("len"))
    line = t.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count("*").alias("n_cells"), F.max("l_linenumber").alias("len"))
    return gene_ops.merge_only([part, line])


@query
def growing_index(s, d):
    """All cells' artifacts in a batch a region: the index, split and class index of the whole."""
    region = t.table(s, d, "nation").select(F.col("n_nationkey").alias("artifact"), F.col("n_regionkey").alias("region"))
    at, out = t.obs(s, d).join(region, "artifact"), GrowingCollection(s, f"{shared_folder(region)}/growing-{uuid.uuid4().hex}", ["priority"], ["status"], test=0.1)
    for i, r in enumerate(region.select("region").distinct().orderBy("region").collect()):
        out.append(at.where(F.col("region") == r.region), i)
    return out.cells().select("cell", "storage_idx", "obs_idx", "global_idx", "split").join(out.class_index(), "global_idx", "left")


@query
def value_counts_pct(s, d):
    return labels.value_counts(t.table(s, d, "events"), "event_type").select("event_type", "n", rounded("pct"))


@query
def top_labels(s, d):
    return labels.top_labels(t.table(s, d, "documents"), "source")


@query
def null_counts(s, d):
    at = t.table(s, d, "lineitem").select(F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("a"), F.nullif(F.col("l_returnflag"), F.lit("A")).alias("b"))
    return labels.null_counts(at, ["a", "b"])


@query
def cell_qc_metrics(s, d):
    flagged = t.genes(s, d).select("gene", (F.col("organism") == "SMALL").alias("mt"), (F.col("brand") == "Brand#11").alias("ribo"))
    out = qc.cell_metrics(t.values(s, d), flagged, ("mt", "ribo"))
    return out.select("cell", *(rounded(c) for c in out.columns if c != "cell"))


@query
def gene_qc_metrics(s, d):
    n = t.table(s, d, "orders").agg(F.count("*").alias("n"))
    out = qc.gene_metrics(t.values(s, d), n)
    return out.select("gene", *(rounded(c) for c in out.columns if c != "gene"))


@query
def mad_outliers(s, d):
    flagged = t.genes(s, d).select("gene", (F.col("organism") == "SMALL").alias("mt"))
    return qc.outliers(qc.cell_metrics(t.values(s, d), flagged, ("mt",)), 2, 1, 90).select("cell", "outlier", "mt_outlier")


@query
def filter_cells_genes(s, d):
    return qc.filter_counts(t.values(s, d), 500, 60, 3)


@query
def dataset_gates(s, d):
    at = t.obs(s, d).groupBy("artifact").agg(F.count("*").alias("n_before"), F.count_if(F.col("status") == "F").alias("n_cells"), F.count_if(F.col("priority") == "1-URGENT").alias("n_primary"))
    at = at.join(t.var(s, d).groupBy("artifact").agg(F.count("*").alias("n_genes")), "artifact")
    at = at.withColumns({"n_valid": F.col("n_genes") - 10, "organism": F.concat(F.lit("o"), F.col("artifact") % 4), "assay": F.when(F.col("artifact") == 3, "EFO:0008939").otherwise("EFO:1")})
    return qc.dataset_gates(at, ["o0", "o1", "o2"], 100, 2.05, 500, 520).select("artifact", "status", "reason")


@query
def raw_count_check(s, d):
    at = t.table(s, d, "lineitem").select(F.col("l_suppkey").alias("artifact"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_discount")).otherwise(F.col("l_quantity")).alias("value"))
    return qc.raw_check(at).select("artifact", "is_raw")


@query
def log1p_check(s, d):
    at = t.table(s, d, "lineitem").select(F.col("l_suppkey").alias("artifact"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_discount")).otherwise(F.col("l_quantity")).alias("value"))
    return qc.log1p_check(at).select("artifact", "is_log1p")


@query
def validate_obs(s, d):
    at = t.table(s, d, "customer").select((F.col("c_custkey") % 1000).alias("cell"), F.concat(F.lit("N:"), F.col("c_nationkey") * 2).alias("place_id"))
    return qc.validate(at, t.ontology(s, d), {"place_id": "place", "gone": "place"}, need_all=True)


@query
def normalize_log1p(s, d):
    return cluster.normalise(t.values(s, d)).select("cell", "gene", rounded("norm"))


@query
def length_normalize(s, d):
    lengths = t.table(s, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("length"))
    return cluster.length_normalise(t.values(s, d), lengths).select("cell", "gene", rounded("value"))


@query
def depth_norm_log2(s, d):
    at = t.cells(s, d).withColumn("depth", scalars.depth(F.col("expr")))
    at = at.select("cell", "depth", F.explode_outer("expr").alias("x"))
    return at.select("cell", "x.gene", "depth", F.round(scalars.logp1(scalars.depth_normalise(F.col("x.value"), F.col("depth"), 1e4)), 6).alias("value"))


@query
def revert_to_raw(s, d):
    at = t.cells(s, d).select("cell", scalars.revert_to_raw(F.transform("expr", lambda x: F.log2(x["value"] + 1) / 3), "logp1").alias("raw"), "expr")
    return at.select("cell", F.posexplode_outer("raw").alias("i", "raw"))


@query
def quantile_bins(s, d):
    at = select.with_bins(t.cells(s, d), 6).select("cell", F.explode_outer("bins").alias("x"))
    return at.select("cell", "x.gene", "x.bin")


@query
def topk_genes(s, d):
    at = t.cells(s, d).select("cell", F.posexplode_outer(select.most_expressed(F.col("expr"), 3)).alias("rank", "x"))
    return at.select("cell", "rank", "x.gene", "x.value")


@query
def random_genes(s, d):
    at = t.cells(s, d).select("cell", F.posexplode_outer(select.random_expressed(F.col("expr"), "cell", 2, 7)).alias("rank", "x"))
    return at.select("cell", "rank", "x.gene")


@query
def zero_fill_genes(s, d):
    n = 50
    at = t.cells(s, d).select("cell", F.transform("expr", lambda x: (x["gene"] % n).cast("int")).alias("taken"))
    at = select.with_zero_genes(at, F.lit(5), n, seed=3)
    return at.select("cell", F.posexplode_outer("zeros").alias("rank", "pos"))


@query
def zero_fill_genes_organism(s, d):
    """Unexpressed genes out of all that the organism has."""
    known = gene_ops.with_positions(t.genes(s, d), gene="gene").where("organism = 'SMALL'").select("gene", (F.col("pos") - F.col("start_idx")).cast("int").alias("taken"))
    at = t.values(s, d).join(known, "gene", "left").groupBy("cell").agg(F.collect_list("taken").alias("taken"))
    at = select.with_zero_genes(at, F.lit(5), known.count(), seed=3)
    return at.select("cell", F.posexplode_outer("zeros").alias("rank", "pos"))


@query
def ontology_ancestors(s, d):
    return ontology.closure(ontology.parent_edges(t.ontology(s, d)))


@query
def ontology_descendants(s, d):
    return ontology.descendants(ontology.parent_edges(t.ontology(s, d)), "R:2")


@query
def ancestry_groupings(s, d):
    groups, _ = ontology.groupings(t.places(s, d).where("term <> 'unknown'"), ontology.closure(ontology.parent_edges(t.ontology(s, d))))
    return groups.select("ancestor", F.explode("leafs").alias("leaf"))


@query
def hierarchy_encoder(s, d):
    return ontology.hierarchy_encoder(t.places(s, d), ontology.closure(ontology.parent_edges(t.ontology(s, d))))


@query
def labels_hierarchy(s, d):
    pairs = ontology.closure(ontology.parent_edges(t.ontology(s, d)))
    groups, _ = ontology.groupings(t.places(s, d).where("term <> 'unknown'"), pairs)
    return ontology.coded_groupings(groups, ontology.hierarchy_encoder(t.places(s, d), pairs))


@query
def translate_ids(s, d):
    at = t.table(s, d, "customer").select("c_custkey", F.concat(F.lit("N:"), F.col("c_nationkey"), F.lit(", R:"), F.col("c_custkey") % 6).alias("ids"))
    return ontology.translate(at, t.ontology(s, d), "place")


@query
def age_roll_up(s, d):
    at = t.table(s, d, "customer").select("c_custkey", F.concat(F.lit("N:"), "c_nationkey").alias("stage"), F.when(F.col("c_custkey") % 3 == 0, "NCBITaxon:9606").when(F.col("c_custkey") % 3 == 1, "NCBITaxon:10090").otherwise("x").alias("organism"))
    return ontology.roll_up_ages(at, t.ontology(s, d), {"R:0": "young", "N:7": "old", "R:3": "adult"}).select("c_custkey", "age_group")


@query
def drop_assays(s, d):
    at = t.obs(s, d).withColumn("assay", F.concat(F.lit("EFO:"), F.substring("priority", 1, 1)))
    return sampling.drop_assays(at, drop=["EFO:3", "EFO:5"]).groupBy("assay").agg(F.count("*").alias("n"))


@query
def split_train_val_test(s, d):
    return sampling.split(catalog.with_global_index(t.obs(s, d)), 0.2, 0.15).select("cell", "split")


@query
def shuffled_index(s, d):
    return sampling.shuffled_index(t.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 11)


@query
def nnz_sigmoid_weight(s, d):
    return t.cells(s, d).select("cell", F.round(scalars.nnz_weight(scalars.nnz(F.col("expr")) * 300), 9).alias("weight"))


@query
def sample_labels(s, d):
    weights = labels.class_weights(t.obs(s, d), "priority", 50).withColumnRenamed("priority", "label")
    return sampling.draw_labels(weights, 20_000, 5)


@query
def sample_labels_curriculum(s, d):
    weights = labels.class_weights(t.obs(s, d), "priority", 50).withColumnRenamed("priority", "label")
    return sampling.draw_labels(weights, 5000, 6, curriculum=(3, 20)).groupBy("label").agg(F.count("*").alias("n"))


@query
def sample_rows_uniform(s, d):
    at = t.obs(s, d).withColumnRenamed("priority", "label")
    draws = sampling.draw_labels(labels.class_weights(at, "label", 50), 5000, 5)
    return sampling.draw_rows(draws, labels.class_index(at, "label", "cell"), 5).select("draw_id", "label", "cell")


@query
def sample_rows_weighted(s, d):
    at = t.obs(s, d).withColumnRenamed("priority", "label").withColumn("weight", (F.col("cell") % 7).cast("double"))
    draws = sampling.draw_labels(labels.class_weights(at, "label", 50), 3000, 9)
    return sampling.draw_weighted(draws, at.select("label", "cell", "weight"), "cell", "weight", seed=9)


@query
def sample_rows_weighted_wor(s, d):
    at = t.obs(s, d).withColumnRenamed("priority", "label").withColumn("weight", (F.col("cell") % 7).cast("double"))
    counts = at.select("label").distinct().withColumn("n", F.lit(200))
    return sampling.draw_without_replacement(at, counts, "cell", weight="weight", seed=4).select("label", "cell", "rank")


@query
def restrict_topk(s, d):
    at = t.table(s, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("cell"), "o_totalprice")
    return sampling.restrict_top(at, 100, "o_totalprice", "cell").select("label", "cell")


@query
def rank_shard(s, d):
    at = catalog.with_global_index(t.obs(s, d))
    return sampling.rank_shard(at, at.count(), 1, 3, 30).select("cell", "global_idx")


@query
def knn6(s, d):
    return neighbors.exact_knn(t.vectors(s, d)).select("src", "dst", "rank", rounded("distance", 5))


@query
def knn6_approximate(s, d):
    """Neighbours by projection trees and descent; recall is measured in the tests."""
    return approximate.approximate_knn(t.vectors(s, d)).select("src", "dst", "rank", rounded("distance", 5))


@query
def nearest_edges(s, d):
    at = t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_quantity") - 1).alias("distance"))
    at = at.groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return neighbors.nearest_edges(at, 3).select("src", "dst", "rank")


@query
def metacell_sum(s, d):
    edges = neighbors.exact_knn(t.vectors(s, d)).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    return neighbors.metacells(t.values(s, d), edges, 0.5, 2)


@query
def knn_emit(s, d):
    edges = neighbors.exact_knn(t.vectors(s, d)).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "rank", "distance")
    at = neighbors.with_neighbours(t.cells(s, d), edges).where("knn_cells IS NOT NULL")
    return at.select("cell", F.posexplode_outer("knn_cells").alias("n", "near")).select("cell", "n", F.round(scalars.depth(F.col("near")), 6).alias("depth"))


@query
def cluster_means(s, d):
    clusters = t.obs(s, d).select("cell", F.col("segment").alias("cluster"))
    return cluster.cluster_means(t.values(s, d), clusters).select("cluster", "gene", rounded("mean", 9))


@query
def cluster_corr(s, d):
    clusters = t.obs(s, d).select("cell", F.col("segment").alias("cluster"))
    n = t.genes(s, d).count()
    return cluster.cluster_correlations(cluster.cluster_means(t.values(s, d), clusters), n).select("a", "b", rounded("corr", 9))


@query
def cluster_relabel(s, d):
    at = t.obs(s, d).select("cell", F.col("status").alias("cell_type"), F.concat("priority", F.col("artifact")).alias("cluster"))
    return cluster.relabel_clusters(at)


@query
def cluster_merge(s, d):
    at = t.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("a"), F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).groupBy("a").agg(F.avg("n").alias("m"))
    pairs = at.select("a", "m").join(at.select(F.col("a").alias("b"), F.col("m").alias("m2")), F.col("a") < F.col("b")).select("a", "b", (1 - F.abs(F.col("m") - F.col("m2"))).alias("corr"))
    types = at.select("a", F.when(F.col("a") < "4", "x").otherwise("y").alias("t"))
    return cluster.merge_map(pairs, types, 0.9)


@query
def batch_label(s, d):
    at = t.obs(s, d).withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING")))
    return cluster.batch_label(at, ["segment", "absent", "status"]).groupBy("batches").agg(F.count("*").alias("n"))


@query
def obs_remap(s, d):
    at = t.obs(s, d).select("cell", F.when(F.col("artifact") % 5 == 0, "multiethnic").otherwise("E:1").alias("eth"), F.concat("status", F.when(F.col("cell") % 3 == 0, " (cell culture)").otherwise("")).alias("ct"))
    at = at.withColumn("ti", F.when(F.col("cell") % 7 == 0, "CL:1").when(F.col("cell") % 4 == 0, "U (organoid)").otherwise("U"))
    return remap.clean_labels(at, "eth", "ct", "ti")


@query
def age_ladder(s, d):
    age = F.when(F.col("p_size") % 10 == 0, "adult").when(F.col("p_size") % 11 == 0, "x").otherwise((F.col("p_size") * 2).cast("string"))
    return t.table(s, d, "part").select("p_partkey", remap.age_ladder(age, [(80, "s80"), (60, "s60"), (40, "s40"), (20, "s20")], (4, "infant"), "child", {"adult": "a", "unknown": "unknown"}).alias("stage"))


@query
def replace_values(s, d):
    return remap.replace_values(t.table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"building": "b", "machinery": "m"}, lower=True)


def _collated(s, d, **options):
    known = gene_ops.with_positions(t.genes(s, d), gene="gene").select("gene", "organism", "pos")
    at = t.cells(s, d).join(t.obs(s, d), "cell").withColumns({"organism": F.lit("SMALL"), "code": F.substring("priority", 1, 1).cast("int")})
    return collate(at, known.where("organism = 'SMALL'"), CollateOptions(class_names=["code"], **options))


@query
def collate_batch(s, d):
    """Flagship: most expressed genes of the vocabulary, depth over all genes, scaled and logged."""
    at = _collated(s, d, how="most expr", max_len=3, logp1=True, norm_to=1e4, seed=1).select("cell", F.posexplode_outer(F.arrays_zip("genes", "x")).alias("i", "p"), F.col("class")[0].alias("code"), "depth")
    return at.select("cell", "i", F.when(F.col("p.x") > 0, F.col("p.genes")).alias("gene"), F.round("p.x", 6).alias("x"), "code", "depth")


@query
def collate_random(s, d):
    at = _collated(s, d, how="random expr", max_len=2, add_zero_genes=1, seed=1)
    return at.select("cell", F.size("x").alias("width"), F.size(F.array_distinct("genes")).alias("n_genes"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query
def collate_binned(s, d):
    at = _collated(s, d, how="most expr", max_len=4, n_bins=5)
    return at.select("cell", F.posexplode_outer("x").alias("i", "bin"))


@query
def collate_all(s, d):
    """Whole rows over the vocabulary, held without their zeros: width, sum, and the place of the first 50 in the wide row."""
    at = _collated(s, d, how="all", sparse=True)
    first = F.coalesce(F.get("places", F.array_position("x", 50.0).cast("int") - 1) + 1, F.lit(0))
    return at.select("cell", "width", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"), first.alias("first_50"))


@query
def collate_neighbours(s, d):
    """Genes by value plus the mean over neighbours, filled from what neighbours express: all that there are, of every cell that has neighbours."""
    edges = neighbors.exact_knn(t.vectors(s, d)).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    values = t.values(s, d)
    near = neighbors.with_near(values.join(edges.select(F.col("src").alias("cell")), "cell", "left_semi"), neighbors.neighbour_sums(edges, values))
    cells = near.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gene", "value", "near"))).alias("expr")).withColumn("organism", F.lit("SMALL"))
    known = gene_ops.with_positions(t.genes(s, d), gene="gene").select("gene", "organism", "pos").where("organism = 'SMALL'")
    at = collate(cells, known, CollateOptions(how="most expr", max_len=2, fill=False))
    return at.select("cell", F.posexplode("genes").alias("i", "gene"), "depth")


@query
def collate_neighbours_filled(s, d):
    """All cells that have neighbours; those with too few known genes get unexpressed ones at random."""
    edges = neighbors.exact_knn(t.vectors(s, d)).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    values = t.values(s, d)
    near = neighbors.with_near(values.join(edges.select(F.col("src").alias("cell")), "cell", "left_semi"), neighbors.neighbour_sums(edges, values))
    cells = near.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gene", "value", "near"))).alias("expr")).withColumn("organism", F.lit("SMALL"))
    known = gene_ops.with_positions(t.genes(s, d), gene="gene").select("gene", "organism", "pos").where("organism = 'SMALL'")
    at = collate(cells, known, CollateOptions(how="most expr", max_len=2))
    return at.select("cell", F.posexplode_outer("genes").alias("i", "gene"), "depth")


@query
def collate_knn_cells(s, d):
    """The most expressed genes of each cell with neighbours, and what its neighbours have of each."""
    edges = neighbors.exact_knn(t.vectors(s, d)).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "rank", "distance")
    cells = neighbors.with_neighbours(t.cells(s, d), edges).where("knn_cells IS NOT NULL").withColumns({"organism": F.lit("SMALL"), "artifact": F.col("cell") % 7})
    known = gene_ops.with_positions(t.genes(s, d), gene="gene").select("gene", "organism", "pos").where("organism = 'SMALL'")
    at = collate(cells, known, CollateOptions(how="most expr", max_len=2, dataset_name="artifact"))
    near = F.transform("genes", lambda g, i: F.aggregate("knn_cells", F.lit(0.0), lambda a, row: a + row[i]))
    at = at.select("cell", "dataset", F.posexplode(F.arrays_zip("genes", "x", near.alias("near"))).alias("i", "p")).where("p.x > 0")
    return at.select("cell", "dataset", "i", F.col("p.genes").alias("gene"), F.col("p.near").alias("near"))


@query
def primary_cells(s, d):
    at = t.obs(s, d).withColumn("is_primary_data", F.when(F.col("priority") != "5-LOW", F.col("status") == "F"))
    return qc.primary_only(at).groupBy("artifact").agg(F.count("*").alias("n"))


@query
def drop_genes(s, d):
    """A gene vocabulary without the genes of a list."""
    at = t.table(s, d, "part").select(F.concat(F.lit("G"), "p_partkey").alias("ensembl_gene_id"), F.lit(None).cast("string").alias("stable_id"), F.col("p_name").alias("symbol"))
    gone = [r.g for r in t.table(s, d, "nation").select(F.concat(F.lit("G"), F.col("n_nationkey") * 3).alias("g")).collect()]
    return gene_ops.gene_vocabulary(at, "o1", gone).select("gene_id", "symbol")


@query
def join_vocabulary_by_symbol(s, d):
    """Artifacts' genes by symbol; of a symbol's genes the first of the vocabulary counts."""
    symbols = t.genes(s, d).select("gene", "symbol")
    var = t.var(s, d).join(symbols, "gene").select("artifact", F.col("gene").alias("var_idx"), "symbol")
    known = symbols.select(F.format_string("G%08d", "gene").alias("gene_id"), "symbol")
    return gene_ops.join_vocabulary(var, known, by_symbol=True).select("artifact", "gene_id", "var_idx")


@query
def aligned_share(s, d):
    return gene_ops.aligned_pct(gene_ops.vars_aligned(t.var(s, d), t.genes(s, d).where("gene <> 7"))).select(rounded("pct_aligned"))


@query
def var_inner_join_shared(s, d):
    """Genes that all of three artifacts have; it is an error if there are none."""
    at = t.owned_values(s, d).select((F.col("artifact") % 3).alias("artifact"), "gene").distinct()
    return gene_ops.require_genes(gene_ops.inner_genes(at))


@query
def merged_labels(s, d):
    at = catalog.with_global_index(t.obs(s, d)).withColumn("segment", F.nullif("segment", F.lit("BUILDING")))
    return labels.merged_labels(at, "segment")


@query
def frequent_values(s, d):
    return labels.frequent_values(t.table(s, d, "customer"), "c_nationkey", 5).select("c_nationkey", "n")


@query
def excluding_values(s, d):
    at = t.table(s, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    return labels.excluding(at, "segment", ["BUILDING", "AUTOMOBILE"])


@query
def class_weights_excluded(s, d):
    at = labels.combined_codes(t.obs(s, d), ["priority"], "label")
    return labels.class_weights(at, "label", 50, excluded=2).select("label", "n", rounded("weight", 9))


@query
def fill_constants(s, d):
    at = t.table(s, d, "customer").select("c_custkey", "c_nationkey")
    metadata = t.table(s, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return files.fill_from_accession(at, metadata, "c_nationkey", {"name": "n_name"}, constants={"suspension_type": "cell"})


@query
def outer_concat(s, d):
    """Tables that lack columns of each other as one."""
    nation = t.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    region = t.table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"))
    return catalog.union_cells([nation, region])


@query
def choose_counts(s, d):
    """Values from the raw layer where there is one, else as they are; from the counts where these are no whole numbers."""
    at = t.table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("artifact"), F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity")).alias("value"), F.when(F.col("l_suppkey") % 4 == 0, F.col("l_quantity") + 1).alias("raw"), (F.col("l_quantity") * 2).alias("counts")
    )
    return qc.choose_counts(at).groupBy("artifact").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query
def length_normalize_assays(s, d):
    cells = t.obs(s, d).select("cell", F.when(F.col("priority") < "3", "full").alias("assay"))
    lengths = t.table(s, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("length"))
    return cluster.length_normalise_assays(t.values(s, d), cells, lengths, ["full"]).select("cell", "gene", rounded("value"))


@query
def cluster_renumber(s, d):
    """Clusters under the cluster that each goes into, renumbered within their type."""
    sizes = t.obs(s, d).groupBy(F.col("status").alias("cell_type"), F.concat_ws("_", "status", "artifact").alias("name")).agg(F.count("*").alias("n"))
    merges = sizes.where(F.col("name").endswith("1")).select(F.col("name").alias("cluster"), F.concat_ws("_", "cell_type", F.lit(0)).alias("into"))
    return cluster.renumber(sizes, merges)


@query
def metacell_cells(s, d):
    """Sparse cells of which half have their neighbours' values added."""
    edges = neighbors.exact_knn(t.vectors(s, d)).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    at = neighbors.with_metacells(t.cells(s, d), edges, 0.5, 2)
    return at.select("cell", "is_meta", F.explode("expr").alias("x")).select("cell", "is_meta", "x.gene", "x.value")


@query
def stream_windows(s, d):
    """Counts by hour and type, as the stream of arrivals gives them once all has come."""
    at = ingest.arrivals(t.table(s, d, "events"), "event_type")
    return at.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 3).alias("value"))


def _dataset(s, d):
    cells = t.cells(s, d).join(t.obs(s, d), "cell").withColumn("organism", F.lit("SMALL"))
    known = gene_ops.with_positions(t.genes(s, d), gene="gene").select("gene", "organism", "pos").where("organism = 'SMALL'")
    sizes = t.table(s, d, "nation").select(F.col("n_nationkey").alias("artifact"), ((F.col("n_nationkey") + 1) * 1000).alias("bytes"))
    return CellDataset(cells, known, predict=["priority", "segment"], sizes=sizes)


@query
def dataset_summary(s, d):
    return _dataset(s, d).summary().select("n_cells", "n_artifacts", "n_organisms", "n_genes", "n_classes", "n_labels", rounded("size_gb", 9))


@query
def class_sizes(s, d):
    return _dataset(s, d).class_sizes()


@query
def row_lookup(s, d):
    return _dataset(s, d).row(17).select("cell", "artifact", "global_idx", F.size("expr").alias("nnz"))


@query
def gene_list(s, d):
    """Rows of the genes in a list."""
    few = [r.gene for r in t.genes(s, d).where("organism = 'SMALL'").select("gene").orderBy("gene").limit(5).collect()]
    at = _collated(s, d, how="some", genelist=few)
    return at.select("cell", F.posexplode(F.arrays_zip("genes", "x")).alias("i", "p")).select("cell", "i", F.col("p.genes").alias("gene"), F.col("p.x").alias("x"))


@query
def loader_splits(s, d):
    """What the validation and test loaders give, and both shards of the prediction loader: each cell's split and sum."""
    dataset = _dataset(s, d)
    dataset.store()  # four loaders read the cells
    module = DataModule(dataset, ["priority"], LoaderOptions(validation=0.2, test=0.15), CollateOptions(how="all", extra=(), sparse=True))
    module.setup()
    parts = [module.validation(), module.test(), module.predict(0, 2), module.predict(1, 2)]
    names = ["validation", "test", "train", "train"]
    rows = [p.select("cell", F.lit(n).alias("split"), F.col("class")[0].alias("code"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total")) for p, n in zip(parts, names, strict=True)]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query
def loader_epoch(s, d):
    """An epoch's draws by the training loader: classes by weight, rows within them."""
    module = DataModule(_dataset(s, d), ["priority"], LoaderOptions(n_samples=3000, validation=0.2, test=0.15, seed=42), CollateOptions(how="most expr", max_len=3))
    module.setup()
    return module.draws(1)


@query
def pca_centered(s, d):
    out = cluster.pca(t.vectors(s, d), "vector", 4)
    return out.select("row", *(F.round(F.col("pca")[i], 6).alias(f"pc{i}") for i in range(4)))


@query
def stored_epoch(s, d):
    """An epoch's draws and their cells, which lie in buckets of the global index."""
    dataset = _dataset(s, d)
    dataset.store(buckets=4)
    module = DataModule(dataset, ["priority"], LoaderOptions(n_samples=3000, validation=0.2, test=0.15, seed=42), CollateOptions(how="most expr", max_len=3))
    module.setup()
    return module.train(1).select("draw_id", "cell", F.col("class")[0].alias("code"), rounded("depth"))


@query
def stored_lookup(s, d):
    """One cell by its global index, from one bucket."""
    dataset = _dataset(s, d)
    dataset.store(buckets=4)
    return dataset.row(23).select("cell", "artifact", "global_idx", F.size("expr").alias("nnz"))


@query
def artifact_components(s, d):
    """Three components of each artifact's cells over its own variable genes; held against NumPy in the tests."""
    normed = cluster.normalise(t.values(s, d)).select("cell", "gene", F.col("norm").alias("value"))
    obs = t.obs(s, d)
    genes = cluster.variable_genes(normed, obs, 200, by="artifact").select("artifact", "gene")
    out = components.artifact_components(normed, obs, genes, 3)
    return out.select("artifact", "cell", *(F.round(F.col("pca")[i], 4).alias(f"pc{i}") for i in range(3)))


@query
def hvg_rank(s, d):
    normed = cluster.normalise(t.values(s, d)).select("cell", "gene", F.col("norm").alias("value"))
    return cluster.variable_genes(normed, t.obs(s, d), 200).select("gene", "rank")


@query
def graph_communities(s, d):
    return cluster.propagate_labels(neighbors.exact_knn(t.vectors(s, d)).select("src", "dst"), 3)


@query
def leiden_communities(s, d):
    """Communities of the neighbour graph by modularity; held against a plain Louvain in the tests."""
    return leiden.leiden(neighbors.exact_knn(t.vectors(s, d)).select("src", "dst"), rounds=6, levels=3)
