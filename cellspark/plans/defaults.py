"""The hooks that preprocessing takes by default: cleaned labels before it, neighbours, clusters and ages after it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, neighbors, ontology, remap
from ..operators.approximate import approximate_knn
from ..operators.leiden import leiden
from ..operators.numbering import cut, small

RESOLUTIONS = (2.0, 1.0, 0.5)
MIN_CELLS, MAX_SIMILARITY = 10, 0.94


def clean_before(obs: DataFrame) -> DataFrame:
    """Vague ethnicities, culture and organoid marks, and cell types as tissues (see :func:`remap.clean_labels`), for the columns that are there."""
    there = lambda c: c if c in obs.columns else None
    return remap.clean_labels(obs, there("self_reported_ethnicity_ontology_term_id"), there("cell_type_ontology_term_id"), there("tissue_ontology_term_id"))


def cluster_names(cells: DataFrame, coo: DataFrame, n_genes: int, cell_type: str = "cell_type_ontology_term_id", group: str = "leiden_1", artifact: str = "artifact") -> DataFrame:
    """``cell`` and ``clust_cell_type``: clusters of each artifact and cell type, named by size; those whose mean values correlate above
    MAX_SIMILARITY within a type are merged, and what is left is numbered again.

    Clusters of different artifacts are not compared; ``coo`` holds cell, gene, value.
    """
    owner = F.concat_ws("|", F.col(artifact).cast("string"), F.col(cell_type))
    at = cells.select("cell", owner.alias("type"), F.concat_ws("_", owner, F.col(group).cast("string")).alias("cluster"))
    named = cluster.relabel_clusters(at, "type", "cluster", MIN_CELLS)
    of_cell = cut(at.join(small(named.select("type", "cluster", "name")), ["type", "cluster"]).select("cell", "type", "name"))
    sizes = of_cell.groupBy("type", "name").agg(F.count("*").alias("n"))
    means = cluster.cluster_means(coo, of_cell.select("cell", F.col("name").alias("cluster")))
    types = sizes.select(F.col("name").alias("cluster"), "type")
    merges = cluster.merge_map(cluster.cluster_correlations(means, n_genes, types), types.select("cluster", "type"), MAX_SIMILARITY)
    final = cluster.renumber(sizes, merges, "type", "name")
    # The artifact only kept types of different artifacts apart.
    return of_cell.join(small(final), ["type", "name"]).select("cell", F.regexp_replace("final", r"^[^|]*\|", "").alias("clust_cell_type"))


def after_with(coo: DataFrame, ontologies: DataFrame, stages: Mapping[str, str], n_genes: int, k: int = 15, approximate: bool = False, by_modularity: bool = False) -> Callable[[DataFrame], DataFrame]:
    """The hook for preprocessed cells with ``pca``: ``leiden_<resolution>`` communities of their nearest neighbours, ``clust_cell_type``
    and ``age_group`` (by ``stages``: a stage's group). ``coo`` holds the values; neighbours are sought within an artifact, exactly or,
    for large artifacts, ``approximate``; communities are taken by label propagation or, in more rounds, ``by_modularity``."""

    def hook(cells: DataFrame) -> DataFrame:
        find = approximate_knn if approximate else neighbors.exact_knn
        edges = cut(find(cells.select("artifact", "cell", "pca"), k, row="cell", vector="pca"))
        out = cells
        for resolution in RESOLUTIONS:
            links = edges.select("src", "dst")
            found = (leiden(links, resolution) if by_modularity else cluster.propagate_labels(links, 6, resolution)).select(F.col("src").alias("cell"), "label")
            out = out.join(found, "cell", "left").withColumn(f"leiden_{resolution:g}", F.coalesce("label", "cell")).drop("label")
        out = cut(out)
        names = cluster_names(out, coo.join(out.select("cell"), "cell", "left_semi"), n_genes)
        out = out.join(names, "cell", "left")
        if "development_stage_ontology_term_id" in out.columns:
            out = ontology.roll_up_ages(out, ontologies, dict(stages), "development_stage_ontology_term_id")
        return out

    return hook
