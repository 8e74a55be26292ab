"""Gene vocabularies and the alignment of artifacts to them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_cells(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables as one by their columns' names; what a table lacks is null there."""
    if not tables:
        raise ValueError("a collection needs at least one artifact")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def gene_vocabulary(genes: DataFrame, organism: str | None, drop: Sequence[str] = (), case_insensitive: bool = False) -> DataFrame:
    """The genes of one organism: id (else stable id), first of equal ids by symbol, flags, constant organism (None: that of the rows).

    ``mt``: symbols that begin with MT-; ``ribo``: with RPS or RPL; ``hb``: HB and a character
    other than "(", "P" and ")". ``drop`` lists gene ids that are left out.
    """
    at = genes.withColumn("gene_id", F.coalesce("ensembl_gene_id", "stable_id")).where(F.col("gene_id").isNotNull())
    first = Window.partitionBy("gene_id").orderBy("symbol")
    at = at.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if drop:
        at = at.join(F.broadcast(genes.sparkSession.createDataFrame([(g,) for g in drop], "gene_id string")), "gene_id", "left_anti")
    symbol = F.upper("symbol") if case_insensitive else F.col("symbol")
    flags = {"mt": symbol.startswith("MT-"), "ribo": symbol.startswith("RPS") | symbol.startswith("RPL"), "hb": symbol.rlike("^HB[^(P)]")}
    return at.select("gene_id", "symbol", F.lit(organism).alias("organism") if organism is not None else F.col("organism"), *(F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()))


def with_positions(vocabulary: DataFrame, organism: str = "organism", gene: str = "gene_id") -> DataFrame:
    """Add ``pos``, the gene's token id over all organisms, and ``start_idx``, its organism's first."""
    pos = F.row_number().over(Window.orderBy(organism, gene)) - 1
    return vocabulary.withColumn("pos", pos).withColumn("start_idx", F.min("pos").over(Window.partitionBy(organism)))


def inner_genes(var: DataFrame, artifact: str = "artifact", gene: str = "gene") -> DataFrame:
    """Genes that all artifacts have. An empty result means that the artifacts cannot be aligned."""
    pairs = var.select(artifact, gene).distinct()
    n = pairs.select(F.count_distinct(artifact).alias("n"))
    by = pairs.groupBy(gene).agg(F.count("*").alias("n_artifacts"))
    return by.join(F.broadcast(n), F.col("n_artifacts") == F.col("n"), "left_semi").select(gene)


def require_genes(shared: DataFrame) -> DataFrame:
    """``shared`` as it is; without a gene the artifacts cannot be aligned, which is an error."""
    if shared.isEmpty():
        raise ValueError("the artifacts have no gene in common; use an outer join")
    return shared


def outer_genes(var: DataFrame, artifact: str = "artifact", gene: str = "gene") -> DataFrame:
    """Genes that any artifact has, and how many do. Sparse cells need no zeros for the others."""
    return var.select(artifact, gene).distinct().groupBy(gene).agg(F.count("*").alias("n_artifacts"))


def merge_only(vars_: Sequence[DataFrame], gene: str = "gene") -> DataFrame:
    """The genes of all tables, with the columns that one table alone has; columns of two or more are left out, as they may disagree.

    A gene that the column's table lacks is null there. A table's repeated genes count once, with their least values.
    """
    if not vars_:
        raise ValueError("there are no tables of genes")
    held = Counter(c for v in vars_ for c in v.columns if c != gene)
    own = [[c for c in v.columns if held[c] == 1] for v in vars_]
    # A row for each table's gene, then one for each gene: a single shuffle however many tables there are.
    rows = union_cells([v.select(gene, *(f"`{c}`" for c in columns)) for v, columns in zip(vars_, own, strict=True)])
    return rows.groupBy(gene).agg(*(F.min(f"`{c}`").alias(c) for columns in own for c in columns)) if any(own) else rows.distinct()


def gene_lists(var: DataFrame, artifact: str = "artifact", gene: str = "gene", order: str | None = None) -> DataFrame:
    """``genes`` of each artifact in the order of ``order`` (by default of themselves), and their number ``n_vars``."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order or gene).alias("o"), F.col(gene).alias("g"))))
    return var.groupBy(artifact).agg(F.transform(pairs, lambda p: p["g"]).alias("genes"), F.count("*").alias("n_vars"))


def aligned(coo: DataFrame, genes: DataFrame, gene: str = "gene") -> DataFrame:
    """The values of the given genes alone."""
    return coo.join(genes.select(gene), gene, "left_semi")


def join_vocabulary(var: DataFrame, vocabulary: DataFrame, by_symbol: bool = False) -> DataFrame:
    """Inner join by gene id; or by symbol, of which the vocabulary's first gene id counts. Of genes that an
    artifact holds twice the first place stays."""
    known = vocabulary.select(F.col("gene_id").alias("__id"), F.col("symbol").alias("__symbol"))
    if by_symbol:
        known = known.groupBy("__symbol").agg(F.min("__id").alias("__id"))
    key = F.col("symbol") == F.col("__symbol") if by_symbol else F.col("gene_id") == F.col("__id")
    at = var.join(known, key).withColumn("gene_id", F.col("__id")).drop("__id", "__symbol")
    first = F.row_number().over(Window.partitionBy("artifact", "gene_id").orderBy("var_idx"))
    return at.withColumn("__n", first).where("__n = 1").drop("__n")


def unseen_genes(var: DataFrame, vocabulary: DataFrame, artifact: str = "artifact", gene: str = "gene") -> DataFrame:
    """``unseen``: the vocabulary's genes that an artifact lacks; their values are zero."""
    seen = var.groupBy(artifact).agg(F.collect_set(gene).alias("seen"))
    known = vocabulary.agg(F.array_sort(F.collect_set(gene)).alias("known"))
    return seen.join(F.broadcast(known), how="inner").select(artifact, F.array_except("known", "seen").alias("unseen"))


def vars_sorted(var: DataFrame, artifact: str = "artifact", gene: str = "gene", order: str = "var_idx", ascending: bool = True) -> DataFrame:
    """Whether each artifact's genes are in order."""
    before = F.lag(gene).over(Window.partitionBy(artifact).orderBy(order))
    good = before.isNull() | ((before < F.col(gene)) if ascending else (before > F.col(gene)))
    return var.select(artifact, good.alias("good")).groupBy(artifact).agg(F.bool_and("good").alias("is_sorted"))


def vars_aligned(var: DataFrame, vocabulary: DataFrame, artifact: str = "artifact", gene: str = "gene") -> DataFrame:
    """Genes of each artifact and how many of them the vocabulary lacks; ``aligned`` if none."""
    known = vocabulary.select(gene, F.lit(True).alias("__known"))
    by = var.select(artifact, gene).distinct().join(known, gene, "left").groupBy(artifact)
    out = by.agg(F.count("*").alias("n_genes"), F.count_if(F.col("__known").isNull()).alias("n_outside"))
    return out.withColumn("aligned", F.col("n_outside") == 0)


def aligned_pct(checked: DataFrame) -> DataFrame:
    return checked.agg((100 * F.avg(F.col("aligned").cast("int"))).alias("pct_aligned"))
