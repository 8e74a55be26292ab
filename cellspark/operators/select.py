"""Selection of genes within a sparse cell, without a shuffle. ``expr``: array<struct<gene, value>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digitize, hash_key, quantile_edges, uniform
from .numbering import gathered


def summed(coo: DataFrame, rows: int | None = None) -> DataFrame:
    """cell, gene, value: the sums of equal genes, those of a cell in one partition. ``rows`` is the number of rows if it is known."""
    return gathered(coo, "cell", rows=rows).groupBy("cell", "gene").agg(F.sum("value").alias("value"))


def to_cells(coo: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per cell from rows (cell, gene, value); equal genes are summed, zeros are left out. Values are shuffled once, by cell."""
    once = summed(coo, rows).where("value != 0")
    return once.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("expr"))


def most_expressed(expr: Column, k: int) -> Column:
    """The ``k`` largest values, ties by gene; cells with fewer give all they have."""
    keyed = F.transform(F.filter(expr, lambda x: x["value"] > 0), lambda x: F.struct((-x["value"]).alias("v"), x["gene"].alias("gene")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["gene"].alias("gene"), (-x["v"]).alias("value")))


def most_expressed_with_neighbours(expr: Column, k: int, n: int = 6) -> Column:
    """The ``k`` genes of largest value plus mean over ``n`` neighbours (``near`` holds their sum), largest first."""
    score = lambda x: -(x["value"] + x["near"] / n)
    keyed = F.transform(F.filter(expr, lambda x: score(x) < 0), lambda x: F.struct(score(x).alias("v"), x["gene"].alias("gene"), x["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["gene"].alias("gene"), x["value"].alias("value")))


def by_neighbours(expr: Column) -> Column:
    """The genes that neighbours express, by their sum, largest first."""
    keyed = F.transform(F.filter(expr, lambda x: x["near"] > 0), lambda x: F.struct((-x["near"]).alias("v"), x["gene"].alias("gene"), x["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["gene"].alias("gene"), x["value"].alias("value")))


def densified(expr: Column, width: Column) -> Column:
    """The values of genes 0 .. width - 1; ``expr`` is a column of its own, sorted by gene, which is a number."""
    gaps = F.zip_with(
        expr,
        F.concat(F.transform(F.slice(expr, 2, 1 << 30), lambda x: x["gene"].cast("int")), F.array(width.cast("int"))),
        lambda x, after: F.concat(F.array(x["value"]), F.array_repeat(F.lit(0.0), (after - x["gene"] - 1).cast("int"))),
    )
    first = F.coalesce(F.try_element_at(expr, F.lit(1))["gene"].cast("int"), width.cast("int"))
    return F.when(F.size(expr) == 0, F.array_repeat(F.lit(0.0), width.cast("int"))).otherwise(F.concat(F.array_repeat(F.lit(0.0), first), F.flatten(gaps)))


def random_expressed(expr: Column, cell: str, k: int, seed: int = 0) -> Column:
    """``k`` expressed genes in seeded random order."""
    keyed = F.transform(F.filter(expr, lambda x: x["value"] > 0), lambda x: F.struct(hash_key(seed, F.col(cell), x["gene"]).alias("h"), x["gene"].alias("gene"), x["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["gene"].alias("gene"), x["value"].alias("value")))


def with_zero_genes(cells: DataFrame, need: Column, n_genes: int | Column, cell: str = "cell", seed: int = 0, probes: int = 64, out: str = "zeros") -> DataFrame:
    """Add ``need`` positions (0 .. n_genes - 1) of unexpressed genes to each cell, at random.

    ``cells`` has ``taken``, the positions of expressed genes. Some positions are drawn by hash and those
    that are taken or drawn before are left out; a cell for which too few are left orders all its unexpressed
    positions by hash instead. Cells with fewer unexpressed genes get all. No cell meets the whole
    vocabulary but these.
    """
    n_genes = F.lit(n_genes) if isinstance(n_genes, int) else n_genes
    draws = lambda n: F.array_except(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.floor(uniform(seed, F.col(cell), i) * n_genes).cast("int"))), F.col("taken"))
    # The first free draws are the same of few probes as of all, so most cells make hardly more than they need: a draw is a hash.
    some = lambda n: draws(F.least(F.lit(probes), n))
    at = cells.withColumn("__need", F.greatest(need, F.lit(0)).cast("int"))
    at = at.withColumn("__drawn", F.when(F.col("__need") > 0, some(F.col("__need") + 1)).otherwise(F.array().cast("array<int>")))
    at = at.withColumn("__drawn", F.when(F.size("__drawn") >= F.col("__need"), F.col("__drawn")).otherwise(some(F.col("__need") * 2 + 2)))
    free = F.array_except(F.sequence(F.lit(0), n_genes.cast("int") - 1), F.col("taken"))
    ordered = F.transform(F.array_sort(F.transform(free, lambda g: F.struct(hash_key(seed, F.col(cell), g).alias("h"), g.alias("g")))), lambda x: x["g"])
    enough = lambda x: F.size(x) >= F.col("__need")
    every = draws(F.lit(probes))
    chosen = F.when(enough(F.col("__drawn")), F.col("__drawn")).when(enough(every), every).otherwise(ordered)
    return at.withColumn(out, F.slice(chosen, F.lit(1), F.col("__need"))).drop("__need", "__drawn")


def with_bins(cells: DataFrame, n_bins: int, expr: str = "expr", bins: str = "bins", edges: str = "bin_edges") -> DataFrame:
    """Add quantile bins of a cell's non-zero values (1 .. n_bins - 1) and the edges, 0 first.

    Edges are ``n_bins - 1`` linear quantiles; a value's bin is the number of edges at most as large. Cells
    without values have no bins and ``n_bins`` zero edges.
    """
    at = cells.withColumn("__sorted", F.array_sort(F.transform(F.filter(expr, lambda x: x["value"] != 0), lambda x: x["value"])))
    at = at.withColumn("__edges", quantile_edges(F.col("__sorted"), n_bins - 1))
    binned = F.transform(expr, lambda x: F.struct(x["gene"].alias("gene"), F.when(x["value"] == 0, F.lit(0).cast("long")).otherwise(digitize(x["value"], F.col("__edges"))).alias("bin")))
    full = F.when(F.size("__edges") > 0, F.concat(F.array(F.lit(0.0)), "__edges")).otherwise(F.array_repeat(F.lit(0.0), n_bins))
    return at.withColumns({bins: binned, edges: full}).drop("__sorted", "__edges")
