"""Small sources and sinks: gene tables from delimited text, lists of lines, metadata tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_gene_table(spark: SparkSession, path: str, gene: str = "ensembl_gene_id", symbol: str = "hgnc_symbol") -> DataFrame:
    """A tab-separated gene table: rows without gene id are dropped, a missing symbol becomes the id."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.where(F.col(gene).isNotNull()).withColumn(symbol, F.coalesce(symbol, gene))


def cached_gene_table(spark: SparkSession, source: str | Callable[[], DataFrame], cache: str, attributes: Sequence[str] = (), use_cache: bool = True, gene: str = "ensembl_gene_id", symbol: str = "hgnc_symbol") -> DataFrame:
    """A gene table as :func:`read_gene_table` gives it, with the gene, its symbol and ``attributes`` (none: all columns), kept as Parquet at ``cache``.

    ``source`` is a tab-separated file, or gives the table when it is called. With ``use_cache`` what lies at ``cache`` is taken if it holds all that
    is asked for, and the source is not looked at; otherwise the whole source is read and the cache written anew. An attribute that
    the source lacks raises.
    """
    wanted = [gene, symbol, *(a for a in attributes if a not in (gene, symbol))]
    held = None
    if use_cache:
        try:
            held = spark.read.parquet(cache)
        except AnalysisException:
            held = None
    if held is None or set(wanted) - set(held.columns):
        rows = source() if callable(source) else spark.read.csv(source, sep="\t", header=True)
        if lacking := [c for c in wanted if c not in rows.columns]:
            raise ValueError(f"the source has no {lacking}")
        rows.write.mode("overwrite").parquet(cache)
        held = spark.read.parquet(cache)
    at = held.where(F.col(f"`{gene}`").isNotNull()).withColumn(symbol, F.coalesce(F.col(f"`{symbol}`"), F.col(f"`{gene}`")))
    return at.select(*(f"`{c}`" for c in wanted)) if attributes else at


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of metadata as text; quotes inside fields are kept."""
    return spark.read.csv(path, header=True, quote="\u0000", inferSchema=False)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "item")


def write_list(items: DataFrame, path: str, column: str = "item") -> None:
    """One line for each item, as text."""
    items.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def fill_from_accession(obs: DataFrame, metadata: DataFrame, key: str, columns: dict[str, str], unknown: str = "unknown", constants: dict[str, str] | None = None) -> DataFrame:
    """Give each row the metadata of its accession (new name: metadata column) and constant columns."""
    named = metadata.select(F.col(key).alias("__key"), *(F.col(v).alias(f"__{k}") for k, v in columns.items()))
    out = obs.join(named, F.col(key) == F.col("__key"), "left")
    out = out.withColumns({k: F.coalesce(f"__{k}", F.lit(unknown)) for k in columns} | {k: F.lit(v) for k, v in (constants or {}).items()})
    return out.drop("__key", *(f"__{k}" for k in columns))
