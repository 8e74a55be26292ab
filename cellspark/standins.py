"""The test tables in the roles of the data model.

orders are cells, parts genes, the sum of l_quantity by order and part the values; a customer's nation is the
artifact, nations and regions are an ontology, embeddings a neighbour space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.select import summed, to_cells


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """cell, gene, value, of which some come more than once, and the number of rows, which is in the files' footers"""
    at = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value"))
    return at, at.count()


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, value"""
    return summed(*measured(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, expr"""
    return to_cells(*measured(spark, sf_dir))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, artifact, priority, status, segment"""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("artifact"), F.col("c_mktsegment").alias("segment"))
    at = table(spark, sf_dir, "orders").join(own, "o_custkey")
    return at.select(F.col("o_orderkey").alias("cell"), "artifact", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "segment")


def owned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, value, artifact"""
    return values(spark, sf_dir).join(obs(spark, sf_dir).select("cell", "artifact"), "cell")


def var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact, gene: the genes that an artifact's cells express"""
    return owned_values(spark, sf_dir).select("artifact", "gene").distinct()


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, symbol, organism, brand"""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("symbol"), F.col("p_type").alias("organism"), F.col("p_brand").alias("brand"))


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, ontology_id, name, parents: nations below regions below one root"""
    nation = table(spark, sf_dir, "nation").select(
        F.lit("place").alias("kind"), F.concat(F.lit("N:"), "n_nationkey").alias("ontology_id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("R:"), "n_regionkey")).alias("parents")
    )
    region = table(spark, sf_dir, "region").select(F.lit("place").alias("kind"), F.concat(F.lit("R:"), "r_regionkey").alias("ontology_id"), F.col("r_name").alias("name"), F.array(F.lit("ROOT")).alias("parents"))
    return nation.unionByName(region)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term: the nations of customers, and one region, as labels"""
    nations = table(spark, sf_dir, "customer").select(F.concat(F.lit("N:"), "c_nationkey").alias("term")).distinct()
    return nations.union(spark.createDataFrame([("R:1",), ("unknown",)], "term string"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact, row, vector"""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("artifact"), F.col("vec_id").alias("row"), F.col("embedding").alias("vector"))
