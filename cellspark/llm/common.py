"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows and bytes were counted and found to be this many at most.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a local
    master (as in tests); a cluster has none that all of it could read, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one operator in the shared folder, each dropped when no later step reads it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, shared_dir(spark)
        self.held: dict[int, tuple[DataFrame, str]] = {}
        self.made = 0

    def write(self, df: DataFrame, name: str, compression: str = "snappy", block: int = 128 << 20) -> DataFrame:
        """``df`` written as Parquet, in row groups of about ``block`` bytes, and read back.

        This cuts the lineage: the table outlives lost executors, its readers start from a plain scan,
        and both sides of a later join get an exchange of their own, which adaptive execution can split.
        """
        self.made += 1
        path = f"{self.base}/{self.made}-{name}"
        df.write.option("compression", compression).option("parquet.block.size", block).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete the files of tables that were written here; anything else is left alone."""
        for table_ in tables:
            held = self.held.pop(id(table_), None)
            if held is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(held[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in a new shared folder and read it back (see :meth:`Scratch.write`)."""
    return Scratch(df.sparkSession).write(df, name)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it has few rows and bytes; else leave the join to shuffle."""
    held = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(df) if held.n <= rows and (held.b or 0) <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
