"""Places within groups of any size: counted in two levels, so that a hot group is many tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task may number.
PART_ROWS = 1 << 20
#: A table goes to every task only after its rows were counted and found to be this many at most.
SMALL_ROWS = 200_000
#: Rows that one task is meant to gather by keys, where there are many.
GATHER_ROWS = 1 << 18


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it is small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def many(rows: int | None) -> bool:
    """Whether rows are so many that partitions must follow their number."""
    return rows is not None and rows > 16 * GATHER_ROWS


def gathered(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows of equal ``keys`` in one partition, so that groups, windows and joins by these, alone or with others, shuffle them no more.

    With their number ``rows``, partitions of a large table are as many as keep about GATHER_ROWS in one: adaptive execution joins partitions by
    their packed size, of which a task holds many times as much.
    """
    if not many(rows):
        return df.repartition(*keys)
    # Fewer than the session's would be shuffled again by a join.
    return df.repartition(max(-(-rows // GATHER_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_folder(df: DataFrame) -> str:
    """The folder for checkpoints that all of the cluster shares. Where none is set, a local session takes a temporary
    one; on a cluster that is an error, as plans of rounds would double without it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if (base := df.sparkSession.conf.get("spark.checkpoint.dir", None)) is not None:
            sc.setCheckpointDir(base)
        elif sc.master == "local" or sc.master.startswith("local["):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_folder(df)
    return df.checkpoint()


class Stored:
    """Tables of an iteration, written in the shared folder and read back as plain scans.

    Unlike a checkpoint, a scan carries none of the conditions that held in the plan before, which would grow from round to round.
    """

    def __init__(self, df: DataFrame):
        self.spark, self.base, self.n = df.sparkSession, f"{shared_folder(df)}/stored-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that nothing reads any more; others are left alone."""
        for table in tables:
            if (path := self.paths.pop(id(table), None)) is not None:
                self._delete(path)

    def clear(self) -> None:
        """Delete the files of all tables."""
        self.paths.clear()
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def ranges(df: DataFrame, index: str, rows: int = PART_ROWS) -> Column:
    """A number for each stretch of about ``rows`` rows in the order of a numeric ``index``, whatever its gaps; nulls are in the first.

    Stretches end at quantiles of the index, found in one pass; only rows of equal index stay together. A row finds its stretch by
    bisection. Other types than numbers are stretches of hashes instead, in which case the order is that of hashes first.
    """
    if not isinstance(df.schema[index].dataType, T.NumericType):
        n = df.count()
        return F.pmod(F.xxhash64(index), F.lit(-(-n // rows) or 1)).cast("long")
    parts = -(-df.where(F.col(index).isNotNull()).count() // rows)
    if parts <= 1:
        return F.lit(0).cast("long")
    x = F.col(index).cast("double")
    found = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first().q
    ends = sorted(set(found))
    steps = len(ends).bit_length()
    padded = F.array(*(F.lit(float(e)) for e in [*ends, *([float("inf")] * ((1 << steps) - len(ends)))]))
    # The number of ends that lie below the row, bit by bit, the largest first; NaN lies above all.
    step = lambda lo, half: lo + F.when(F.get(padded, lo + half - 1) < x, half).otherwise(0)
    return F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(steps)))), F.lit(0), step).cast("long")


def numbered(df: DataFrame, keys: Sequence[str], part: Column, order: Sequence[str | Column], out: str = "pos", counted: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Add ``out``, each row's place from 0 within ``keys``, in the order of ``part`` and then ``order``. Parts are counted over ``counted``, the same
    rows without what numbering does not need, if given. Of many ``rows`` (their number) parts lie in partitions that follow it.

    Rows are numbered within (keys, part); where parts begin comes from a table of their counts. Rows with
    a null key are left out.
    """
    at = df.withColumn("__part", part)
    counts = (at if counted is None else counted.withColumn("__part", part)).groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    at = gathered(at, *keys, "__part", rows=rows) if many(rows) else at
    return at.withColumn("__inner", inner).join(starts, [*keys, "__part"]).withColumn(out, F.col("__start") + F.col("__inner")).drop("__part", "__inner", "__start")


def running_sums(df: DataFrame, keys: Sequence[str], value: str, part: Column, order: Sequence[str | Column], lo: str = "lo", hi: str = "hi", total: str = "total") -> DataFrame:
    """Add the sums of ``value`` before and up to each row within ``keys``, and over all of them, in two levels as :func:`numbered`."""
    at = df.withColumn("__part", part)
    sums = at.groupBy(*keys, "__part").agg(F.sum(value).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    inner = F.sum(value).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumn("__inner", inner).join(starts, [*keys, "__part"]).withColumn(hi, F.col("__start") + F.col("__inner"))
    return at.withColumn(lo, F.col(hi) - F.col(value)).drop("__part", "__inner", "__start")
