"""Artifacts and collections: a collection is an ordered list of artifacts, its cells their union."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.genes import union_cells
from ..operators.numbering import Stored, gathered, many, ranges, small
from .zarr import read_zarr

#: Suffixes that :func:`read_cells` can read.
SUFFIXES = (".parquet", ".zarr")
BLOCK_CELLS, BLOCK_BYTES = 30_000, 2.5e9


def members(artifacts: DataFrame, collection: DataFrame, key: str, latest: bool = True) -> DataFrame:
    """The artifacts of a collection with a readable suffix, and their place in it as ``ordinal``; others are left out, as a
    collection may hold files of further formats."""
    chosen = collection.where(F.col("collection_key") == key).select("artifact_id", "ordinal")
    out = artifacts.join(F.broadcast(chosen) if chosen.limit(100_001).count() <= 100_000 else chosen, "artifact_id")
    return out.where(F.col("suffix").isin(*SUFFIXES) & (F.col("is_latest") | F.lit(not latest)))


def read_cells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The cells of Parquet and zarr artifacts (by their suffix); columns that some lack are null there."""
    out = union_cells([read_zarr(spark, p).drop("obs_idx") if p.rstrip("/").endswith(".zarr") else spark.read.parquet(p) for p in paths])
    check_rows(out)
    return out


def check_rows(cells: DataFrame) -> None:
    """Cells lie by row; a table by column (``indptr``) is refused."""
    if "indptr" in cells.columns:
        raise ValueError("column-compressed matrices are not supported; store one row per cell")


def with_global_index(obs: DataFrame, artifact: str = "artifact", cell: str = "cell", ids: DataFrame | None = None) -> DataFrame:
    """Add ``storage_idx``, ``obs_idx`` and ``global_idx``: the artifact's place, the cell's in it, and over all.

    Cells are numbered within stretches of their artifact; where these begin comes from a table with a row for each, so no window spans
    all cells of a large artifact. Stretches are counted over ``ids`` (the same artifacts and cells, of which a written table is made if none is
    given), so that whole rows are read and shuffled once.
    """
    ids = Stored(obs)(obs.select(artifact, cell)) if ids is None else ids
    part = ranges(ids, cell)
    counts = ids.groupBy(artifact, part.alias("__part")).agg(F.count("*").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.orderBy(artifact, "__part")
    starts = counts.select(
        artifact,
        "__part",
        (F.dense_rank().over(Window.orderBy(artifact)) - 1).alias("storage_idx"),
        upto(Window.partitionBy(artifact).orderBy("__part")).alias("__in"),
        upto(every).alias("__over"),
    )
    inner = F.row_number().over(Window.partitionBy(artifact, "__part").orderBy(cell)) - 1
    at, rows = obs.withColumn("__part", part), ids.count()
    at = (gathered(at, artifact, "__part", rows=rows) if many(rows) else at).withColumn("__inner", inner).join(small(starts), [artifact, "__part"])
    return at.withColumns({"obs_idx": F.col("__in") + F.col("__inner"), "global_idx": F.col("__over") + F.col("__inner")}).select(*obs.columns, "obs_idx", "storage_idx", "global_idx")


def slice_members(artifacts: DataFrame, only: tuple[int, int] | None = None, organisms: str = "n_organisms") -> DataFrame:
    """Artifacts from ordinal ``only[0]`` up to ``only[1]`` that hold one organism."""
    out = artifacts.where(F.col(organisms) == 1)
    return out if only is None else out.where(F.col("ordinal").between(only[0], only[1] - 1))


def with_blocks(cells: DataFrame, sizes: DataFrame, artifact: str = "artifact", block_bytes: float = BLOCK_BYTES, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Add ``block_id`` to cells of artifacts larger than two blocks. ``sizes``: artifact, bytes, n.

    An artifact is cut into ceil(bytes / block_bytes) blocks of equal numbers of cells.
    """
    blocks = F.when(F.col("bytes") > 2 * block_bytes, F.ceil(F.col("bytes") / block_bytes)).otherwise(1)
    cut = sizes.select(artifact, F.floor(F.ceil(F.col("n") / block_cells) * block_cells / blocks).alias("block"))
    out = cells.join(cut, artifact)
    return out.withColumn("block_id", F.floor(F.col("obs_idx") / F.col("block"))).drop("block")


def write_collection(cells: DataFrame, path: str, artifact: str = "artifact", mode: str = "overwrite") -> None:
    """Write a folder for each artifact, so that artifact filters prune whole folders.

    Rows are shuffled by artifact; adaptive execution then cuts large artifacts into tasks of ``advisoryPartitionSizeInBytes``, and joins small
    ones. A small artifact that is dealt to one partition with a large one is cut with it.
    """
    cells.hint("rebalance", artifact).write.mode(mode).partitionBy(artifact).parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as that takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path, if anything does."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _reserved(spark: SparkSession, catalog_path: str) -> int:
    """A version number that no other writer has: its file is made only where there is none, else the next is tried."""
    fs, folder = _files(spark, f"{catalog_path}/_numbers")
    fs.mkdirs(folder)
    n = 1 + max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)
    while True:
        try:
            fs.create(_files(spark, f"{catalog_path}/_numbers/{n:08d}")[1], False).close()
            return n
        except Py4JJavaError as error:
            if not fs.exists(_files(spark, f"{catalog_path}/_numbers/{n:08d}")[1]):
                raise error
            n += 1


def register(spark: SparkSession, path: str, catalog_path: str, key: str, artifact: str = "artifact") -> tuple[DataFrame, DataFrame]:
    """Register a written collection as a new version of ``key`` and give the rows of the catalog: ``artifacts`` (artifact_id, path, suffix,
    bytes, n_cells, is_latest, version) and ``collection`` (collection_key, artifact_id, ordinal, version).

    Both tables hold the latest version of every collection; other collections' rows are left as they are. All versions stay in
    :func:`versions`: one is written aside and comes there by a rename, under a number that it alone has, so readers see all of it or
    nothing, and of writers at one time each gets a version. An artifact's id is its name with key and version before it. Bytes come
    from the files' lengths, cells from their footers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.groupBy(artifact).agg(F.sum("length").alias("bytes"))
    cells = spark.read.parquet(path).groupBy(artifact).agg(F.count("*").alias("n_cells"))
    n, name = _reserved(spark, catalog_path), F.col(artifact).cast("string")
    order = F.row_number().over(Window.orderBy("name")) - 1
    one = sizes.join(cells, artifact).select(
        F.concat(F.lit(f"{key}/{n}/"), name).alias("artifact_id"), name.alias("name"), F.concat(F.lit(f"{path}/{artifact}="), name).alias("path"), F.lit(".parquet").alias("suffix"), "bytes", "n_cells", F.lit(key).alias("collection_key"), F.lit(n).alias("version")
    )
    aside, there = f"{catalog_path}/_aside/{n:08d}", f"{catalog_path}/versions/number={n}"
    one.withColumn("ordinal", order).write.parquet(aside)
    fs, target = _files(spark, there)
    fs.mkdirs(target.getParent())
    if not fs.rename(_files(spark, aside)[1], target):
        raise OSError(f"version {n} could not be put in place")
    newest = versions(spark, catalog_path).where(F.col("is_latest") & (F.col("collection_key") == key))
    for table, columns in (("artifacts", ["artifact_id", "path", "suffix", "bytes", "n_cells", "is_latest"]), ("collection", ["artifact_id", "ordinal"])):
        own = newest.select(*columns, "version", "collection_key")
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_key").parquet(f"{catalog_path}/{table}")
    return spark.read.parquet(f"{catalog_path}/artifacts"), spark.read.parquet(f"{catalog_path}/collection")


def versions(spark: SparkSession, catalog_path: str) -> DataFrame:
    """All artifacts of all versions of all collections, with ``is_latest``: those of the highest version of their collection."""
    at = spark.read.parquet(f"{catalog_path}/versions").drop("number")
    last = at.groupBy("collection_key").agg(F.max("version").alias("__last"))
    return at.join(last, "collection_key").withColumn("is_latest", F.col("version") == F.col("__last")).drop("__last")


def write_slice(spark: SparkSession, artifacts: DataFrame, only: tuple[int, int] | None, path: str, catalog_path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Copy the artifacts (path, ordinal, n_organisms) that :func:`slice_members` chooses to ``path`` and register them as collection ``key``."""
    chosen = [r.path for r in slice_members(artifacts, only).orderBy("ordinal").select("path").toLocalIterator()]
    cells = union_cells([spark.read.parquet(p).withColumn("artifact", F.lit(i)) for i, p in enumerate(chosen)])
    write_collection(cells, path)
    return register(spark, path, catalog_path, key)


def version_diff(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Keys of the old version that the new one lacks."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def register_views(**tables: DataFrame) -> None:
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
