"""Nearest neighbours within an artifact, and sums over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .numbering import small
from .select import to_cells

BLOCK = 2048
#: Rows whose candidates are looked for at a time, and candidates whose differences are held at a time.
STRETCH, CANDIDATES = 256, 1 << 15


def _block(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a packed block, without an object for each row."""
    at = items.flatten()
    flat = at.field("v").flatten().to_numpy(zero_copy_only=False)
    return at.field("id").to_numpy(zero_copy_only=False), flat.reshape(len(at), -1).astype(float)


def _nearest(a: np.ndarray, ids: np.ndarray, b: np.ndarray, ids2: np.ndarray, near: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``src``, ``dst`` and distance of the ``k`` nearest others in ``b`` of each row of ``a``, ties by id, a stretch of rows at a time.

    ``near``, squared distances by the matrix product, finds the candidates, all that may be as near as the k-th; their distances are taken from differences.
    """
    kth = min(k, near.shape[1]) - 1
    place = np.unique(ids2, return_inverse=True)[1]
    slack = 1e-9 * (1 + (a * a).sum(1)[:, None] + (b * b).sum(1).max())
    for lo in range(0, len(a), STRETCH):
        part = near[lo : lo + STRETCH]
        # Not "at most", so that distances that are no numbers come last in place of being lost.
        row, col = np.nonzero(~(part > np.partition(part, kth, axis=1)[:, [kth]] + slack[lo : lo + STRETCH]))
        d = np.concatenate([np.sqrt(((a[lo + row[i : i + CANDIDATES]] - b[col[i : i + CANDIDATES]]) ** 2).sum(1)) for i in range(0, len(row), CANDIDATES)] or [np.zeros(0)])
        src, dst = ids[lo + row], ids2[col]
        some = src != dst
        row, col, src, dst, d = row[some], col[some], src[some], dst[some], d[some]
        order = np.lexsort((place[col], d, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[nth < k]
        yield src[kept], dst[kept], d[kept]


def exact_knn(vectors: DataFrame, k: int = 6, artifact: str = "artifact", row: str = "row", vector: str = "vector") -> DataFrame:
    """``src``, ``dst``, ``distance``: the ``k`` nearest other rows of each row in its artifact, ties by id.

    Rows are dealt to blocks by hash. Each pair of an artifact's blocks is a group of its own, so that a large artifact is many tasks, and a
    task holds one pair at a time, however many it has. It compares both ways by one matrix product and keeps ``k`` of each row, so that only
    candidates, not pairs, are shuffled further.
    """
    sizes = vectors.groupBy(artifact).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = vectors.select(artifact, row, vector).join(small(sizes), artifact).withColumn("b", F.pmod(F.xxhash64(row), F.col("blocks")))
    packed = blocks.groupBy(artifact, "b").agg(F.max("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct(F.col(row).alias("id"), F.col(vector).alias("v")))).alias("items"))
    sides = packed.select(artifact, "b", "items", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    sides = sides.select(artifact, F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "items")
    kind = vectors.schema[row].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {b: _block(batch.column("items").slice(n, 1)) for batch in batches for n, b in enumerate(batch.column("b").to_pylist())}
        (ids, a), (ids2, b) = held[min(held)], held[max(held)]
        near = a @ b.T
        near *= -2
        near += (a * a).sum(1)[:, None]
        near += (b * b).sum(1)[None, :]
        near[ids[:, None] == ids2[None, :]] = np.inf
        ways = [(a, ids, b, ids2, near), (b, ids2, a, ids, near.T)]
        for way in ways[: len(held)]:
            for src, dst, d in _nearest(*way, k):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(d)], names=["src", "dst", "distance"])

    found = sides.groupBy(artifact, "i", "j").applyInArrow(nearest, f"src {kind}, dst {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_edges(edges: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` best edges of each row: positive distances ascending, zero distances last, ties by ``dst``."""
    order = Window.partitionBy("src").orderBy(F.col("distance") <= 1e-6, "distance", "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_sums(edges: DataFrame, coo: DataFrame) -> DataFrame:
    """``cell``, ``gene``, ``value``: the sum of the values of a cell's neighbours (``edges``: src, dst)."""
    at = edges.select(F.col("src").alias("to"), F.col("dst").alias("cell")).join(coo, "cell")
    return at.groupBy(F.col("to").alias("cell"), "gene").agg(F.sum("value").alias("value"))


def with_near(coo: DataFrame, sums: DataFrame) -> DataFrame:
    """Values with ``near``, the neighbours' sum, for genes that a cell or its neighbours express."""
    own = coo.select("cell", "gene", "value", F.lit(0.0).alias("near"))
    other = sums.select("cell", "gene", F.lit(0.0).alias("value"), F.col("value").alias("near"))
    return own.unionByName(other).groupBy("cell", "gene").agg(F.sum("value").alias("value"), F.sum("near").alias("near"))


def metacells(coo: DataFrame, edges: DataFrame, share: float, seed: int = 0, keep: DataFrame | None = None) -> DataFrame:
    """Values in which a random ``share`` of cells gets the sum of its neighbours' values added.

    Cells of ``keep`` (cell), which are metacells already, stay as they are.
    """
    chosen = edges.select(F.col("src").alias("cell")).distinct().where(uniform(seed, "cell") < share)
    if keep is not None:
        chosen = chosen.join(keep.select("cell"), "cell", "left_anti")
    extra = neighbour_sums(edges.join(chosen.withColumnRenamed("cell", "src"), "src", "left_semi"), coo)
    return coo.select("cell", "gene", "value").unionByName(extra).groupBy("cell", "gene").agg(F.sum("value").alias("value"))


def with_neighbours(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``knn_cells`` (neighbours' sparse values, nearest first) and ``knn_cells_info`` (their distances)."""
    at = edges.join(cells.select(F.col("cell").alias("dst"), F.col("expr").alias("near")), "dst")
    by = at.groupBy(F.col("src").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("rank", "near", "distance"))).alias("n"))
    return cells.join(by, "cell", "left").select(cells["*"], F.col("n.near").alias("knn_cells"), F.col("n.distance").alias("knn_cells_info"))


def with_metacells(cells: DataFrame, edges: DataFrame, share: float, seed: int = 0, meta_assays: Sequence[str] = (), assay: str = "assay") -> DataFrame:
    """Sparse cells of which a random ``share`` has its neighbours' values added, with ``is_meta``.

    Cells of ``meta_assays`` are metacells already and stay as they are. Only values of chosen cells are shuffled; the others' rows are
    joined with the sums by cell.
    """
    before = F.coalesce(F.col(assay).isin(*meta_assays), F.lit(False)) if meta_assays and assay in cells.columns else F.lit(False)
    at = cells.withColumns({"__before": before, "is_meta": before | (uniform(seed, "cell") < share)})
    chosen = at.where("is_meta AND NOT __before").select("cell", "expr")
    near = edges.join(chosen.select(F.col("cell").alias("src")), "src", "left_semi").join(cells.select(F.col("cell").alias("dst"), "expr"), "dst").select(F.col("src").alias("cell"), "expr")
    sums = to_cells(chosen.union(near).select("cell", F.explode("expr").alias("x")).select("cell", "x.gene", "x.value"))
    kind = cells.schema["expr"].dataType
    out = at.join(sums.select("cell", F.col("expr").cast(kind).alias("__sum")), "cell", "left")
    return out.withColumn("expr", F.coalesce("__sum", "expr")).drop("__sum", "__before")
