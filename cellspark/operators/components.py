"""Principal components of each artifact by itself, from sparse rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import Stored, small

#: Genes that one artifact's components may be taken over.
GENES = 10_000
#: Bytes of bases that the driver holds at a time; artifacts beyond it wait for the next wave.
WAVE_BYTES = 256 << 20
#: Values that are multiplied at a time within a task.
STEP = 1 << 15


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of equal values."""
    edges = np.flatnonzero(np.diff(x)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True) if len(x) else ()


def _times(offsets: np.ndarray, place: np.ndarray, value: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Products of sparse rows with ``q``, a stretch of rows at a time: its first row, the row behind its last, a line for each."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP, "right")) - 1)
        y = np.zeros((hi - lo, q.shape[1]))
        held = np.flatnonzero(np.diff(offsets[lo : hi + 1]))
        if len(held):
            a, b = offsets[lo], offsets[hi]
            y[held] = np.add.reduceat(value[a:b, None] * q[place[a:b]], offsets[lo:hi][held] - a, axis=0)
        yield lo, hi, y
        lo = hi


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's artifact numbers, and where each row's places and values begin."""
    lengths = pc.fill_null(pc.list_value_length(batch.column("place")), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("place", "value")]
    return batch.column("who").to_numpy(zero_copy_only=False), offsets, *flat


def _images(rows: DataFrame, bases: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each artifact of ``bases`` the product of its Gram matrix of genes with its basis, and its genes' sums.

    A task adds up one artifact at a time and gives a line for each gene it met; lines are summed in Spark.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bases)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, np.zeros((0, 0))

        def line() -> Iterator[pa.RecordBatch]:
            if own is not None and len(met := np.flatnonzero(total.any(axis=1))):
                z = pa.FixedSizeListArray.from_arrays(pa.array(total[met].ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), own, np.int32)), pa.array(met.astype(np.int32)), z], names=["who", "place", "z"])

        for batch in batches:
            who, offsets, place, value = _sparse(batch)
            for a, b in _runs(who):
                q = shared.value[int(who[a])]
                if own != int(who[a]):
                    yield from line()
                    own, total = int(who[a]), np.zeros((len(q), q.shape[1] + 1))
                at = offsets[a : b + 1]
                for lo, hi, y in _times(at, place, value, q):
                    x, y = slice(at[lo], at[hi]), np.hstack([y, np.ones((hi - lo, 1))])
                    if x.stop == x.start:
                        continue
                    order = np.argsort(place[x], kind="stable")
                    row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))[order]
                    sorted_place = place[x][order]
                    first = np.flatnonzero(np.diff(sorted_place, prepend=-1))
                    total[sorted_place[first]] += np.add.reduceat(value[x][order][:, None] * y[row], first, axis=0)
        yield from line()

    # Rows without values add nothing.
    parts = rows.where("place IS NOT NULL").select("who", "place", "value").mapInArrow(products, "who int, place int, z array<double>")
    sums = parts.groupBy("who", "place").agg(Summarizer.sum(array_to_vector("z")).alias("z")).select("who", "place", vector_to_array("z").alias("z")).toArrow()
    who, place = sums.column("who").to_numpy(), sums.column("place").to_numpy()
    lines = sums.column("z").combine_chunks().flatten().to_numpy()
    out, at = {}, np.concatenate([[0], np.cumsum([bases[int(w)].shape[1] + 1 for w in who])]).astype(np.int64)
    for w, q in bases.items():
        total = np.zeros((len(q), q.shape[1] + 1))
        for i in np.flatnonzero(who == w):
            total[place[i]] = lines[at[i] : at[i + 1]]
        out[w] = total[:, :-1], total[:, -1]
    shared.destroy()
    return out


class _Space:
    """One artifact's growing basis: blocks of the powers of its covariance times random vectors, and what the covariance makes of them."""

    def __init__(self, n: int, genes: int, k: int, width: int, seed: int):
        self.n, self.k, self.genes = n, k, genes
        start = np.eye(genes) if genes <= width else np.linalg.qr(np.random.default_rng(seed).normal(size=(genes, width)))[0]
        self.blocks, self.images, self.done = [start], [], False
        self.mean, self.loads = np.zeros(genes), np.zeros((genes, k))

    def absorb(self, gram: np.ndarray, sums: np.ndarray, tol: float) -> None:
        """Take in the Gram matrix times the last block; centring is a product of the means, so rows stay sparse."""
        self.mean, block = sums / self.n, self.blocks[-1]
        self.images.append(gram - self.n * np.outer(self.mean, self.mean @ block))
        basis, image = np.hstack(self.blocks), np.hstack(self.images)
        small_one = basis.T @ image
        value, turn = np.linalg.eigh((small_one + small_one.T) / 2)
        value, turn = value[::-1][: self.k], turn[:, ::-1][:, : self.k]
        load, rank = basis @ turn, int((value > 1e-12 * max(value[0], 0.0)).sum()) if value[0] > 0 else 0
        off = np.linalg.norm(image @ turn - load * value, axis=0)[:rank]
        load = load[:, :rank] * np.where(load[np.abs(load[:, :rank]).argmax(0), np.arange(rank)] < 0, -1.0, 1.0)
        self.loads = np.zeros((self.genes, self.k))
        self.loads[:, :rank] = load
        self.done = rank == 0 or basis.shape[1] >= self.genes or bool(off.max() <= tol * value[0])
        if not self.done:
            more = self.images[-1] - basis @ (basis.T @ self.images[-1])
            more -= basis @ (basis.T @ more)
            left, size, _ = np.linalg.svd(more, full_matrices=False)
            left = left[:, size > 1e-10 * np.linalg.norm(self.images[-1])][:, : self.genes - basis.shape[1]]
            self.done = left.shape[1] == 0
            self.blocks.append(left)


def artifact_components(coo: DataFrame, cells: DataFrame, genes: DataFrame, k: int, artifact: str = "artifact", oversample: int = 10, rounds: int = 20, tol: float = 1e-8, seed: int = 0, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """The artifact, ``cell`` and ``pca``: the first ``k`` components of each artifact's cells by themselves, over its ``genes`` (gene, and the
    artifact, or one list for all).

    A random block of ``k + oversample`` vectors for each artifact is multiplied by its covariance again and again, one pass over the sparse rows
    of all artifacts of a wave, and components are taken from all blocks together until each one's remainder is at most ``tol`` of the largest
    variance. After ``rounds`` passes the best so far is given, with a warning. Of an artifact the driver holds matrices of genes by a few hundred
    at most; artifacts go in waves of ``wave_bytes``, which only sets how many are done in one pass.

    Cells without values count as zeros. Components beyond an artifact's rank are 0, as are all of an artifact without genes. Each component's largest
    loading is positive. Null values count as zeros; cells without an artifact are left out; more than 10,000 genes of an artifact are refused.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    keep, own = Stored(cells), [artifact] if artifact in genes.columns else []
    cells = cells.select("cell", artifact).where(F.col(artifact).isNotNull())
    chosen = keep(genes.select(*own, "gene").where(F.col("gene").isNotNull()).distinct())
    widest = chosen.groupBy(*own).agg(F.count("*").alias("g")).agg(F.max("g").alias("g")).first().g or 0
    if widest > GENES:
        raise ValueError(f"components of {widest} genes; choose variable genes, {GENES} at most")
    places = chosen.select(*own, "gene", (F.row_number().over(Window.partitionBy(*own).orderBy("gene")) - 1).cast("int").alias("place"))
    counts = cells.groupBy(artifact).agg(F.count("*").alias("n"))
    sizes = counts.join(places.groupBy(*own).agg(F.count("*").alias("g")), own, "left") if own else counts.withColumn("g", F.lit(widest))
    sizes = keep(sizes.select(artifact, "n", F.coalesce("g", F.lit(0)).alias("g"), (F.row_number().over(Window.orderBy(artifact)) - 1).cast("int").alias("who")))
    at = coo.where(F.col("value").isNotNull()).select("cell", "gene", F.col("value").cast("double")).join(cells, "cell").join(small(places), [*own, "gene"])
    # Written first, as dealing rows by range reads them twice.
    held = keep(at.groupBy("cell").agg(F.collect_list("place").alias("place"), F.collect_list("value").alias("value")))
    rows = cells.join(held, "cell", "left").join(small(sizes.select(artifact, "who")), artifact)
    rows = keep(rows.repartitionByRange("who", "cell").sortWithinPartitions("who"))
    keep.drop(held)

    waves: list[list] = [[]]
    room = 0
    for r in sizes.select("who", "n", "g").orderBy("who").toLocalIterator():
        need = r.g * min(r.g, 16 * (k + oversample)) * 8
        if room + need > wave_bytes and waves[-1]:
            waves, room = [*waves, []], 0
        waves[-1].append(r)
        room += need
    done = []
    for wave in waves:
        spaces = {r.who: _Space(r.n, r.g, k, k + oversample, seed + r.who) for r in wave if r.g}
        part = rows.where(F.col("who").between(wave[0].who, wave[-1].who)) if wave else rows
        for _ in range(rounds):
            live = {w: x for w, x in spaces.items() if not x.done}
            if not live:
                break
            some = part if len(live) == len(wave) else part.where(F.col("who").isin(*live))
            for w, (gram, sums) in _images(some, {w: x.blocks[-1] for w, x in live.items()}).items():
                live[w].absorb(gram, sums, tol)
        if late := [w for w, x in spaces.items() if not x.done]:
            warnings.warn(f"components of {len(late)} artifacts had not settled to {tol} after {rounds} rounds", stacklevel=2)
        done.append(keep(_projected(part, {w: (x.loads, x.mean @ x.loads) for w, x in spaces.items()}, artifact, k)))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    keep.drop(rows, sizes, chosen)
    return out


def _projected(rows: DataFrame, loads: dict[int, tuple[np.ndarray, np.ndarray]], artifact: str, k: int) -> DataFrame:
    """The rows on their artifact's components; those without values all lie in one place, and need no product."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(loads)
    origins = spark.createDataFrame([(w, (0.0 - shift).tolist()) for w, (_, shift) in loads.items()], "who int, pca array<double>")
    bare = rows.where("place IS NULL").join(small(origins), "who", "left").select(artifact, "cell", F.coalesce("pca", F.array_repeat(F.lit(0.0), k)).alias("pca"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, offsets, place, value = _sparse(batch)
            out = np.zeros((len(who), k))
            for a, b in _runs(who):
                if int(who[a]) in shared.value:
                    load, shift = shared.value[int(who[a])]
                    for lo, hi, y in _times(offsets[a : b + 1], place, value, load):
                        out[a + lo : a + hi] = y - shift
            pca = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(artifact), batch.column("cell"), pca], names=[artifact, "cell", "pca"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (artifact, "cell"))
    held = rows.where("place IS NOT NULL").select(artifact, "cell", "who", "place", "value").mapInArrow(project, f"{kinds}, pca array<double>")
    return held.union(bare)
