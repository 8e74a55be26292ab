"""Normalised values, variable genes, components, clusters and their names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import SMALL_ROWS, Stored, cut, gathered, many, numbered, ranges, small

#: Genes of a batch that one task fits by itself; those of a larger batch are dealt over tasks.
FIT_ROWS = 1 << 18
#: Places at which the curve of many genes is fitted.
GRID = 500


def normalise(coo: DataFrame, target: float = 1e4) -> DataFrame:
    """``norm``: values scaled to a total of ``target`` per cell, as log1p."""
    totals = coo.groupBy("cell").agg(F.sum("value").alias("total"))
    return coo.join(totals, "cell").withColumn("norm", F.log1p(F.col("value") * target / F.nullif(F.col("total"), F.lit(0.0)))).drop("total")


def length_normalise(coo: DataFrame, lengths: DataFrame) -> DataFrame:
    """Values divided by their gene's ``length``; genes without one stay."""
    return coo.join(lengths.select("gene", "length"), "gene", "left").withColumn("value", F.col("value") / F.coalesce("length", F.lit(1))).drop("length")


def length_normalise_assays(coo: DataFrame, cells: DataFrame, lengths: DataFrame, assays: Sequence[str], assay: str = "assay") -> DataFrame:
    """Values divided by their gene's ``length`` for cells of the given full-length ``assays`` alone."""
    at = coo.join(cells.select("cell", F.coalesce(F.col(assay).isin(*assays), F.lit(False)).alias("__full")), "cell").join(small(lengths.select("gene", "length")), "gene", "left")
    return at.withColumn("value", F.when(F.col("__full"), F.col("value") / F.coalesce("length", F.lit(1))).otherwise(F.col("value"))).drop("length", "__full")


def batch_label(obs: DataFrame, keys: list[str], out: str = "batches") -> DataFrame:
    """The non-null batch keys that are there, joined by commas."""
    return obs.withColumn(out, F.concat_ws(",", *(F.col(k).cast("string") for k in keys if k in obs.columns)))


def gene_moments(coo: DataFrame, cells: DataFrame, batch: str | Sequence[str] | None = None) -> DataFrame:
    """Mean and variance of each gene in each batch, with the zeros of all the batch's cells."""
    keys = [batch] if isinstance(batch, str) else list(batch or [])
    return _moments(coo.join(cells.select("cell", *keys), "cell") if keys else coo, cells, keys)


def _moments(at: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    by = at.groupBy(*keys, "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    out = by.join(small(n), keys) if keys else by.join(F.broadcast(n), how="inner")
    mean = F.col("s") / F.col("n")
    return out.select(*keys, "gene", "n", mean.alias("mean"), ((F.col("q") - F.col("n") * mean * mean) / F.greatest(F.col("n") - 1, F.lit(1))).alias("variance"))


def _local_fit(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic regression with tricube weights at every ``x``; on a grid where there are many."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    k = max(4, int(np.ceil(span * len(xs))))
    grid = xs if len(xs) <= GRID else np.quantile(xs, np.linspace(0, 1, GRID))
    fit = []
    for g in grid:
        lo = max(0, min(int(np.searchsorted(xs, g)) - k // 2, len(xs) - k))
        px, py = xs[lo : lo + k] - g, ys[lo : lo + k]
        far = np.abs(px).max() or 1.0
        w = np.sqrt((1 - np.minimum(np.abs(px) / far, 1) ** 3) ** 3 + 1e-9)
        fit.append(np.linalg.lstsq(np.stack([np.ones_like(px), px, px * px], 1) * w[:, None], py * w, rcond=None)[0][0])
    return np.interp(x, grid, fit)


def _curve_sums(batches: Iterator[pa.RecordBatch], windows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each place of the batches' grids the weighted sums over the genes of its window: of powers 0 to 4 of the distance, and of powers 0 to 2 times ``y``.

    ``windows``: by batch a row for each place: where it lies, its first rank, the rank behind its last, and its reach, by which distances are divided.
    """
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        who, pos, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("who", "pos", "x", "y"))
        order = np.lexsort((pos, who))
        for some in np.split(order, np.flatnonzero(np.diff(who[order])) + 1) if len(order) else ():
            own = int(who[some[0]])
            total = totals.setdefault(own, np.zeros((GRID, 8)))
            grid, first, behind, far = windows[own].T
            begin, end, xs, ys = np.searchsorted(pos[some], first), np.searchsorted(pos[some], behind), x[some], y[some]
            for i in np.flatnonzero(begin < end):
                u = (xs[begin[i] : end[i]] - grid[i]) / far[i]
                near = np.minimum(np.abs(u), 1)
                near = 1 - near * near * near
                w = near * near * near + 1e-9
                powers = np.stack([np.ones_like(u), u, u * u, u * u * u, u * u * u * u])
                total[i, :5] += powers @ w
                total[i, 5:] += powers[:3] @ (w * ys[begin[i] : end[i]])
    for own, total in totals.items():
        met = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), own, np.int32)), pa.array(met.astype(np.int32)), *(pa.array(c) for c in total[met].T)], names=["who", "i", *(f"s{j}" for j in range(8))])


def _middle(sums: np.ndarray, far: float, rows: int) -> float:
    """The height of a quadratic at its window's place, from the sums of :func:`_curve_sums`: that of the least squares of ``_local_fit``, also where genes of
    few distinct means leave the quadratic open."""
    value, turn = np.linalg.eigh(sums[[[0, 1, 2], [1, 2, 3], [2, 3, 4]]])
    root = np.sqrt(np.where(value > 1e-12 * value[-1], value, 0.0))
    right = np.where(root > 0, turn.T @ sums[5:] / np.where(root > 0, root, 1.0), 0.0)
    return float(np.linalg.lstsq(root[:, None] * turn.T * [1.0, far, far * far], right, rcond=np.finfo(float).eps * rows)[0][0])


def _curves(ranked: DataFrame, sizes: dict[int, int], span: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The grid of each batch and the curve there, as ``_local_fit`` has them; ``ranked``: who, pos (the gene's rank by ``x`` in its batch), x, y.

    The driver holds what belongs to the grid's places alone; tasks hold a stretch of rows.
    """
    spark, steps = ranked.sparkSession, np.linspace(0, 1, GRID)

    def by_rank(ranks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """``x`` at the given ranks of each batch."""
        asked = pd.concat([pd.DataFrame({"who": np.int32(w), "pos": np.unique(r)}) for w, r in ranks.items()])
        found = ranked.join(F.broadcast(spark.createDataFrame(asked, "who int, pos long")), ["who", "pos"]).select("who", "pos", "x").toPandas().sort_values("pos")
        own = dict(tuple(found.groupby("who")))
        return {w: own[w]["x"].to_numpy()[np.searchsorted(own[w]["pos"].to_numpy(), r)] for w, r in ranks.items()}

    place = {w: (n - 1) * steps for w, n in sizes.items()}
    low = {w: np.floor(p).astype(np.int64) for w, p in place.items()}
    ends = by_rank({w: np.stack([low[w], np.minimum(low[w] + 1, n - 1)]) for w, n in sizes.items()})
    # The rank of the first gene of equal mean, for places that lie on a gene.
    asked = pd.concat([pd.DataFrame({"who": np.int32(w), "x": np.unique(e[0])}) for w, e in ends.items()])
    first = ranked.join(F.broadcast(spark.createDataFrame(asked, "who int, x double")), ["who", "x"]).groupBy("who", "x").agg(F.min("pos").alias("pos")).toPandas().sort_values("x")
    grid, begin, width = {}, {}, {w: max(4, int(np.ceil(span * n))) for w, n in sizes.items()}
    for w, n in sizes.items():
        (a, b), t = ends[w], place[w] - low[w]
        grid[w] = np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)
        own = first[first["who"] == w]
        below = np.where(grid[w] > a, low[w] + 1, own["pos"].to_numpy()[np.searchsorted(own["x"].to_numpy(), a)])
        begin[w] = np.maximum(0, np.minimum(below - width[w] // 2, n - width[w]))
    edges = by_rank({w: np.stack([lo, lo + width[w] - 1]) for w, lo in begin.items()})
    reach = {w: np.abs(e - grid[w]).max(0) for w, e in edges.items()}
    windows = {w: np.stack([grid[w], begin[w], begin[w] + width[w], np.where(reach[w] > 0, reach[w], 1.0)], axis=1) for w in sizes}
    shared, names = spark.sparkContext.broadcast(windows), [f"s{j}" for j in range(8)]
    parts = ranked.select("who", "pos", "x", "y").mapInArrow(lambda batches: _curve_sums(batches, shared.value), "who int, i int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("who", "i").agg(*(F.sum(c).alias(c) for c in names)).toPandas().sort_values(["who", "i"])
    shared.destroy()
    out = {}
    for w in sizes:
        own = sums[sums["who"] == w][names].to_numpy()
        out[w] = grid[w], np.array([_middle(s, far, width[w]) for s, far in zip(own, windows[w][:, 3], strict=True)])
    return out


def _expected(moments: DataFrame, keys: Sequence[str], span: float, keep: Stored) -> tuple[DataFrame, bool]:
    """``moments`` with ``sd``, the deviation that a gene's mean lets expect in its batch, and whether they are few.

    A task fits a batch of at most FIT_ROWS genes. Those of a larger one are ranked by mean in stretches, and each task sums its rows for all places of the curve.
    """
    schema = T.StructType([*(moments.schema[c] for c in (*keys, "gene", "n")), T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType())])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("gene")  # genes of equal means are told apart by name, not by the order of arrival
        x, y = np.log10(part["mean"].to_numpy()), np.log10(part["variance"].to_numpy())
        part["sd"] = 10 ** (_local_fit(x, y, span if len(part) > 50 else 1.0) / 2)
        return part[[*keys, "gene", "n", "mean", "sd"]]

    sizes = keep(moments.groupBy(*keys).agg(F.count("*").alias("g")))
    large = keep(sizes.where(F.col("g") > FIT_ROWS).withColumn("who", F.row_number().over(Window.orderBy(*keys)).cast("int")))
    total = sizes.agg(F.sum("g").alias("g")).first().g or 0
    known = {r.who: r.g for r in large.select("who", "g").collect()}
    if not known:
        return moments.groupBy(*keys).applyInPandas(fit, schema), total <= SMALL_ROWS
    whose = small(large.drop("g"))
    rows = moments.join(whose, list(keys)).select("who", *keys, "gene", "n", "mean", F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    ranked = keep(numbered(rows, ["who"], ranges(rows, "x", FIT_ROWS), ["x", "gene"], rows=sum(known.values())))
    shared = moments.sparkSession.sparkContext.broadcast(_curves(ranked, known, span))

    def deviation(who: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for w in who.unique():
            some = (who == w).to_numpy()
            out[some] = 10 ** (np.interp(x.to_numpy()[some], *shared.value[w]) / 2)
        return pd.Series(out)

    fitted = ranked.withColumn("sd", F.pandas_udf(deviation, "double")("who", "x")).select(*schema.names)
    if total > sum(known.values()):
        fitted = fitted.union(moments.join(whose, list(keys), "left_anti").groupBy(*keys).applyInPandas(fit, schema))
    return fitted, total <= SMALL_ROWS


def variable_genes(coo: DataFrame, cells: DataFrame, n_top: int = 2000, batch: str | None = None, span: float = 0.3, by: str | None = None) -> DataFrame:
    """Genes by standardised variance (``rank`` from 1, median over batches), the first ``n_top``; with ``by``, of each of its values by itself.

    The variance that a gene's mean lets expect comes from a local fit over the batch's genes; standardised values are clipped at sqrt(n) and summed in Spark.
    """
    own = [by] if by else []
    keys = [*own, *([batch] if batch else [])] or ["__batch"]
    cells = cells.select("cell", *keys) if own or batch else cells.select("cell", F.lit(0).alias("__batch"))
    keep = Stored(coo)
    at = keep(coo.join(cells, "cell").select(*keys, "gene", "value"))
    moments = keep(_moments(at, cells, keys).where("variance > 0 AND mean > 0"))
    fitted, few = _expected(moments, keys, span, keep)
    if few:
        fitted = F.broadcast(fitted)
    elif many(rows := at.count()):
        at, fitted = (gathered(df, *keys, "gene", rows=rows) for df in (at, fitted))
    clip = lambda v: F.least(v, F.sqrt("n") * F.col("sd") + F.col("mean"))
    sums = at.join(fitted, [*keys, "gene"]).groupBy(*keys, "gene").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.count("*").alias("m"), F.sum(clip(F.col("value"))).alias("s"), F.sum(clip(F.col("value")) ** 2).alias("q")
    )
    score = (F.col("n") * F.col("mean") ** 2 + F.col("q") - 2 * F.col("s") * F.col("mean")) / ((F.col("n") - 1) * F.col("sd") ** 2)
    scored = sums.withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "gene"))
    if batch:
        merged = scored.withColumn("r", place).groupBy(*own, "gene").agg(F.median("r").alias("m"), F.max("score").alias("score"))
        place = F.row_number().over((Window.partitionBy(*own) if own else Window).orderBy("m", "gene"))
    else:
        merged = scored  # of one batch the median is the place itself, of which only the first are sorted by one task
    out = Stored(coo)(merged.withColumn("rank", place).where(F.col("rank") <= n_top).select(*own, "gene", "rank", "score"))
    keep.clear()
    return out


def pca(vectors: DataFrame, vector: str, k: int, out: str = "pca") -> DataFrame:
    """Projections on the first ``k`` components of the centred vectors; each component's largest loading is positive."""
    at = vectors.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(at)
    loads = model.pc.toArray()
    sign = np.sign(loads[np.abs(loads).argmax(0), np.arange(loads.shape[1])])
    width = loads.shape[0]
    mean = vectors.select(F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(width))).alias("m")).first().m
    shift = (np.array(mean) @ loads).tolist()
    at = model.transform(at).withColumn("__p", vector_to_array("__p"))
    centred = F.array(*((F.col("__p")[j] - shift[j]) * float(sign[j]) for j in range(k)))
    return at.withColumn(out, centred).drop("__v", "__p")


def cluster_means(coo: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean value of each gene in each cluster (``clusters``: cell, cluster); zeros count."""
    n = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = coo.join(clusters, "cell").groupBy("cluster", "gene").agg(F.sum("value").alias("s"))
    return sums.join(small(n), "cluster").select("cluster", "gene", (F.col("s") / F.col("n")).alias("mean"))


def cluster_correlations(means: DataFrame, n_genes: int, types: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of the clusters' mean vectors over ``n_genes`` genes, those without values included,
    for all pairs ``a`` < ``b`` of clusters that have values; with ``types`` (cluster, type) for pairs of one type alone.

    Products are joined on genes, and on the type where there is one, and summed, so types never meet; the pairs come from the table of clusters,
    so those that share no gene are there too. A cluster whose means are all equal has a null correlation; one without a type is in no pair.
    """
    keys = ["type"] if types is not None else []
    means = cut(means.join(small(types.select("cluster", "type")), "cluster") if types is not None else means).select(*keys, "cluster", "gene", "mean")
    one = means.groupBy(*keys, "cluster").agg(F.sum("mean").alias("s"), F.sum(F.col("mean") ** 2).alias("q"))
    x, y = means.toDF(*keys, "a", "gene", "x"), means.toDF(*keys, "b", "gene", "y")
    products = x.join(y, [*keys, "gene"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    left, right = one.toDF(*keys, "a", "sa", "qa"), one.toDF(*keys, "b", "sb", "qb")
    pairs = left.join(right, "type").where("a < b") if keys else left.join(small(right), F.col("a") < F.col("b"))
    at = pairs.join(products, ["a", "b"], "left")
    n = F.lit(float(n_genes))
    top = F.coalesce("p", F.lit(0.0)) - F.col("sa") * F.col("sb") / n
    low = F.sqrt((F.col("qa") - F.col("sa") ** 2 / n) * (F.col("qb") - F.col("sb") ** 2 / n))
    return at.select("a", "b", (top / F.nullif(low, F.lit(0.0))).alias("corr"))


def relabel_clusters(clusters: DataFrame, cell_type: str = "cell_type", cluster: str = "cluster", min_cells: int = 10) -> DataFrame:
    """``name`` of each cell's cluster: within a cell type the largest, and those of fewer than ``min_cells``, are
    named by the type alone, the others by it and their rank by size."""
    return relabel_clusters_by(clusters.groupBy(cell_type, cluster).agg(F.count("*").alias("n")), cell_type, cluster, min_cells)


def relabel_clusters_by(sizes: DataFrame, cell_type: str, cluster: str, min_cells: int) -> DataFrame:
    """As :func:`relabel_clusters`, from the clusters' sizes ``n``."""
    rank = F.row_number().over(Window.partitionBy(cell_type).orderBy(F.desc("n"), cluster)) - 1
    name = F.when((F.col("rank") == 0) | (F.col("n") < min_cells), F.col(cell_type).cast("string")).otherwise(F.concat_ws("_", F.col(cell_type).cast("string"), F.col("rank").cast("string")))
    return sizes.withColumn("rank", rank).select(cell_type, cluster, "n", name.alias("name"))


def merge_map(correlations: DataFrame, types: DataFrame, limit: float = 0.94) -> DataFrame:
    """``cluster`` and ``into``: clusters of one cell type that correlate above ``limit`` go into the least of theirs
    that does, and on into where that one goes."""
    at = correlations.where(F.col("corr") > limit).join(small(types.toDF("a", "ta")), "a").join(small(types.toDF("b", "tb")), "b").where("ta = tb")
    step = at.groupBy(F.col("b").alias("cluster")).agg(F.min("a").alias("into"))
    further = step.toDF("into", "further")
    return step.join(small(further), "into", "left").select("cluster", F.coalesce("further", "into").alias("into"))


def renumber(clusters: DataFrame, merges: DataFrame, cell_type: str = "cell_type", cluster: str = "name") -> DataFrame:
    """``name`` and ``final``: each cluster under the cluster that it goes into, renumbered within its type by cells.

    ``clusters``: cell type, name, n; ``merges``: cluster, into. Merged clusters count together; the largest of a type is named
    by the type alone, the others by it and their rank.
    """
    merged = clusters.join(small(merges.select(F.col("cluster").alias("__c"), "into")), F.col(cluster) == F.col("__c"), "left").withColumn("into", F.coalesce("into", cluster)).drop("__c")
    again = relabel_clusters_by(merged.groupBy(cell_type, "into").agg(F.sum("n").alias("n")), cell_type, "into", 0)
    return merged.select(cell_type, F.col(cluster).alias("name"), "into").join(small(again.select(cell_type, "into", F.col("name").alias("final"))), [cell_type, "into"]).select(cell_type, "name", "final")


def propagate_labels(edges: DataFrame, rounds: int = 5, resolution: float = 0.0) -> DataFrame:
    """Communities of a neighbour graph (src, dst) by label propagation: a row takes its neighbours' most common
    label, ties to the least. ``src``, ``label``.

    With a ``resolution``, a label's votes are lessened by as many as it would have by chance at its community's degrees, times the
    resolution; so a higher one gives more and smaller communities. Rounds of these move every second row by hash, as rows that
    all move at once could change places for ever.
    """
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select("src").distinct().withColumn("label", F.col("src"))
    degrees = cut(both.groupBy("src").agg(F.count("*").alias("degree"))) if resolution else None
    total = both.count() if resolution else 0
    for step in range(rounds):
        votes = both.join(labels.select(F.col("src").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        if degrees is None:
            labels = cut(votes.groupBy("src").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label")))
            continue
        own = labels.join(degrees, "src")
        weights = own.groupBy("label").agg(F.sum("degree").alias("held"))
        votes = votes.union(labels.select("src", "label", F.lit(0).cast("long"))).groupBy("src", "label").agg(F.sum("n").alias("n"))
        at = votes.join(weights, "label").join(own.select("src", "degree", F.col("label").alias("mine")), "src")
        by_chance = F.col("degree") * (F.col("held") - F.when(F.col("label") == F.col("mine"), F.col("degree")).otherwise(0)) / F.lit(float(total or 1))
        best = at.groupBy("src").agg(F.min_by("label", F.struct((-(F.col("n") - resolution * by_chance)).alias("n"), "label")).alias("best"), F.first("mine").alias("mine"))
        moves = F.pmod(F.xxhash64("src", F.lit(step)), F.lit(2)) == 0
        labels = cut(best.select("src", F.when(moves, F.col("best")).otherwise(F.col("mine")).alias("label")))
    return labels
