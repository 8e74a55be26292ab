"""Collation of sparse cells into rows of fixed width."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import depth, depth_normalise, logp1
from ..operators.numbering import Stored, small
from ..operators.select import by_neighbours, densified, most_expressed, most_expressed_with_neighbours, random_expressed, with_bins, with_zero_genes


#: Genes, and their bytes, of a vocabulary that goes to every task; a larger one meets the values in a join.
VOCABULARY_ROWS, VOCABULARY_BYTES = 1_000_000, 64 << 20


@dataclass(frozen=True)
class CollateOptions:
    """What a collated row holds.

    ``how``: "most expr", "random expr", "all" or "some" (``genelist``). Cells get ``max_len`` genes and
    ``add_zero_genes`` more; missing ones are filled with unexpressed genes, or without ``fill`` left out, so that rows are as long as what is
    expressed. Values are scaled to ``norm_to``,
    then logged (base 2), then binned. ``key`` names what is unique in a row: the draw where cells are drawn again.
    ``dataset_name`` names a column that is given as ``dataset``.

    Rows of "all" and "some" are as wide as the vocabulary. With ``sparse`` they hold the same without its zeros: ``width``, and ``places``, where in
    the wide row the values of ``x`` and ``genes`` lie (see :func:`dense_rows`), so that cells cost what they express.
    """

    how: str = "all"
    max_len: int = 2000
    add_zero_genes: int = 0
    logp1: bool = False
    norm_to: float | None = None
    n_bins: int = 0
    class_names: Sequence[str] = ()
    tp_name: str | None = None
    organism_name: str = "organism"
    organisms: Sequence[str] = ()
    genelist: Sequence = ()
    seed: int = 0
    extra: Sequence[str] = field(default=())
    key: str = "cell"
    dataset_name: str | None = None
    sparse: bool = False
    fill: bool = True


def _ranked(genes: DataFrame) -> DataFrame:
    """``organism``, ``gene`` and ``rank``, the gene's place within its organism by ``pos``."""
    return genes.select("organism", "gene", (F.row_number().over(Window.partitionBy("organism").orderBy("pos")) - 1).alias("rank"))


class Vocabulary:
    """Genes by organism, in the order of their ranks. Its indices are built once for a Python worker, as it is sent as a broadcast value."""

    def __init__(self, genes: dict[str, pa.Array]):
        self.genes, self.indices = genes, {}

    def __getstate__(self) -> dict:
        return {"genes": self.genes, "indices": {}}

    def index(self, organism: str, kind: pa.DataType) -> tuple[pd.Index, np.ndarray]:
        """The organism's distinct genes, and the rank of each (with -1 behind them)."""
        if (organism, kind) not in self.indices:
            at = pd.Index(self.genes[organism].cast(kind).to_pandas())
            first = ~at.duplicated()
            self.indices[organism, kind] = at[first], np.append(np.flatnonzero(first), -1).astype(np.int32)
        return self.indices[organism, kind]

    def ranks(self, flat: pa.Array, row: np.ndarray, organism: pa.Array) -> np.ndarray:
        """For genes of cells (``row`` is the gene's cell) their ranks, or -1. Each distinct gene of a batch is looked up once."""
        coded = flat.dictionary_encode()
        code, genes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False), coded.dictionary.to_pandas()
        rank, named = np.full(len(flat), -1, np.int32), organism.dictionary_encode()
        names = named.dictionary.to_pylist()
        of = named.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
        for i, name in enumerate(names):
            if name in self.genes:
                at, ranks = self.index(name, flat.type)
                found = np.append(ranks[at.get_indexer(genes)], -1).astype(np.int32)[code]
                rank = found if len(names) == 1 and named.null_count == 0 else np.where((of == i)[row], found, rank)
        return rank


def _fetched(genes: DataFrame, limit: int) -> pa.Table | None:
    """The rows of ``genes`` as Arrow data, or None if they are more than ``limit`` or VOCABULARY_BYTES."""
    if genes.limit(limit + 1).count() > limit:
        return None
    sized = genes.agg(*(F.sum(F.octet_length(F.col(c).cast("string"))).alias(c) for c in genes.columns)).first()
    return genes.toArrow() if sum(n or 0 for n in sized) <= VOCABULARY_BYTES else None


def placing(genes: DataFrame, near: bool, limit: int = VOCABULARY_ROWS) -> tuple[Callable[[Column, Column], Column], Callable[[Column, Column, Column], Column]] | None:
    """Two functions of columns that look genes up within a row: ``place`` (expr, organism) gives a cell's values of known genes by rank, ``gather``
    (neighbours' exprs, ranks, organism) each neighbour's values at the ranks. None for a vocabulary beyond ``limit``.
    """
    rows = _fetched(_ranked(genes).where(F.col("organism").isNotNull()), limit)
    if rows is None:
        return None
    rows = rows.sort_by([("organism", "ascending"), ("rank", "ascending")])
    known = {name: rows.filter(pc.equal(rows["organism"], name))["gene"].combine_chunks() for name in pc.unique(rows["organism"]).to_pylist()}
    shared = genes.sparkSession.sparkContext.broadcast(Vocabulary(known))
    names = ["gene", "value", *(["near"] if near else [])]

    def place(expr: pa.Array, organism: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(expr), 0).to_numpy(zero_copy_only=False)
        row, flat = np.repeat(np.arange(len(expr)), lengths), expr.flatten()
        rank = shared.value.ranks(flat.field("gene"), row, organism)
        kept = np.flatnonzero(rank >= 0)
        kept = kept[np.lexsort((rank[kept], row[kept]))]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(expr)))]).astype(np.int32)
        fields = [pa.array(rank[kept]), *(flat.field(n).take(pa.array(kept)).cast(pa.float64()) for n in names[1:])]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names))

    def gather(exprs: pa.Array, ranks: pa.Array, organism: pa.Array) -> pa.Array:
        out = []
        for cells, at, name in zip(exprs, ranks.to_pylist(), organism, strict=True):
            if not cells.is_valid:
                out.append(None)
                continue
            near, rows = cells.values, []
            flat = near.flatten()
            own = np.repeat(np.arange(len(near)), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False))
            rank = shared.value.ranks(flat.field("gene"), own, pa.array([name.as_py()] * len(near), pa.string()))
            dense = np.zeros((len(near), len(shared.value.genes.get(name.as_py(), ())) + 1))
            dense[own, rank] = flat.field("value").cast(pa.float64()).to_numpy(zero_copy_only=False)
            rows = dense[:, np.asarray(at, np.int64)] if at else np.zeros((len(near), 0))
            out.append(rows.tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    kind = T.ArrayType(T.StructType([T.StructField("gene", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])]))
    return F.arrow_udf(place, kind), F.arrow_udf(gather, T.ArrayType(T.ArrayType(T.DoubleType())))


def keep_genes(cells: DataFrame, genes: DataFrame, limit: int = VOCABULARY_ROWS) -> DataFrame:
    """The cells with the values of ``genes`` (gene) alone; looked up within the row for at most ``limit`` genes, else in a join."""
    rows = _fetched(genes.select("gene").where(F.col("gene").isNotNull()).distinct(), limit)
    kind = cells.schema["expr"].dataType
    if rows is None:
        long = cells.select("cell", F.explode("expr").alias("x")).join(genes.select(F.col("gene").alias("__g")).distinct(), F.col("x.gene") == F.col("__g"), "left_semi")
        kept = long.groupBy("cell").agg(F.sort_array(F.collect_list("x")).alias("__kept"))
        return cells.join(kept, "cell", "left").withColumn("expr", F.coalesce("__kept", F.array().cast(kind))).drop("__kept")
    shared = cells.sparkSession.sparkContext.broadcast(Vocabulary({"": rows["gene"].combine_chunks()}))

    def known(expr: pa.Array) -> pa.Array:
        flat, lengths = expr.flatten(), pc.fill_null(pc.list_value_length(expr), 0).to_numpy(zero_copy_only=False)
        rank = shared.value.ranks(flat.field("gene"), np.repeat(np.arange(len(expr)), lengths), pa.array([""] * len(expr), pa.string()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(rank >= 0))

    marks = F.arrow_udf(known, T.ArrayType(T.BooleanType()))
    at = cells.withColumn("__known", marks(F.col("expr")))
    pairs = F.arrays_zip(F.col("expr").alias("x"), F.col("__known").alias("known"))
    return at.withColumn("expr", F.transform(F.filter(pairs, lambda p: p["known"]), lambda p: p["x"])).drop("__known")


def _placed_by_join(cells: DataFrame, genes: DataFrame, key: str, near: bool) -> DataFrame:
    """``cells`` with ``placed`` for a vocabulary of any size: values meet it in a join on genes and come together again by ``key``."""
    ranks = _ranked(genes).toDF("__o", "__g", "rank")
    long = cells.select(key, "__org", F.explode("expr").alias("x")).join(ranks, (F.col("__org") == F.col("__o")) & (F.col("x.gene") == F.col("__g")))
    fields = [F.col("rank").alias("gene"), F.col("x.value").cast("double").alias("value"), *([F.col("x.near").alias("near")] if near else [])]
    by = long.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("placed"))
    kind = by.schema["placed"].dataType
    return cells.join(by, F.col(key) == F.col("__key"), "left").withColumn("placed", F.coalesce("placed", F.array().cast(kind))).drop("__key")


def collate(cells: DataFrame, genes: DataFrame, options: CollateOptions) -> DataFrame:
    """``cell``, ``x``, ``genes``, ``class``, ``tp``, ``depth`` (and ``options.extra``) of cells of known organisms.

    ``cells``: cell, organism, expr (sparse; with a field ``near``, the neighbours' sum, genes are chosen and filled
    by it too), the label codes. ``genes``: gene, organism, pos; a gene that is not in it is masked, but counts for the
    depth. Genes are looked up within the row, so nothing is shuffled, while the vocabulary has at most VOCABULARY_ROWS genes of VOCABULARY_BYTES; a larger one
    meets the values in a join. What cells have of ``is_meta``, ``knn_cells`` (neighbours' sparse values) and ``knn_cells_info`` is given too:
    ``knn_cells`` at the row's genes, scaled and logged as the row is.
    """
    if options.sparse and (options.how not in ("all", "some") or "knn_cells" in cells.columns):
        raise ValueError("only rows of all or some genes, without neighbours' values, are given sparsely")
    if not options.fill and (options.add_zero_genes or options.how in ("all", "some")):
        raise ValueError("only rows of chosen genes, without zeros asked for, can be left unfilled")
    if options.how not in ("most expr", "random expr", "all", "some"):
        raise ValueError("how must be most expr, random expr, all or some")
    org, near = options.organism_name, "near" in cells.select(F.explode("expr").alias("x")).select("x.*").columns
    chosen = genes if options.how != "some" else genes.where(F.col("gene").isin(*options.genelist))
    # Read some six times below; positions that are counted over all organisms would be counted by one task each time.
    chosen = Stored(chosen)(chosen.select("gene", "organism", "pos"))
    known = chosen.groupBy(F.col("organism").alias("__o")).agg(F.count("*").alias("width"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("pos").alias("distinct"))
    at = cells.where(F.col(org).isin(*options.organisms)) if options.organisms else cells
    also = [c for c in ("is_meta", "knn_cells_info") if c in cells.columns]
    needed = list(dict.fromkeys([*options.class_names, *([options.tp_name] if options.tp_name else []), *([options.dataset_name] if options.dataset_name else []), *options.extra, "cell", *also]))
    needed = [c for c in needed if c != options.key]
    knn = ["knn_cells"] if "knn_cells" in cells.columns else []
    at = at.select(options.key, F.col(org).alias("__org"), depth(F.col("expr")).alias("depth"), *needed, "expr", *knn)
    look_up = placing(chosen, near)
    if look_up is None and knn:
        raise ValueError(f"neighbours' values need a vocabulary of at most {VOCABULARY_ROWS} genes")
    at = at.withColumn("placed", look_up[0](F.col("expr"), F.col("__org"))) if look_up else _placed_by_join(at, chosen, options.key, near)
    # An organism's positions are mostly a run, of which rows carry the width and the first alone: its array, copied to each cell, would cost
    # cells times genes. Only positions with gaps, or of which some come twice, come in as an array at the end.
    run = isinstance(chosen.schema["pos"].dataType, T.IntegralType) and known.where("last - first + 1 <> width OR distinct <> width").isEmpty()
    at = at.drop("expr").join(small(known.select("__o", "width", "first")), F.col("__org") == F.col("__o")).drop("__o")
    if options.sparse:
        kept = F.filter("placed", lambda v: F.coalesce(v["value"] != 0, F.lit(True)))
        at = at.withColumn("picked", F.transform(kept, lambda v: F.struct(v["gene"].alias("gene"), v["value"].alias("value"))))
    elif options.how in ("all", "some"):
        at = at.withColumn("dense", densified(F.col("placed"), F.col("width")))
        at = at.withColumn("picked", F.transform("dense", lambda v, i: F.struct(i.alias("gene"), v.alias("value")))).drop("dense")
    else:
        if options.how == "random expr":
            picked = random_expressed(F.col("placed"), "cell", options.max_len, options.seed)
        else:
            picked = most_expressed_with_neighbours(F.col("placed"), options.max_len) if near else most_expressed(F.col("placed"), options.max_len)
        at = at.withColumns({"picked": picked, "taken": F.transform("placed", lambda x: x["gene"])})
        need = F.lit(options.add_zero_genes + options.max_len) - F.size("picked")
        if near:
            have = F.transform("picked", lambda x: x["gene"])
            more = F.filter(by_neighbours(F.col("placed")), lambda x: ~F.array_contains(have, x["gene"]))
            at = at.withColumn("picked", F.concat("picked", F.slice(more, F.lit(1), F.greatest(need, F.lit(0)))))
        if options.fill:
            at = with_zero_genes(at, need, F.col("width"), seed=options.seed)
            at = at.withColumn("picked", F.concat("picked", F.transform("zeros", lambda g: F.struct(g.alias("gene"), F.lit(0.0).alias("value")))))
    change = lambda v: v
    if options.norm_to is not None:
        change = lambda v: F.coalesce(depth_normalise(v, F.col("depth"), options.norm_to), F.lit(0.0))
    scaled = (lambda v: logp1(change(v))) if options.logp1 else change
    at = at.withColumn("picked", F.transform("picked", lambda x: F.struct(x["gene"].alias("gene"), scaled(x["value"]).alias("value"))))
    x = F.transform("picked", lambda p: p["value"])
    if options.n_bins:
        at = with_bins(at, options.n_bins, "picked")
        x = F.transform("bins", lambda p: p["bin"])
    label = F.array(*(F.col(c).cast("int") for c in options.class_names)) if options.class_names else F.array().cast("array<int>")
    tp = F.col(options.tp_name).cast("double") if options.tp_name else F.lit(0.0)
    places = F.transform("picked", lambda p: F.col("first") + p["gene"] if run else F.col("positions")[p["gene"]])
    if knn:
        values = look_up[1](F.col("knn_cells"), F.transform("picked", lambda p: p["gene"].cast("int")), F.col("__org"))
        at = at.withColumn("knn_cells", F.transform(values, lambda row: F.transform(row, scaled)))
    if not run:
        positions = chosen.groupBy(F.col("organism").alias("__o")).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        at = at.join(small(positions), F.col("__org") == F.col("__o"))
    wide = [F.transform("picked", lambda p: p["gene"].cast("int")).alias("places"), F.col("width").cast("int").alias("width")] if options.sparse else []
    dataset = [F.col(options.dataset_name).cast("long").alias("dataset")] if options.dataset_name else []
    return at.select("cell", x.alias("x"), places.cast("array<int>").alias("genes"), label.alias("class"), tp.alias("tp"), "depth", *wide, *also, *knn, *dataset, *options.extra)


def dense_rows(batch: pd.DataFrame) -> np.ndarray:
    """The values of sparsely collated rows of one width as a matrix, zeros put in."""
    widths = batch["width"].unique()
    if len(widths) > 1:
        raise ValueError("rows of organisms with vocabularies of other sizes make no matrix")
    out = np.zeros((len(batch), widths[0] if len(widths) else 0))
    for i, (places, x) in enumerate(zip(batch["places"], batch["x"], strict=True)):
        out[i, np.asarray(places, np.int64)] = x
    return out


def iter_batches(collated: DataFrame, batch_size: int, order: str | None = None) -> Iterator[pd.DataFrame]:
    """Pandas tables of ``batch_size`` rows, in the order of a column if given.

    Tasks sort and pack their rows as Arrow data; the driver holds the packed data of one partition and cuts it.
    """
    at = collated.orderBy(order) if order else collated

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    held: pa.Table | None = None
    for row in at.mapInArrow(pack, "data binary").toLocalIterator():
        more = pa.ipc.open_stream(bytes(row.data)).read_all()
        held = more if held is None or not held.num_rows else pa.concat_tables([held, more])
        while held.num_rows >= batch_size:
            yield held.slice(0, batch_size).to_pandas()
            held = held.slice(batch_size)
    if held is not None and held.num_rows:
        yield held.to_pandas()
