"""Datasets and data modules: lazy tables for training, validation, test and prediction."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nnz, nnz_weight
from ..operators import labels, ontology, sampling
from ..operators.genes import aligned_pct, gene_lists, inner_genes, require_genes, vars_aligned
from ..operators.neighbors import with_metacells, with_neighbours
from ..operators.numbering import Stored, small
from ..sources.catalog import with_global_index
from ..sources.store import write_store
from .collate import CollateOptions, collate, iter_batches, keep_genes

#: Assays whose cells are metacells already.
META_ASSAYS = ("EFO:0022857", "EFO:0010961")


class CellDataset:
    """Cells (cell, artifact, organism, labels, expr) with their genes, encoders and label groupings, all lazy but for ``obs``: what is known of cells
    besides their values, and how many these are (``nnz``), is written once, so that labels, splits and sums do not read values again.

    ``join`` "inner" keeps the genes that all artifacts of ``var`` (artifact, gene) have, and raises if there are none; "outer" (or None)
    keeps all, as absent values are zero. ``edges`` (src, dst, rank, distance) are nearest neighbours: with
    ``metacell_share`` a random share of cells gets its neighbours' values added, with ``knn_cells`` cells carry these beside their own.
    """

    def __init__(
        self,
        cells: DataFrame,
        genes: DataFrame,
        predict: Sequence[str] = (),
        hierarchical: Sequence[str] = (),
        ontologies: DataFrame | None = None,
        obs_filter: dict[str, object] | None = None,
        join: str | None = None,
        var: DataFrame | None = None,
        edges: DataFrame | None = None,
        metacell_share: float = 0.0,
        meta_assays: Sequence[str] = META_ASSAYS,
        knn_cells: bool = False,
        sizes: DataFrame | None = None,
        seed: int = 0,
    ) -> None:
        if join not in (None, "inner", "outer"):
            raise ValueError("join must be inner, outer or None")
        if (metacell_share or knn_cells) and edges is None:
            raise ValueError("metacells and neighbours need edges")
        if metacell_share and knn_cells:
            raise ValueError("cells are either metacells or carry their neighbours")
        for key, value in (obs_filter or {}).items():
            cells = cells.where(F.col(key).isin(*([value] if isinstance(value, str) else value)))
        if join == "inner":
            if var is None:
                raise ValueError("an inner join of genes needs var")
            shared = require_genes(inner_genes(var))
            genes, cells = genes.join(shared, "gene", "left_semi"), keep_genes(cells, shared)
        if metacell_share:
            cells = with_metacells(cells, edges, metacell_share, seed, meta_assays)
        if knn_cells:
            cells = with_neighbours(cells, edges)
        values = [c for c in ("expr", "knn_cells", "knn_cells_info") if c in cells.columns]
        seen = Stored(cells)(cells.select(*(c for c in cells.columns if c not in values), *([nnz(F.col("expr")).alias("__nnz")] if "expr" in values else [])))
        self.obs = with_global_index(seen, ids=seen)
        self.cells, self.genes, self.sizes, self.metacell_share = with_global_index(cells, ids=seen), genes, sizes, metacell_share
        self.labels, self.hierarchical = list(dict.fromkeys([*predict, *hierarchical])), list(hierarchical)
        self.encoders: dict[str, DataFrame] = {}
        self.groupings: dict[str, DataFrame] = {}
        self._coded: DataFrame | None = None
        for label in self.labels:
            if label not in hierarchical:
                self.encoders[label] = labels.encoder(seen, label)
                continue
            if ontologies is None:
                raise ValueError("hierarchical labels need ontologies")
            terms = labels.categories(seen, label).withColumnRenamed("value", "term")
            pairs = ontology.closure(ontology.parent_edges(ontologies))
            self.encoders[label] = ontology.hierarchy_encoder(terms, pairs).withColumn("label", F.lit(label))
            self.groupings[label], _ = ontology.groupings(terms.where("term != 'unknown'"), pairs)

    @classmethod
    def from_df(cls, cells: DataFrame, genes: DataFrame, **options) -> CellDataset:
        """A dataset of one artifact."""
        return cls(cells if "artifact" in cells.columns else cells.withColumn("artifact", F.lit(0)), genes, **options)

    def __len__(self) -> int:
        return self.obs.count()

    def row(self, global_idx: int) -> DataFrame:
        return self.cells.where(F.col("global_idx") == global_idx)

    def encoded(self) -> DataFrame:
        """The cells with ``<label>_code`` for every label."""
        if self._coded is not None:
            return self._coded
        out = self.cells
        for label, codes in self.encoders.items():
            out = labels.encode(out, small(codes), label, f"{label}_code")
        return out

    def store(self, name: str | None = None, path: str | None = None, buckets: int | None = None) -> DataFrame:
        """Write the encoded cells in buckets of the global index (see :func:`write_store`) and read them from there from now on: epochs then
        shuffle draws alone, and :meth:`row` reads one file."""
        self._coded = write_store(self.encoded(), name, path, buckets, rows=len(self))
        self.cells = self._coded.drop(*(f"{label}_code" for label in self.encoders))
        return self._coded

    def decoders(self) -> DataFrame:
        first, *rest = (t.select("label", "code", "value") for t in self.encoders.values())
        for t in rest:
            first = first.unionByName(t)
        return first

    def gene_lists(self, var: DataFrame, path: str | None = None, force: bool = False) -> DataFrame:
        """The genes of every artifact of ``var`` and their number (see :func:`genes.gene_lists`); with ``path`` kept there and read back from then on,
        until an artifact comes that they lack, or with ``force``."""
        made = gene_lists(var)
        if not path:
            return made
        spark = var.sparkSession
        try:
            held = None if force else spark.read.parquet(path)
        except AnalysisException:
            held = None
        if held is None or not var.select("artifact").distinct().join(held.select("artifact"), "artifact", "left_anti").isEmpty():
            made.write.mode("overwrite").parquet(path)
            held = spark.read.parquet(path)
        return held

    def save_encoders(self, path: str) -> None:
        """Write all encoders as one table, for :meth:`load_encoders`."""
        self.decoders().write.mode("overwrite").parquet(path)

    def load_encoders(self, path: str) -> None:
        """Take encoders that were saved, such as a trained model's; every label must have one."""
        table = self.cells.sparkSession.read.parquet(path)
        there = {r.label for r in table.select("label").distinct().collect()}
        if lacking := [x for x in self.labels if x not in there]:
            raise ValueError(f"no encoder was saved for {lacking}")
        self.encoders, self._coded = {x: table.where(F.col("label") == x) for x in self.labels}, None

    def labels_hierarchy(self, label: str) -> DataFrame:
        return ontology.coded_groupings(self.groupings[label], self.encoders[label])

    def classes(self) -> DataFrame:
        """``label`` and ``value`` of every class to predict, without the unknown one; of hierarchical labels the leafs alone."""
        out = None
        for label, codes in self.encoders.items():
            own = codes.where("code >= 0").select(F.lit(label).alias("label"), "value")
            if label in self.groupings:
                own = own.join(self.groupings[label].select(F.col("ancestor").alias("value")), "value", "left_anti").select("label", "value")
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.cells.sparkSession.createDataFrame([], "label string, value string")

    def class_sizes(self) -> DataFrame:
        return self.classes().groupBy("label").agg(F.count("*").alias("n_classes"))

    def merged_labels(self, label: str) -> DataFrame:
        return labels.merged_labels(self.obs, label)

    def aligned_share(self, var: DataFrame) -> DataFrame:
        """The percentage of artifacts of ``var`` (artifact, gene) whose genes the vocabulary has all."""
        return aligned_pct(vars_aligned(var, self.genes.select("gene").distinct()))

    def summary(self) -> DataFrame:
        """One row: cells, artifacts, organisms, genes, classes, labels, the metacells' share, and GB where ``sizes`` (artifact, bytes) are known."""
        # Counted by artifact and organism first, so that no cell meets a distinct count.
        by = self.obs.groupBy("artifact", "organism").agg(F.count("*").alias("n"))
        out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells"), F.count_distinct("artifact").alias("n_artifacts"), F.count_distinct("organism").alias("n_organisms"))
        out = out.join(F.broadcast(self.genes.agg(F.count("*").alias("n_genes"))), how="inner").join(F.broadcast(self.classes().agg(F.count("*").alias("n_classes"))), how="inner")
        out = out.withColumns({"n_labels": F.lit(len(self.labels)), "n_hierarchical": F.lit(len(self.hierarchical)), "metacell_share": F.lit(float(self.metacell_share))})
        if self.sizes is not None:
            own = self.sizes.join(small(self.obs.select("artifact").distinct()), "artifact", "left_semi")
            out = out.join(F.broadcast(own.agg((F.sum("bytes") / 1e9).alias("size_gb"))), how="inner")
        return out

    def __repr__(self) -> str:
        row = self.summary().first().asDict()
        return "CellDataset(" + ", ".join(f"{k}={v}" for k, v in row.items()) + ")"


@dataclass(frozen=True)
class LoaderOptions:
    n_samples: int = 2_000_000
    weight_scaler: float = 50
    replacement: bool = True
    weight_by_nnz: bool = False
    validation: int | float = 0.2
    test: int | float = 0.0
    batch_size: int = 32
    seed: int = 42
    curriculum: int = 0
    restrict_to: int | None = None
    assays_to_drop: Sequence[str] = ("EFO:0030007",)


class DataModule:
    """Splits a dataset once and gives collated tables: ``train(epoch)``, ``validation()``, ``test()``, ``predict(rank)``."""

    def __init__(self, dataset: CellDataset, weight_by: Sequence[str], options: LoaderOptions, collating: CollateOptions) -> None:
        self.dataset, self.weight_by, self.options, self.collating = dataset, list(weight_by), options, collating
        self.splits: DataFrame | None = None
        self.index: DataFrame | None = None

    @property
    def genes(self) -> DataFrame:
        return self.dataset.genes

    @genes.setter
    def genes(self, genes: DataFrame) -> None:
        """The vocabulary that rows are collated to from now on."""
        self.dataset.genes = genes

    @property
    def encoders(self) -> dict[str, DataFrame]:
        return self.dataset.encoders

    @encoders.setter
    def encoders(self, encoders: dict[str, DataFrame]) -> None:
        self.dataset.encoders = dict(encoders)

    @property
    def organisms(self) -> Sequence[str]:
        return self.collating.organisms

    @organisms.setter
    def organisms(self, organisms: Sequence[str]) -> None:
        """The organisms whose cells are collated from now on; others are left out. None: all."""
        self.collating = replace(self.collating, organisms=tuple(organisms))

    def __repr__(self) -> str:
        counts = {} if self.splits is None else {r.split: r.n for r in self.splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
        return f"DataModule({self.dataset!r}, weight_by={self.weight_by}, splits={counts}, options={self.options})"

    def _about(self) -> str:
        """What a split depends on: the options, and a digest of the cells' ids and labels."""
        at = self.dataset.obs
        digest = at.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cell", "artifact", "global_idx", *self.weight_by)).alias("x")).first()
        o = self.options
        return json.dumps([[o.validation, o.test, o.seed, list(o.assays_to_drop)], self.weight_by, digest.n, digest.x])

    def setup(self, path: str | None = None, force: bool = False) -> DataFrame:
        """The split of every cell with its class and nnz weight.

        With ``path`` it is written there with the training cells' class index, and read back whenever it was made from the
        same options and cells; from others, or with ``force``, it is made anew.
        """
        spark = self.dataset.cells.sparkSession
        about = self._about() if path else ""
        if path and not force and self._stored(path, about):
            return self.splits
        o = self.options
        obs, keep = self.dataset.obs, Stored(self.dataset.obs)
        obs = sampling.drop_assays(obs, drop=o.assays_to_drop) if "assay" in obs.columns else obs
        numbered = keep(obs.select("cell", "artifact", "global_idx", *self.weight_by, F.col("__nnz").alias("nnz")))
        at = sampling.split(numbered, o.validation, o.test, seed=o.seed)
        at = labels.combined_codes(at, self.weight_by, "label") if self.weight_by else at.withColumn("label", F.lit(0))
        at = at.select("cell", "artifact", "global_idx", "split", "label", nnz_weight(F.col("nnz")).alias("weight"))
        if not path:
            self.splits, self.index = keep(at), None
        else:
            at.write.mode("overwrite").parquet(f"{path}/splits")
            self.splits = spark.read.parquet(f"{path}/splits")
            labels.class_index(self._training(), "label", "global_idx").write.mode("overwrite").parquet(f"{path}/index")
            spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{path}/about")
            self.index = spark.read.parquet(f"{path}/index")
        keep.drop(numbered)
        return self.splits

    def _stored(self, path: str, about: str) -> bool:
        """Take what lies below ``path`` if it was made from this."""
        spark = self.dataset.cells.sparkSession
        try:
            if spark.read.parquet(f"{path}/about").first().about != about:
                return False
        except AnalysisException:
            return False
        self.splits, self.index = (spark.read.parquet(f"{path}/{x}") for x in ("splits", "index"))
        return True

    def _training(self) -> DataFrame:
        return self._of("train").select("label", "global_idx", "weight")

    def _of(self, split: str) -> DataFrame:
        if self.splits is None:
            self.setup()
        return self.splits.where(F.col("split") == split)

    def draws(self, epoch: int = 0) -> DataFrame:
        """``draw_id`` and ``global_idx`` of an epoch: classes by weight, then rows within them."""
        o = self.options
        rows = self._training()
        if o.restrict_to:
            rows = sampling.restrict_top(rows, o.restrict_to, "weight", "global_idx")
        weights = labels.class_weights(rows, "label", o.weight_scaler)
        drawn = sampling.draw_labels(weights, o.n_samples, f"{o.seed}e{epoch}", curriculum=(epoch, o.curriculum) if o.curriculum else None)
        if not o.replacement:
            wanted = drawn.groupBy("label").agg(F.count("*").alias("n"))
            few = sampling.draw_without_replacement(rows, wanted, "global_idx", weight="weight" if o.weight_by_nnz else None, seed=f"{o.seed}e{epoch}")
            return sampling.shuffled_index(few.select("global_idx"), "global_idx", epoch, out="draw_id")
        if o.weight_by_nnz:
            return sampling.draw_weighted(drawn, rows, "global_idx", "weight", seed=f"{o.seed}e{epoch}").select("draw_id", "global_idx")
        index = self.index if self.index is not None and not o.restrict_to else labels.class_index(rows, "label", "global_idx")
        return sampling.draw_rows(drawn, index, f"{o.seed}e{epoch}").select("draw_id", "global_idx")

    def _collated(self, chosen: DataFrame, order: str) -> DataFrame:
        cells = chosen.join(self.dataset.encoded(), "global_idx").withColumn("batch_id", F.floor(F.col(order) / self.options.batch_size))
        names = [f"{x}_code" for x in self.dataset.labels]
        return collate(cells, self.dataset.genes, replace(self.collating, class_names=names, key=order, dataset_name="storage_idx", extra=tuple(dict.fromkeys([order, "batch_id", "storage_idx"]))))

    def train(self, epoch: int = 0) -> DataFrame:
        return self._collated(self.draws(epoch), "draw_id")

    def validation(self) -> DataFrame:
        return self._collated(self._of("validation").select("global_idx"), "global_idx")

    def test(self) -> DataFrame:
        return self._collated(self._of("test").select("global_idx"), "global_idx")

    def predict(self, rank: int = 0, world: int = 1) -> DataFrame:
        rows = self._of("train").select("global_idx")
        ranked = sampling.shuffled_index(rows, "global_idx", self.options.seed, out="n")
        return self._collated(sampling.rank_shard(ranked, rows.count(), rank, world, index="n").select("global_idx"), "global_idx")

    def iter_batches(self, collated: DataFrame, order: str = "global_idx") -> Iterator:
        return iter_batches(collated, self.options.batch_size, order)

    def genes_by_organism(self) -> DataFrame:
        return self.dataset.genes.groupBy("organism").agg(F.array_sort(F.collect_list("gene")).alias("genes"))
