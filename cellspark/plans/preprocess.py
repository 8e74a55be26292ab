"""Preprocessing of whole collections: one plan over all artifacts, with a report of what was dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cluster, genes as gene_ops, qc
from ..operators.components import artifact_components
from ..operators.numbering import cut, small
from ..operators.select import with_bins
from ..sources import catalog

Hook = Callable[[DataFrame], DataFrame]

#: Assays that read whole transcripts.
FULL_LENGTH_ASSAYS = ("EFO:0700016", "EFO:0008930", "EFO:0008931")


@dataclass(frozen=True)
class PreprocessOptions:
    filter_gene_by_counts: float = 0
    filter_cell_by_counts: float = 0
    min_nnz_genes: int = 200
    min_dataset_size: int = 100
    min_valid_genes: int = 10_000
    min_genes: int = 1000
    max_drop: float = 50
    assays_to_drop: Sequence[str] = ("EFO:0008939",)
    organisms: Sequence[str] = ("NCBITaxon:9606",)
    drop_non_primary: bool = True
    force: bool = False
    is_symbol: bool = False
    normalize_sum: float = 1e4
    n_hvg: int = 0
    binning: int = 0
    madoutlier: float = 5
    pct_mt_outlier: float = 8
    batch_keys: Sequence[str] = ("assay", "donor_id", "suspension_type", "sex")
    use_raw: bool = True
    use_layer: str | None = None
    length_normalize: bool = False
    skip_validate: bool = False
    n_pcs: int = 0
    maxfilesize: float = 5e9
    before: Hook | None = None
    after: Hook | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.binning, int):
            raise ValueError(f"binning must be a whole number, not {self.binning!r}")
        if self.n_pcs and not self.n_hvg:
            raise ValueError("components are those of variable genes; set n_hvg")


class Preprocessor:
    """``transform(obs, coo, var, vocabulary)`` gives the cells that stay; ``report`` has a row for each artifact, ``unseen``
    the vocabulary's genes that it lacks, ``violations`` what its labels break.

    ``obs``: cell, artifact, organism, assay and labels; ``coo``: cell, gene, value (and layers ``raw``, ``counts`` or others); ``var``:
    artifact, var_idx, gene_id (and symbol); ``vocabulary``: gene_id, symbol, organism, flags (and length). All artifacts go through one plan; gates
    are aggregates by artifact, and failures become rows of the report instead of exceptions.
    """

    def __init__(self, options: PreprocessOptions | None = None) -> None:
        self.options = options or PreprocessOptions()
        self.report: DataFrame | None = None
        self.unseen: DataFrame | None = None
        self.violations: DataFrame | None = None

    def transform(self, obs: DataFrame, coo: DataFrame, var: DataFrame, vocabulary: DataFrame, ontology: DataFrame | None = None) -> DataFrame:
        o = self.options
        obs = catalog.with_global_index(o.before(obs) if o.before else obs).drop("storage_idx", "global_idx")
        cells = qc.primary_only(obs) if o.drop_non_primary else obs
        # The check for counts reads the first cells of an artifact, before any is dropped.
        values = cut(qc.choose_counts(coo.join(obs.select("cell", "artifact", "obs_idx"), "cell"), use_raw=o.use_raw, layer=o.use_layer))
        raw = qc.raw_check(values).select("artifact", "is_raw").join(qc.log1p_check(values).select("artifact", "is_log1p"), "artifact")
        values, cells = values.drop("obs_idx").join(cells.select("cell"), "cell", "left_semi"), cells.drop("obs_idx")
        # Genes are filtered within their artifact, then cells; keys are made unique by the artifact.
        inside = values.groupBy("artifact", "gene").agg(F.sum("value").alias("s")).where(F.col("s") >= o.filter_gene_by_counts)
        values = values.join(inside, ["artifact", "gene"], "left_semi") if o.filter_gene_by_counts else values
        counts = values.groupBy("cell").agg(F.sum("value").alias("s"), F.count_if(F.col("value") != 0).alias("n"))
        good = counts.where((F.col("s") >= o.filter_cell_by_counts) & (F.col("n") >= o.min_nnz_genes)).select("cell", F.col("n").alias("nnz"))
        kept = cut(cells.join(good, "cell"))
        known = cut(gene_ops.join_vocabulary(var, vocabulary, o.is_symbol))
        self.unseen = gene_ops.unseen_genes(known.select("artifact", F.col("gene_id").alias("gene")), vocabulary.select(F.col("gene_id").alias("gene")))
        stats = (
            obs.groupBy("artifact")
            .agg(F.count("*").alias("n_before"), F.min_by("assay", "cell").alias("assay"), F.min_by("organism", "cell").alias("organism"))
            .join(cells.groupBy("artifact").agg(F.count("*").alias("n_primary")), "artifact", "left")
            .join(kept.groupBy("artifact").agg(F.count("*").alias("n_cells")), "artifact", "left")
            .join(var.groupBy("artifact").agg(F.count("*").alias("n_genes")), "artifact", "left")
            .join(known.groupBy("artifact").agg(F.count("*").alias("n_valid")), "artifact", "left")
            .join(raw, "artifact", "left")
            .fillna(0, ["n_primary", "n_cells", "n_genes", "n_valid"])
        )
        gates = qc.dataset_gates(stats, o.organisms, o.min_dataset_size, o.max_drop, o.min_genes, o.min_valid_genes, o.assays_to_drop)
        if not o.force:
            bad = ~F.coalesce("is_raw", F.lit(True)) & F.col("reason").isNull()
            gates = gates.withColumn("reason", F.when(bad, "not raw").otherwise(F.col("reason"))).withColumn("status", F.when(F.col("reason").isNull(), "kept").otherwise("dropped"))
        if ontology is not None and not o.skip_validate:
            self.violations = cut(qc.validate(kept, ontology, by=["artifact"]))
            invalid = self.violations.select("artifact").distinct().withColumn("invalid", F.lit(True))
            gates = gates.join(invalid, "artifact", "left")
            gates = gates.withColumn("reason", F.when(F.col("reason").isNull() & F.coalesce("invalid", F.lit(False)), "labels").otherwise(F.col("reason"))).drop("invalid")
            gates = gates.withColumn("status", F.when(F.col("reason").isNull(), "kept").otherwise("dropped"))
        if o.binning:
            below = values.groupBy("artifact").agg(F.min("value").alias("least")).where("least < 0").select("artifact", F.lit(True).alias("negative"))
            gates = gates.join(below, "artifact", "left")
            gates = gates.withColumn("reason", F.when(F.col("reason").isNull() & F.coalesce("negative", F.lit(False)), "negative values").otherwise(F.col("reason"))).drop("negative")
            gates = gates.withColumn("status", F.when(F.col("reason").isNull(), "kept").otherwise("dropped"))
        gates = self.report = cut(gates)
        passed = gates.where("status = 'kept'").select("artifact")
        kept = kept.join(passed, "artifact", "left_semi")
        genes = vocabulary.withColumnRenamed("gene_id", "gene")
        values = values.select("cell", "gene", "value").join(kept.select("cell"), "cell", "left_semi").join(genes.select("gene"), "gene", "left_semi")
        if o.length_normalize and "length" in vocabulary.columns:
            values = cluster.length_normalise_assays(values, kept, genes, FULL_LENGTH_ASSAYS)
        values = cut(values)
        metrics = qc.outliers(cut(qc.cell_metrics(values, genes)), o.madoutlier, mt_limit=o.pct_mt_outlier)
        normed = cluster.normalise(values, o.normalize_sum)
        kept, components = cluster.batch_label(kept, list(o.batch_keys)), None
        if o.n_hvg:
            scaled = normed.select("cell", "gene", F.col("norm").alias("value"))
            top = cut(cluster.variable_genes(scaled, kept, o.n_hvg, "batches", by="artifact").select("artifact", "gene", F.lit(True).alias("hvg")))
            components = artifact_components(scaled, kept, top, o.n_pcs).drop("artifact") if o.n_pcs else None
            normed = normed.join(kept.select("cell", "artifact"), "cell").join(small(top), ["artifact", "gene"], "left").drop("artifact").withColumn("hvg", F.coalesce("hvg", F.lit(False)))
        else:
            normed = normed.withColumn("hvg", F.lit(False))
        expr = normed.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gene", "value", "norm", "hvg"))).alias("expr"))
        out = kept.join(metrics, "cell").join(expr, "cell")
        out = out.join(components, "cell", "left") if components is not None else out
        if o.binning:
            out = with_bins(out, o.binning, bins="X_binned")
        out = out.withColumn("cell_uid", F.md5(F.concat_ws("#", "artifact", "cell")))
        return o.after(out) if o.after else out


def preprocess_collection(spark: SparkSession, in_dir: str, out_dir: str, options: PreprocessOptions | None = None, start_at: int = 0, key: str = "preprocessed", resume: bool = False) -> DataFrame:
    """Read ``obs``, ``coo``, ``var``, ``vocabulary`` (and ``ontology`` and ``sizes``: artifact, bytes, if there) below ``in_dir``; write below ``out_dir``
    the ``cells`` by artifact, ``report``, ``unseen``, and the rows that register the outputs as collection ``key``; gives the report.

    Artifacts before ordinal ``start_at`` are skipped, with ``resume`` also those that the report has already. Artifacts of more bytes than
    ``options.maxfilesize`` are cut into blocks, each an output of its own (``block_id``).
    """
    tables = {n: spark.read.parquet(f"{in_dir}/{n}") for n in ("obs", "coo", "var", "vocabulary")}
    options, obs = options or PreprocessOptions(), tables["obs"]
    optional = {n: t for n in ("ontology", "sizes") if (t := _table(spark, f"{in_dir}/{n}")) is not None}
    if start_at:
        order = Window.orderBy("artifact")
        later = obs.select("artifact").distinct().withColumn("n", F.row_number().over(order) - 1).where(F.col("n") >= start_at)
        obs = obs.join(small(later), "artifact", "left_semi")
    before = _table(spark, f"{out_dir}/report") if resume else None
    if before is not None:
        obs = obs.join(small(before.select("artifact")), "artifact", "left_anti")
    run = Preprocessor(options)
    out = run.transform(obs, tables["coo"], tables["var"], tables["vocabulary"], optional.get("ontology"))
    if "sizes" in optional:
        counts = obs.groupBy("artifact").agg(F.count("*").alias("n"))
        numbered = catalog.with_global_index(out).drop("storage_idx", "global_idx")
        out = catalog.with_blocks(numbered, optional["sizes"].join(counts, "artifact"), block_bytes=options.maxfilesize / 2).drop("obs_idx")
    mode = "append" if before is not None else "overwrite"
    catalog.write_collection(out, f"{out_dir}/cells", mode=mode)
    run.report.write.mode(mode).parquet(f"{out_dir}/report")
    run.unseen.write.mode(mode).parquet(f"{out_dir}/unseen")
    catalog.register(spark, f"{out_dir}/cells", f"{out_dir}/catalog", key)
    return spark.read.parquet(f"{out_dir}/report")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
