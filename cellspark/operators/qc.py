"""Quality control of cells, genes and artifacts. Values come as rows (cell, gene, value) without zeros."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import cut, small

QC_FLAGS = ("mt", "ribo", "hb")


def cell_metrics(coo: DataFrame, genes: DataFrame | None = None, flags: Sequence[str] = QC_FLAGS, top: int = 20) -> DataFrame:
    """Per cell: total counts, expressed genes, both as log1p, share of the ``top`` largest values, and the
    total and share of each flagged gene set. Cells without values have no row here."""
    sets = [f for f in flags if genes is not None and f in genes.columns]
    at = coo.join(genes.select("gene", *sets), "gene", "left") if sets else coo
    out = at.groupBy("cell").agg(
        F.sum("value").alias("total_counts"),
        F.count_if(F.col("value") != 0).alias("n_genes_by_counts"),
        F.slice(F.sort_array(F.collect_list("value"), False), 1, top).alias("tops"),
        *(F.sum(F.when(F.col(f), F.col("value")).otherwise(0.0)).alias(f"total_counts_{f}") for f in sets),
    )
    share = lambda c: 100 * c / F.nullif(F.col("total_counts"), F.lit(0.0))
    return out.select(
        "cell",
        "total_counts",
        F.log1p("total_counts").alias("log1p_total_counts"),
        "n_genes_by_counts",
        F.log1p("n_genes_by_counts").alias("log1p_n_genes_by_counts"),
        share(F.aggregate("tops", F.lit(0.0), lambda a, v: a + v)).alias(f"pct_counts_in_top_{top}_genes"),
        *(c for f in sets for c in (F.col(f"total_counts_{f}"), share(F.col(f"total_counts_{f}")).alias(f"pct_counts_{f}"))),
    )


def gene_metrics(coo: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Per gene: cells that express it, total, mean over all cells (zeros count) and dropout in percent.
    ``n_cells``: one row with ``n``, the number of cells."""
    by = coo.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    out = by.join(F.broadcast(n_cells.select("n")), how="inner")
    return out.select("gene", "n_cells_by_counts", "total_counts", (F.col("total_counts") / F.col("n")).alias("mean_counts"), (100 * (1 - F.col("n_cells_by_counts") / F.col("n"))).alias("pct_dropout_by_counts"))


def exact_medians(df: DataFrame, columns: dict[str, Column], bins: int = 4096) -> dict[str, float | None]:
    """The exact median of each column over all rows (None without values). Nulls and NaN are left out; infinite values lie at the
    ends, and a median half-way between both infinities is None.

    Values are counted in bins between the least and the largest; the bin that holds the middle is cut again, until it holds
    one value or the two middle values lie in different bins. A round is one aggregate of at most ``bins`` rows a column,
    whatever the number of rows and distinct values.
    """
    at = df.select(*(c.cast("double").alias(n) for n, c in columns.items()))
    finite = {n: F.when(F.abs(n) < float("inf"), F.col(n)) for n in columns}
    ends = at.agg(*(f(c).alias(f"{f.__name__}_{n}") for n, c in finite.items() for f in (F.count, F.min, F.max)), *(F.count_if(F.col(n) == F.lit(x)).alias(f"{k}_{n}") for n in columns for k, x in (("low", -np.inf), ("high", np.inf)))).first()
    out: dict[str, float | None] = {n: None for n in columns}
    # Column: least and largest value that may be the middle, rows below these, all rows.
    spans = {}
    for n in columns:
        low, held, high = ends[f"low_{n}"], ends[f"count_{n}"], ends[f"high_{n}"]
        total = low + held + high
        middle = [-np.inf if i < low else np.inf if i >= low + held else 0.0 for i in ((total - 1) // 2, total // 2)] if total else []
        if total and not any(middle):
            spans[n] = ends[f"min_{n}"], ends[f"max_{n}"], low, total
        elif total and middle[0] + middle[1] == middle[0] + middle[1]:
            out[n] = middle[0] + middle[1]
    while spans:
        for n in [n for n, (lo, hi, _, _) in spans.items() if lo == hi]:
            out[n] = spans.pop(n)[0]
        if not spans:
            break
        part = lambda lo, hi: 1.0 if hi - lo < np.inf else 0.5  # noqa: E731  # a span may be beyond the largest number
        place = lambda n, lo, hi, p: F.floor((F.col(n) * p - lo * p) / F.lit(hi * p - lo * p) * bins)
        bin_of = lambda n, lo, hi: F.least(place(n, lo, hi, part(lo, hi)), F.lit(bins - 1)).cast("int")
        inside = F.array(*(F.when(F.col(n).between(lo, hi), F.struct(F.lit(n).alias("name"), bin_of(n, lo, hi).alias("bin"), F.col(n).alias("v"))) for n, (lo, hi, _, _) in spans.items()))
        found = at.select(F.explode(inside).alias("x")).where("x IS NOT NULL").groupBy("x.name", "x.bin").agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
        rows = sorted(found.collect(), key=lambda r: (r["name"], r["bin"]))
        for name, (_, _, below, total) in list(spans.items()):
            first, second = (total - 1) // 2, total // 2
            upto, held = below, []
            for r in (r for r in rows if r["name"] == name):
                if upto <= second and first < upto + r["n"]:
                    held.append((r["lo"], r["hi"], upto, total))
                upto += r["n"]
            if len(held) == 1:
                spans[name] = held[0]
            else:  # the largest of one bin and the least of the next
                out[name] = (held[0][1] + held[1][0]) / 2
                del spans[name]
    return out


def with_outliers(df: DataFrame, metrics: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Add a mark for each metric (new column: metric, nmads): whether a value lies more than ``nmads`` unscaled median
    deviations from the median, within ``by`` or over all. Over all, medians are taken from counts in bins, in a few passes."""
    if not by:
        df = cut(df)  # else each round would compute the metrics anew
        meds = exact_medians(df, {o: F.col(m) for o, (m, _) in metrics.items()})
        far = {o: F.abs(F.col(m) - F.lit(meds[o])) for o, (m, _) in metrics.items()}
        mads = exact_medians(df, far)
        return df.withColumns({o: far[o] > F.lit(None if mads[o] is None else n * mads[o]) for o, (_, n) in metrics.items()})
    names = list(by)
    at = df.join(df.groupBy(*names).agg(*(F.median(m).alias(f"__med_{o}") for o, (m, _) in metrics.items())), names)
    far = {o: F.abs(F.col(m) - F.col(f"__med_{o}")) for o, (m, _) in metrics.items()}
    at = at.join(at.groupBy(*names).agg(*(F.median(x).alias(f"__mad_{o}") for o, x in far.items())), names)
    at = at.withColumns({o: far[o] > n * F.col(f"__mad_{o}") for o, (_, n) in metrics.items()})
    return at.drop(*(f"__{k}_{o}" for k in ("med", "mad") for o in metrics))


def with_outlier(df: DataFrame, metric: str, nmads: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    return with_outliers(df, {out: (metric, nmads)}, by)


def outliers(metrics: DataFrame, nmads: float = 5, mt_nmads: float = 3, mt_limit: float = 8) -> DataFrame:
    """``outlier`` (any of the three count metrics) and, with mt shares, ``mt_outlier``. Cells are marked, not dropped."""
    tests = {f"__{i}": (m, nmads) for i, m in enumerate(("total_counts", "n_genes_by_counts", "pct_counts_in_top_20_genes"))}
    has_mt = "pct_counts_mt" in metrics.columns
    out = with_outliers(metrics, tests | ({"__mt": ("pct_counts_mt", mt_nmads)} if has_mt else {}))
    out = out.withColumn("outlier", F.col("__0") | F.col("__1") | F.col("__2"))
    if has_mt:
        out = out.withColumn("mt_outlier", F.col("__mt") | (F.col("pct_counts_mt") > mt_limit))
    return out.drop(*tests, "__mt")


def filter_counts(coo: DataFrame, gene_counts: float = 0, cell_counts: float = 0, cell_genes: int = 0) -> DataFrame:
    """Drop genes of fewer counts, then cells of fewer counts or expressed genes, in this order."""
    genes = coo.groupBy("gene").agg(F.sum("value").alias("s")).where(F.col("s") >= gene_counts)
    at = coo.join(genes, "gene", "left_semi") if gene_counts else coo
    cells = at.groupBy("cell").agg(F.sum("value").alias("s"), F.count_if(F.col("value") != 0).alias("n"))
    return at.join(cells.where((F.col("s") >= cell_counts) & (F.col("n") >= cell_genes)), "cell", "left_semi")


def primary_only(obs: DataFrame, flag: str = "is_primary_data") -> DataFrame:
    """The primary cells; all where nothing is said of it in any column. A null flag is not primary."""
    return obs.where(F.col(flag)) if flag in obs.columns else obs


def raw_check(coo: DataFrame, by: str = "artifact", rows: int = 50_000) -> DataFrame:
    """Per artifact, whether the first cells (by ``obs_idx`` if there) hold whole numbers alone."""
    at = coo.where(F.col("obs_idx") < rows) if "obs_idx" in coo.columns else coo
    return at.groupBy(by).agg(F.sum(F.abs(F.col("value") - F.col("value").cast("long"))).alias("excess")).withColumn("is_raw", F.col("excess") == 0)


def choose_counts(coo: DataFrame, by: str = "artifact", use_raw: bool = True, layer: str | None = None, raw: str = "raw", counts: str = "counts") -> DataFrame:
    """Values (cell, ``by``, gene, value) from the layer that holds counts.

    A column ``layer`` of ``coo`` is taken if named, else ``raw`` if there is one (and ``use_raw``). Artifacts whose values are then not
    whole numbers fall back to column ``counts`` if there is one. Zeros and nulls are left out.
    """
    if layer is not None and layer not in coo.columns:
        raise ValueError(f"there is no layer {layer}")
    value = F.col(layer) if layer else F.coalesce(raw, "value") if use_raw and raw in coo.columns else F.col("value")
    keys = [c for c in ("cell", by, "gene", "obs_idx") if c in coo.columns]
    at = coo.select(*keys, value.cast("double").alias("value"), *([F.col(counts).cast("double").alias("__counts")] if counts in coo.columns else []))
    if counts in coo.columns:
        odd = raw_check(at, by).where("NOT is_raw").select(by, F.lit(True).alias("__odd"))
        at = at.join(small(odd), by, "left").withColumn("value", F.when(F.col("__odd"), F.col("__counts")).otherwise(F.col("value")))
    return at.select(*keys, "value").where("value != 0")


def log1p_check(coo: DataFrame, by: str = "artifact") -> DataFrame:
    """Per artifact, whether values look log-transformed: none above 30, none negative, least positive below 1."""
    out = coo.groupBy(by).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.min(F.when(F.col("value") > 0, F.col("value"))).alias("least"))
    return out.withColumn("is_log1p", ~((F.col("hi") > 30) | (F.col("lo") < 0) | (F.coalesce("least", F.lit(0.0)) >= 1)))


def dataset_gates(stats: DataFrame, organisms: Sequence[str], min_cells: int = 100, max_drop: float = 50, min_genes: int = 1000, min_valid: int = 10_000, assays: Sequence[str] = ("EFO:0008939",)) -> DataFrame:
    """``status`` (kept or dropped) and the first ``reason`` for each artifact.

    ``stats``: artifact, organism, assay, n_before (cells before filters), n_primary, n_cells, n_genes, n_valid.
    """
    tests: list[tuple[Column, str]] = [
        (F.col("n_primary") == 0, "no primary cells"),
        (F.col("assay").isin(*assays), "assay"),
        (~F.col("organism").isin(*organisms), "organism"),
        (F.col("n_genes") < min_genes, "genes"),
        (F.col("n_cells") < min_cells, "cells"),
        (F.col("n_before") / (F.col("n_cells") + 1) > max_drop, "dropped cells"),
        (F.col("n_valid") < min_valid, "valid genes"),
    ]
    reason = F.lit(None).cast("string")
    for test, name in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    return stats.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "kept").otherwise("dropped"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: Obs columns that hold ontology ids, with their registry.
ONTOLOGY_COLUMNS = {
    "cell_type_ontology_term_id": "cell_type",
    "tissue_ontology_term_id": "tissue",
    "disease_ontology_term_id": "disease",
    "development_stage_ontology_term_id": "stage",
    "assay_ontology_term_id": "assay",
    "self_reported_ethnicity_ontology_term_id": "ethnicity",
    "sex_ontology_term_id": "sex",
}


def validate(obs: DataFrame, ontology: DataFrame, columns: dict[str, str] | None = None, need_all: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """A row for each violation: ``problem``, ``column``, ``value`` and its rows ``n``, within ``by`` if given.

    Problems: a missing column (with ``need_all``), a repeated cell, an id that its registry lacks. "unknown" is
    always valid; the parts of a comma-joined list are checked each.
    """
    columns = ONTOLOGY_COLUMNS if columns is None else columns
    there = {c: kind for c, kind in columns.items() if c in obs.columns}
    by = list(by)
    out = duplicate_keys(obs, [*by, "cell"]).select(*by, F.lit("duplicate").alias("problem"), F.lit("cell").alias("column"), F.col("cell").cast("string").alias("value"), "n")
    if there:
        long = obs.select(*by, *(F.col(c).cast("string").alias(c) for c in there)).unpivot(by, list(there), "column", "value")
        counted = long.groupBy(*by, "column", "value").agg(F.count("*").alias("n")).withColumn("value", F.explode(F.split(F.coalesce("value", F.lit("")), ",")))
        kinds = F.create_map(*(F.lit(x) for pair in there.items() for x in pair))
        used = counted.select(*by, "column", F.trim("value").alias("value"), "n", kinds[F.col("column")].alias("kind")).where("value != 'unknown'")
        known = ontology.select("kind", F.col("ontology_id").alias("value")).distinct()
        bad = used.join(known, ["kind", "value"], "left_anti").groupBy(*by, "column", "value").agg(F.sum("n").alias("n"))
        out = out.unionByName(bad.select(*by, F.lit("unknown id").alias("problem"), "column", "value", "n"))
    if need_all and (lacking := [c for c in columns if c not in obs.columns]):
        rows = obs.sparkSession.createDataFrame([("missing column", c, None, 0) for c in lacking], "problem string, column string, value string, n long")
        out = out.unionByName(obs.select(*by).distinct().join(F.broadcast(rows), how="cross") if by else rows)
    return out
