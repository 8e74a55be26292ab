"""Label encoders, combined codes, counts and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered, ranges, small


def as_text(label: str | Column) -> Column:
    """A label as text: null is "unknown"; booleans are "True" and "False"."""
    column = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.when(F.typeof(column) == "boolean", F.initcap(column.cast("string"))).otherwise(column.cast("string")), F.lit("unknown"))


def categories(obs: DataFrame, label: str) -> DataFrame:
    """The distinct values of a label over all artifacts, in order of code points."""
    return obs.select(as_text(label).alias("value")).distinct()


def encoder(obs: DataFrame, label: str, unknown: str = "unknown") -> DataFrame:
    """``label``, ``value`` and ``code``: 0 up in order of value, -1 for the unknown value."""
    values = categories(obs, label).where(F.col("value") != unknown)
    known = values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))
    return known.unionByName(obs.sparkSession.createDataFrame([(unknown, -1)], "value string, code int")).select(F.lit(label).alias("label"), "value", "code")


def encode(obs: DataFrame, codes: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Add the code of a label; values without a code raise when rows are read."""
    at = obs.join(codes.select(F.col("value").alias("__value"), F.col("code").alias("__code")), as_text(label) == F.col("__value"), "left")
    checked = F.coalesce("__code", F.raise_error(F.concat(F.lit(f"{label} has no code for "), as_text(label))).cast("int"))
    return at.withColumn(out, checked).drop("__value", "__code")


def decode(df: DataFrame, codes: DataFrame, code: str, out: str = "value") -> DataFrame:
    """The value of a code."""
    return df.join(codes.select(F.col("code").alias("__code"), F.col("value").alias(out)), F.col(code) == F.col("__code"), "left").drop("__code")


def combined_codes(obs: DataFrame, labels: Sequence[str], out: str = "code") -> DataFrame:
    """Dense codes of the combinations that occur, in order of their values.

    The distinct combinations are numbered, not the rows: only these meet in one place.
    """
    combos = obs.select(*labels).distinct()
    codes = combos.withColumn(out, F.row_number().over(Window.orderBy(*labels)) - 1)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in labels]
    return obs.alias("a").join(small(codes).alias("b"), on).select("a.*", out)


def label_weights(obs: DataFrame, labels: Sequence[str], scaler: float | None = None) -> DataFrame:
    """``label`` (values joined by ``__``), ``n`` and ``weight``: 1 / n, or with a scaler s, of the largest
    count M and the least m, (M / s) / (1 + n - m + M / s)."""
    counts = obs.groupBy(F.concat_ws("__", *(as_text(c) for c in labels)).alias("label")).agg(F.count("*").alias("n"))
    if not scaler:
        return counts.withColumn("weight", 1 / F.col("n"))
    everything = Window.partitionBy()
    top = F.max("n").over(everything) / F.lit(float(scaler))
    return counts.select("label", "n", (top / (1 + F.col("n") - F.min("n").over(everything) + top)).alias("weight"))


def class_weights(labels: DataFrame, label: str, scaler: float, excluded: int | None = None) -> DataFrame:
    """``n`` and ``weight`` s n / (n + s) of every class; the excluded class weighs 0. A large scaler makes
    weights follow the counts, a small one makes them even."""
    out = labels.groupBy(label).agg(F.count("*").alias("n"))
    weight = F.lit(float(scaler)) * F.col("n") / (F.col("n") + F.lit(float(scaler)))
    return out.withColumn("weight", weight if excluded is None else F.when(F.col(label) == excluded, 0.0).otherwise(weight))


def class_index(labels: DataFrame, label: str, index: str) -> DataFrame:
    """The rows of each class: ``pos`` within it by index, and ``offset``, where the class begins among all.

    Rows are numbered within stretches of the index, so a class of any size is many tasks.
    """
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    offsets = sizes.select(label, (F.sum("n").over(Window.orderBy(label)) - F.col("n")).alias("offset"))
    at = numbered(labels.select(label, index), [label], ranges(labels, index), [index], "pos")
    return at.select(label, index, "pos").join(small(offsets), label)


def merged_labels(obs: DataFrame, label: str, index: str = "global_idx") -> DataFrame:
    """A label over all artifacts as text, by ``index``."""
    return obs.select(index, as_text(label).alias("label"))


def frequent_values(df: DataFrame, label: str, above: int) -> DataFrame:
    """Values of a label with more than ``above`` rows, and their number ``n``."""
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") > above)


def excluding(df: DataFrame, label: str, values: Sequence) -> DataFrame:
    """The rows whose label is not null and none of ``values``."""
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(*values)) if values else df.where(F.col(label).isNotNull())


def value_counts(df: DataFrame, label: str, n: str | None = None) -> DataFrame:
    """``n`` (rows, or the sum of a column) and its ``pct`` of the total, by value."""
    out = df.groupBy(label).agg((F.sum(n) if n else F.count("*")).alias("n"))
    return out.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_labels(df: DataFrame, label: str, k: int = 3) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(k)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many nulls each column has, a row for each."""
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return row.unpivot([], list(columns), "column", "n_null")
