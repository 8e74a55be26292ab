"""Cleaning of label values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ethnicities that carry no information.
VAGUE_ETHNICITIES = ("multiethnic", "American", "Jewish Israeli", "na")
CULTURE, ORGANOID = " (cell culture)", " (organoid)"


def clean_labels(obs: DataFrame, ethnicity: str | None = None, cell_type: str | None = None, tissue: str | None = None) -> DataFrame:
    """Vague ethnicities become unknown; culture and organoid marks leave cell type and tissue and set
    ``cell_culture``; a tissue that names a cell type id becomes unknown."""
    out = obs
    if ethnicity:
        out = out.withColumn(ethnicity, F.when(F.col(ethnicity).isin(*VAGUE_ETHNICITIES), "unknown").otherwise(F.col(ethnicity)))
    marks = [(c, m) for c, m in ((cell_type, CULTURE), (tissue, CULTURE), (tissue, ORGANOID)) if c]
    if marks:
        found = F.lit(False)
        for column, mark in marks:
            found = found | F.coalesce(F.col(column).contains(mark), F.lit(False))
        before = F.col("cell_culture") if "cell_culture" in obs.columns else F.lit("False")
        out = out.withColumn("cell_culture", F.when(found, "True").otherwise(before))
        for column, mark in marks:
            out = out.withColumn(column, F.replace(column, F.lit(mark), F.lit("")))
    if tissue:
        out = out.withColumn(tissue, F.when(F.col(tissue).contains("CL:"), "unknown").otherwise(F.col(tissue)))
    return out


def age_ladder(age: Column, steps: list[tuple[float, str]], least: tuple[float, str], middle: str, words: dict[str, str] | None = None) -> Column:
    """A stage for an age: the first of the descending ``steps`` that it exceeds; below ``least`` its stage; else ``middle``.

    ``words`` maps ages that are no numbers; other text gives null.
    """
    number = age.try_cast("double")
    out = F.when(number < least[0], least[1]).when(number.isNotNull(), middle)
    for bound, stage in sorted(steps):
        out = F.when(number > bound, stage).otherwise(out)
    for word, stage in (words or {}).items():
        out = F.when(age.cast("string") == word, stage).otherwise(out)
    return out


def replace_values(df: DataFrame, column: str, values: dict[str, str], lower: bool = False) -> DataFrame:
    """Whole values replaced, after lowering if asked."""
    at = df.withColumn(column, F.lower(column)) if lower else df
    return at.replace(values, subset=[column]) if values else at
