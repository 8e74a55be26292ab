"""Removal of repeated passages by windows of three lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of


def line_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each window of three consecutive lines that hold more than white space.

    ``k`` and ``t`` (the key and a hash of the text) name the document, ``i`` holds the places of the
    three lines among all its lines, ``h1`` and ``h2`` are two 64-bit hashes of the lines.
    """
    at = docs.select(F.col(key).alias("k"), text_of(text).alias("text"))
    at = at.select("k", F.xxhash64("text").alias("t"), F.split("text", "\n").alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    at = at.select("k", "t", F.filter(numbered, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]")).alias("s"))
    at = at.where(F.size("s") >= 3).withColumn("n", F.size("s") - 2)
    three = F.arrays_zip(*(F.slice("s", F.lit(j + 1), F.col("n")).alias(name) for j, name in enumerate("abc")))
    windows = F.transform(
        three,
        lambda w: F.struct(
            F.array(w["a"]["i"], w["b"]["i"], w["c"]["i"]).alias("i"),
            F.xxhash64(w["a"]["x"], w["b"]["x"], w["c"]["x"]).alias("h1"),
            F.xxhash64(F.lit(1), w["c"]["x"], w["b"]["x"], w["a"]["x"]).alias("h2"),
        ),
    )
    return at.select("k", "t", F.explode(windows).alias("w")).select("k", "t", "w.*")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document with lines to remove: ``k``, ``t`` and ``gone``, the places of these lines.

    Of equal windows the first stays: that of the smallest key, then text hash, then place. The hot
    windows are counted before they are shuffled, and the join back is one that adaptive execution
    splits: both of its sides are written tables.
    """
    windows = materialise(line_windows(docs, key, text), "windows")
    place = F.struct("k", "t", "i")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    repeated = materialise(repeated.drop("c"), "repeated")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("k", "t").agg(F.array_distinct(F.flatten(F.collect_set("i"))).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that only later occurrences of repeated windows cover.

    The text is cut at line feeds. Lines without a word are in no window and always stay. A window that
    occurs again, in the same or another document, is removed there: overlapping occurrences are merged,
    so the covered lines go once. The first occurrence of any line is never covered. Texts of fewer than
    three worded lines stay as they are; null stays null. Rows with equal key and text are one document
    and are treated alike. Adds ``n_lines`` and ``n_removed`` beside a struct ``doc`` of the columns.
    """
    gone = repeated_lines(docs, key, text)
    at = docs.select(F.struct("*").alias("doc"), text_of(text).alias("__text"))
    at = at.withColumn("__t", F.xxhash64("__text"))
    at = at.join(gone, F.col(f"doc.{key}").eqNullSafe(F.col("k")) & (F.col("__t") == F.col("t")), "left")
    at = at.select("doc", "gone", F.split("__text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    return at.select(
        F.when(F.col("gone").isNull(), F.col("doc")).otherwise(F.col("doc").withField(f"`{text}`", left)).alias("doc"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
