"""Splits, seeded draws and shards. All randomness is hashed from the seed and ids, so runs repeat exactly."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_key, uniform
from .numbering import PART_ROWS, numbered, ranges, running_sums, small


def drop_assays(obs: DataFrame, assay: str = "assay", drop: Sequence[str] = ("EFO:0030007",)) -> DataFrame:
    return obs.where(~F.coalesce(F.col(assay), F.lit("")).isin(*drop))


def shuffled_index(df: DataFrame, index: str, seed: int = 42, out: str = "shuffled") -> DataFrame:
    """Add a dense random position. Rows are dealt to 65,536 groups by hash and numbered within them; the
    groups' offsets come from their counts."""
    at = df.withColumn("__h", hash_key(seed, index))
    return numbered(at, [], F.substring("__h", 1, 4), ["__h", index], out).drop("__h")


def among_first(df: DataFrame, n: int, index: str, seed: int = 42) -> Column:
    """Whether a row of ``df`` is one of the first ``n`` of :func:`shuffled_index`. ``index`` tells rows apart; equal ones get one answer.

    No row is shuffled for it: groups of hashes are counted, and only the group in which the first n end is ordered.
    """
    key = hash_key(seed, index)
    group = F.substring(key, 1, 4)
    if n <= 0:
        return F.lit(False)
    counts = df.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    last = counts.withColumn("upto", F.sum("n").over(Window.orderBy("g"))).where(F.col("upto") > n).orderBy("g").first()
    if last is None:
        return F.lit(True)
    behind = df.where(group == last.g).select(key.alias("h"), index).orderBy("h", index).offset(n - (last.upto - last.n)).first()
    return F.struct(key.alias("h"), F.col(index).alias("i")) < F.struct(F.lit(behind.h).alias("h"), F.lit(behind[index]).cast(df.schema[index].dataType).alias("i"))


def _part(size: int | float, n: Column) -> Column:
    return F.lit(size) if isinstance(size, int) else F.floor(n * size)


def split(obs: DataFrame, validation: int | float = 0.2, test: int | float = 0.0, artifact: str = "artifact", index: str = "global_idx", seed: int = 42) -> DataFrame:
    """Add ``split``: whole held-out artifacts are test, then a random share is validation, the rest train.

    Artifacts in seeded order are taken while their sum of cells stays within the test size; the first one
    that would pass it ends the list. With a test size above 0 at least the first artifact is taken. A
    fraction is one of all cells; sizes that leave no training cells raise.
    """
    sizes = obs.groupBy(artifact).agg(F.count("*").alias("n"))
    order = Window.orderBy(hash_key(seed, artifact), artifact)
    every = Window.partitionBy()
    at = sizes.select(artifact, F.sum("n").over(order).alias("upto"), F.row_number().over(order).alias("nth"), F.sum("n").over(every).alias("total"))
    wanted = test > 0
    at = at.withColumn("held", F.lit(wanted) & ((F.col("upto") <= _part(test, F.col("total"))) | (F.col("nth") == 1)))
    rows = obs.join(small(at.select(artifact, "held")), artifact)
    first = among_first(rows.where(~F.col("held")), validation if isinstance(validation, int) else math.floor(obs.count() * validation), index, seed)
    return rows.withColumn("split", F.when(F.col("held"), "test").when(first, "validation").otherwise("train")).drop("held")


def label_intervals(weights: DataFrame, label: str = "label", weight: str = "weight", curriculum: tuple[int, int] | None = None) -> DataFrame:
    """``lo`` and ``hi``: each class's part of [0, 1) by its weight. ``curriculum`` (epoch, length) raises the
    weights to min(1, (epoch + 5) / length)."""
    w = F.col(weight) if curriculum is None else F.pow(F.col(weight), F.lit(min(1.0, (curriculum[0] + 5) / curriculum[1])))
    at = weights.withColumn("__w", w).where("__w > 0")
    total = F.sum("__w").over(Window.partitionBy())
    upto = F.sum("__w").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(Window.orderBy(F.desc(label))) == 1
    hi = F.when(last, 1.0).otherwise(upto / total)
    return at.withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy(label)), F.lit(0.0))).drop("__w")


def draw_labels(weights: DataFrame, n: int, seed: int = 0, label: str = "label", weight: str = "weight", curriculum: tuple[int, int] | None = None) -> DataFrame:
    """``draw_id`` 0 .. n - 1 and its class, drawn with replacement by weight.

    [0, 1) is cut into as many buckets as there are classes, and a class lies in each bucket that its interval reaches into, so
    a draw meets two classes on average, by its bucket. Classes are broadcast if few by count.
    """
    parts = label_intervals(weights, label, weight, curriculum).select(label, "lo", "hi")
    buckets = max(1, weights.count())
    at = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("long")
    parts = parts.withColumn("__b", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw_id"), uniform(seed, F.col("id")).alias("u")).withColumn("__b", at(F.col("u")))
    return draws.join(small(parts), "__b").where("u >= lo AND u < hi").select("draw_id", label)


def draw_rows(draws: DataFrame, index: DataFrame, seed: int = 0, label: str = "label") -> DataFrame:
    """A row for each draw, uniform within its class and with replacement.

    ``index`` (label, ``pos`` from 0, row id) as :func:`labels.class_index` makes it. A draw hashes a position below
    the class's size and joins on class and position, so no class is paired with all its draws.
    """
    sizes = index.groupBy(label).agg(F.count("*").alias("n"))
    at = draws.join(small(sizes), label).withColumn("pos", F.floor(uniform(f"{seed}r", "draw_id") * F.col("n")).cast("long"))
    return at.drop("n").join(index.withColumn("pos", F.col("pos").cast("long")), [label, "pos"]).drop("pos")


def draw_without_replacement(rows: DataFrame, counts: DataFrame, index: str, label: str = "label", weight: str | None = None, seed: int = 0) -> DataFrame:
    """Of each class at most ``n`` (in ``counts``) rows, none twice; by weight if given (exponential keys).
    Rows of weight 0 are never drawn.

    Keys are ranked within classes by stretches of keys, so a class of any size is many tasks.
    """
    u = F.greatest(uniform(seed, index), F.lit(2.0**-53))
    at = rows if weight is None else rows.where(F.col(weight) > 0)
    x = at.agg(F.count("*").alias("n"), (F.lit(1.0) if weight is None else F.avg(weight)).alias("mean")).first()
    at = at.withColumn("__key", u if weight is None else -F.log(u) / F.col(weight))
    # Falls from 1 to 0 as the key grows, about evenly over all rows.
    even = F.col("__key") if weight is None else 1 - F.exp(-F.col("__key") * float(x["mean"] or 1.0))
    parts = -(-4 * x["n"] // PART_ROWS) or 1
    ranked = numbered(at, [label], F.least(F.floor(even * parts), F.lit(parts - 1)).cast("long"), ["__key", index], "rank").drop("__key")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int")).join(small(counts.select(label, "n")), label).where("rank <= n").drop("n")


def draw_weighted(draws: DataFrame, rows: DataFrame, index: str, weight: str, label: str = "label", seed: int = 0) -> DataFrame:
    """A row for each draw within its class, by weight and with replacement.

    Each class's weights are laid end to end over [0, 1), by sums within stretches of the index and sums of these, and cut into as many
    buckets as the class has rows; a draw meets only the rows that reach into its bucket, two on average.
    """
    some = rows.where(F.col(weight) > 0)
    laid = running_sums(some, [label], weight, ranges(some, index), [index], "__from", "__to", "__all")
    sizes = small(some.groupBy(label).agg(F.count("*").alias("__n")))
    laid = laid.select(label, index, (F.col("__from") / F.col("__all")).alias("__lo"), (F.col("__to") / F.col("__all")).alias("__hi"))
    at = lambda c: F.least(F.floor(c * F.col("__n")), F.col("__n") - 1).cast("long")
    laid = laid.join(sizes, label).withColumn("__b", F.explode(F.sequence(at(F.col("__lo")), at(F.col("__hi"))))).drop("__n")
    asked = draws.withColumn("__u", uniform(f"{seed}w", "draw_id")).join(sizes, label).withColumn("__b", at(F.col("__u"))).drop("__n")
    return asked.join(laid, [label, "__b"]).where("__u >= __lo AND __u < __hi").select("draw_id", label, index)


def restrict_top(rows: DataFrame, n: int, weight: str, index: str, label: str = "label") -> DataFrame:
    """The ``n`` rows of largest weight in each class, ties by index.

    Stretches of the index keep their own ``n`` first, so a large class is ranked by many tasks.
    """
    order = [F.desc(weight), index]
    at = rows.withColumn("__part", ranges(rows, index))
    for keys in ([label, "__part"], [label]):
        at = at.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n)
    return at.drop("__r", "__part")


def rank_shard(df: DataFrame, n: int, rank: int, world: int, start_at: int = 0, index: str = "global_idx") -> DataFrame:
    """The contiguous rows of one of ``world`` ranks."""
    size = -(-n // world)
    return df.where((F.col(index) >= start_at // world + rank * size) & (F.col(index) < min((rank + 1) * size, n)))
