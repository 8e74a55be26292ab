"""Column functions: seeded uniforms, transforms of expression values, quantile bins.

A sparse cell is an array of ``struct<gene, value>``; genes that it lacks have value 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *columns: Column | str) -> Column:
    """A hexadecimal hash of the seed and the columns' text; its order is a seeded shuffle."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)))


def uniform(seed: int | str, *columns: Column | str) -> Column:
    """A uniform number in [0, 1), the same in every run and on every cluster: 52 bits of the hash."""
    return F.conv(F.substring(hash_key(seed, *columns), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def logp1(value: Column) -> Column:
    return F.log2(value + 1)


def depth_normalise(value: Column, depth: Column, to: float) -> Column:
    """``value`` scaled to a depth of ``to``; null where the depth is 0."""
    return value * to / F.nullif(depth, F.lit(0.0))


def nnz_weight(nnz: Column, scale: float = 1000.0) -> Column:
    """Weight of a cell by its expressed genes: a sigmoid from 1 to ``scale`` with its middle at 2000."""
    return 1 + (scale - 1) / (1 + F.exp((nnz - 2000) * -0.003))


def depth(expr: Column) -> Column:
    """Sum of a sparse cell's values."""
    return F.aggregate(expr, F.lit(0.0), lambda a, x: a + x["value"])


def nnz(expr: Column) -> Column:
    return F.size(F.filter(expr, lambda x: x["value"] != 0))


#: Inverse of a transform by its name.
INVERSES = {"rlogp1": lambda v: F.exp(v) - 1, "logp1": lambda v: F.pow(F.lit(2.0), v) - 1, "sqrt": lambda v: v * v - 1}


def revert_to_raw(values: Column, mode: str = "logp1") -> Column:
    """Counts from a cell's transformed ``values``: inverted, divided by the least that is not zero, rounded half to even.

    The inverse belongs to a row of which at least one value is not zero; else all are zero.
    """
    if mode not in INVERSES:
        raise ValueError(f"mode must be one of {sorted(INVERSES)}")
    plain = F.transform(values, INVERSES[mode])
    least = F.array_min(F.filter(plain, lambda v: v != 0))
    return F.transform(plain, lambda v: F.rint(F.coalesce(v / least, F.lit(0.0))))


def quantile_edges(ordered: Column, n: int) -> Column:
    """Linear quantiles of a sorted array at ``n`` equal steps from 0 to 1. ``ordered`` must be a column of
    its own, as it is read at every step. Empty arrays have no edges."""
    last = F.size(ordered) - 1

    def edge(i: Column) -> Column:
        at = last * (i / F.lit(float(n - 1)))
        low = F.floor(at).cast("int")
        a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, last + 1))
        return a + (b - a) * (at - low)

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), edge)).otherwise(F.array().cast("array<double>"))


def digitize(value: Column, edges: Column) -> Column:
    """How many of the edges are at most ``value``."""
    return F.size(F.filter(edges, lambda e: e <= value)).cast("long")


def split_ids(ids: Column) -> Column:
    """The trimmed parts of a comma-joined list."""
    return F.transform(F.split(ids, ","), lambda x: F.trim(x))


def random_string(length: int, seed: int | None = None, digits: bool = True) -> Column:
    """Random letters and digits, or letters alone."""
    text = F.randstr(F.lit(length), F.lit(seed) if seed is not None else None)
    return text if digits else F.translate(text, "0123456789", "abcdefghij")
